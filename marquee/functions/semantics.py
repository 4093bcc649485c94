"""Column helpers that reproduce the reference's value semantics with
native Spark expressions (no UDFs): every helper maps Column -> Column and
stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference for equal results.
# Bounds of a DECIMAL(10,0) target: out-of-range text numbers clamp to these.
DECIMAL10_MAX = 9999999999
# Leading numeric prefix of a text number: optional blanks, sign, digits with
# an optional fraction (or a bare fraction), optional exponent.
NUMERIC_PREFIX = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"
# Form texts used by the purchase pipeline.
PHONE_ERROR = "Invalid Phone Number!"
EMAIL_ERROR = "Invalid Email!"
UNKNOWN_EVENT_ERROR = "Unknown event"
GENERAL_TICKET = "General"
VIP_CLASS = "vip"
EMAIL_SUFFIX = ".com"


def _digit_ranges() -> str:
    """Regex ranges of the characters Python's ``str.isdigit`` accepts beyond
    decimal digits (numeric type Digit: superscripts, circled digits, ...),
    derived from the Unicode database rather than listed by hand."""
    import sys
    cps = [c for c in range(sys.maxunicode + 1) if chr(c).isdigit() and not chr(c).isdecimal()]
    ranges, start, prev = [], None, None
    for c in cps:
        if start is None:
            start = prev = c
        elif c == prev + 1:
            prev = c
        else:
            ranges.append((start, prev))
            start = prev = c
    if start is not None:
        ranges.append((start, prev))
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}"
                   for a, b in ranges)


# The form's phone rule: ten characters that are all digits in the sense of
# Python's str.isdigit (decimal digits of any script plus numeric-type Digit).
PHONE_PATTERN = "^[\\p{Nd}" + _digit_ranges() + "]{10}\\z"
# Collation used for text equality and text grouping keys.
CI_COLLATION = "UNICODE_CI_AI"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lenient_from_prefix(original: Column, prefix: Column) -> Column:
    as_double = prefix.try_cast("double")
    exact = prefix.try_cast("decimal(38,20)")
    hi = float(DECIMAL10_MAX) + 0.5
    return (F.when(original.isNull(), F.lit(None))
            .when(prefix == "", F.lit(0))
            .when(as_double >= hi, F.lit(DECIMAL10_MAX))
            .when(as_double <= -hi, F.lit(-DECIMAL10_MAX))
            .otherwise(exact)
            .cast("decimal(10,0)"))


def lenient_decimal(col) -> Column:
    """``CAST(text AS DECIMAL)`` with the database's lenient rules: use the
    leading numeric prefix, no prefix gives 0, NULL stays NULL, round half
    away from zero to an integer, clamp to the DECIMAL(10,0) range.
    Never raises, also under ANSI mode. (Inside one expression the prefix
    regex is referenced by several branches; on a DataFrame prefer
    :func:`with_lenient_decimal`, which extracts it once per row.)"""
    c = _c(col)
    return _lenient_from_prefix(c, F.regexp_extract(c, NUMERIC_PREFIX, 1))


def with_lenient_decimal(df: DataFrame, src: str, out: str) -> DataFrame:
    """Add ``out`` = :func:`lenient_decimal` of ``src``, extracting the
    numeric prefix in its own projection so the regex runs once per row
    (Catalyst does not inline a non-trivial alias used several times)."""
    tmp = f"_{out}_prefix"
    return (df.withColumn(tmp, F.regexp_extract(F.col(src), NUMERIC_PREFIX, 1))
            .withColumn(out, _lenient_from_prefix(F.col(src), F.col(tmp)))
            .drop(tmp))


def ci_key(col) -> Column:
    """Case- and accent-insensitive text key (the database's default
    collation) for equality and GROUP BY."""
    return F.collate(_c(col), CI_COLLATION)


def ci_eq(col, value: str) -> Column:
    return ci_key(col) == F.lit(value)


def clean_money(col) -> Column:
    """Form money text: drop ``,`` and ``$``, trim, parse as a number
    (DECIMAL(38,10), so the form's decimal text is kept exactly). NULL when
    the text does not parse; callers route those rows to rejects."""
    return F.trim(F.regexp_replace(_c(col), r"[,$]", "")).try_cast("decimal(38,10)")


def report_price(ticket_type, general_price, vip_price) -> Column:
    """Price a purchase is valued at in the spend report: ``vip`` (any case)
    takes the VIP price, anything else (NULL included) the general price."""
    return F.when(ci_eq(ticket_type, VIP_CLASS), _c(vip_price)).otherwise(_c(general_price))


def sale_price(ticket_type, general_price, vip_price) -> Column:
    """Price charged at booking time: exactly ``General`` takes the general
    price, anything else the VIP price (case-sensitive)."""
    t = _c(ticket_type)
    return F.when(t.isNotNull() & (t == GENERAL_TICKET), _c(general_price)).otherwise(_c(vip_price))


def full_name(first, last) -> Column:
    """``CONCAT(first, ' ', last)``: NULL if either part is NULL."""
    return F.concat(_c(first), F.lit(" "), _c(last))


def phone_ok(col) -> Column:
    c = _c(col)
    return F.coalesce(c.rlike(PHONE_PATTERN), F.lit(False))


def email_ok(col) -> Column:
    c = _c(col)
    return F.coalesce(c.endswith(EMAIL_SUFFIX), F.lit(False))


def reject_reason(phone, email) -> Column:
    """First failing form rule, phone before e-mail; NULL when valid."""
    return (F.when(~phone_ok(phone), F.lit(PHONE_ERROR))
            .when(~email_ok(email), F.lit(EMAIL_ERROR)))


def split_pair(col) -> tuple[Column, Column, Column]:
    """``"company,customer"`` into two BIGINT columns plus a validity flag:
    exactly two comma-separated integer parts are required."""
    c = _c(col)
    parts = F.split(c, ",")
    a = F.trim(F.try_element_at(parts, F.lit(1)))
    b = F.trim(F.try_element_at(parts, F.lit(2)))
    ok = F.coalesce(c.isNotNull() & (F.size(parts) == 2)
                    & a.rlike(r"^[+-]?\d+$") & b.rlike(r"^[+-]?\d+$"), F.lit(False))
    first = F.when(ok, a.try_cast("bigint"))
    second = F.when(ok, b.try_cast("bigint"))
    return first, second, ok & first.isNotNull() & second.isNotNull()
