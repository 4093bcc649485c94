"""Quality rules with adaptive thresholds.

Base counts are taken natively over whole texts. Per (language, source) the
ratios of documents that pass the base rule feed mergeable KLL quantile
sketches. A rule's limit is a quantile of the group, reached again ``width``
times as far as that quantile lies from the median, so cutoffs follow each
group's own spread; the quantile's level leaves room for the share of the group
that may be junk. A quantile counts with the weight ``n / (n + PRIOR_ROWS)``
against its language's (merged sketches), and the language's against the whole
table's: no size switches a group's own cutoffs on or off. ``grain`` widens a
limit where values tie (most texts have no symbol and no repeated line).
Sketches are exact up to a few thousand values per group and merge map-side, so
a source with a third of all rows sends one small sketch per task.

Null texts have no words and fail the base rule; null languages and sources are
groups of their own; repeated rows count and are judged one by one. Only
built-in column functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import let, stored

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
CAPITALS = "[A-Z]"
PRIOR_ROWS = 200
SKETCH_K = 800
#: ratio -> (level of the quantile, width, grain, whether low values are outliers too)
RULES = {"symbols": (0.75, 3.0, 0.2, False), "capitals": (0.95, 3.0, 0.01, False),
         "dup_lines": (0.99, 1.0, 0.08, False), "word_length": (0.9, 3.0, 0.2, True)}


def words(text: Column) -> Column:
    """Words of a text, in order; empty for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def occurrences(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are sorted
    by 33 bits of their hash packed with their place; only those whose hash
    meets a neighbour's are compared as text."""
    packed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.shiftleft(
        F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 31).bitwiseOR(i.cast("bigint"))))

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a == b, F.lit(False))

    def met(s: Column) -> Column:
        near = F.filter(s, lambda x, j: same(F.shiftright(x, 31), F.shiftright(F.get(s, j - 1), 31)) |
                        same(F.shiftright(x, 31), F.shiftright(F.get(s, j + 1), 31)))
        return F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))

    def truly(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: same(x["window"], F.get(s, j - 1)["window"]) |
                         same(x["window"], F.get(s, j + 1)["window"]))
        return F.sort_array(F.transform(twice, lambda x: x["at"]))

    def windows(at: Column) -> Column:
        return F.sort_array(F.transform(at, lambda i: F.struct(
            F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("window"), i.alias("at"))))

    def covered(at: Column) -> Column:
        parts = F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3))))
        return F.aggregate(parts, F.lit(0), lambda a, x: a + x)

    def count(s: Column) -> Column:
        return let(met(s), lambda at: F.when(F.size(at) == 0, F.lit(0)).otherwise(
            let(windows(at), lambda ws: let(truly(ws), covered))))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(packed, count))


def measures(text: Column) -> Column:
    """A struct of the base counts and the ratios."""
    text = F.coalesce(text, F.lit(""))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"))

    def of_words(w: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
        return let(let(lines, of_lines), lambda ln: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            occurrences(text, SYMBOLS).alias("n_symbols"),
            ln["dup"].cast("bigint").alias("n_dup_lines"),
            repeat_words(w).cast("bigint").alias("n_repeat_words"),
            occurrences(text, CAPITALS).alias("n_capitals"),
            ln["lines"].cast("bigint").alias("n_lines")))

    return let(words(text), of_words)


def measured(docs: DataFrame) -> DataFrame:
    """Per document: counts, ``base_failed`` and the ratios (null without a word)."""
    m = docs.select("doc_id", "lang", "source", measures(F.col("text")).alias("m")).select("doc_id", "lang", "source", "m.*")
    n = F.nullif(F.col("n_words"), F.lit(0))
    return m.select("*", ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
                    (F.col("n_symbols") / n).alias("symbols"),
                    (F.col("n_capitals") / F.nullif(F.col("word_chars"), F.lit(0))).alias("capitals"),
                    (F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))).alias("dup_lines"),
                    (F.col("word_chars") / n).alias("word_length"))


def thresholds(rows: DataFrame, sketch_k: int = SKETCH_K) -> DataFrame:
    """(lang, source) -> lower and upper limit of every ratio."""
    good = rows.where("NOT base_failed")
    sketches = stored(good.groupBy("lang", "source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(r, F.lit(sketch_k)).alias(r) for r in RULES]), "sketches")

    def merged(*by: str) -> DataFrame:
        return sketches.groupBy(*by).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, F.lit(sketch_k)).alias(r) for r in RULES])

    def quantiles(df: DataFrame, prefix: str) -> list[Column]:
        """Per rule the lower level's quantile, the median and the upper level's."""
        return [F.kll_sketch_get_quantile_double(df[r], F.array(F.lit(round(1 - level, 4)), F.lit(0.5), F.lit(level))).alias(f"{prefix}{r}")
                for r, (level, *_) in RULES.items()]

    def blend(own: Column, n: Column, prior: Column) -> Column:
        weight = n / (n + PRIOR_ROWS)
        return F.zip_with(own, prior, lambda a, b: weight * a + (1 - weight) * b)

    def limits(r: str, q: Column) -> list[Column]:
        _, width, grain, both = RULES[r]
        # rounded: a sketch's last digits depend on the order of its merges
        low = F.round(q[0] - width * (q[1] - q[0]) - grain, 3) if both else F.lit(float("-inf"))
        return [low.alias(f"{r}_low"), F.round(q[2] + width * (q[2] - q[1]) + grain, 3).alias(f"{r}_high")]

    total = merged()
    overall = total.where("n > 0").select(*quantiles(total, "")).first()  # one row
    if overall is None:  # nothing passes the base rule: no group, no limit
        return sketches.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"),
                               *[F.lit(0.0).alias(f"{r}_{end}") for r in RULES for end in ("low", "high")])
    by_lang = merged("lang")
    langs = by_lang.select(F.col("lang").alias("l_lang"), F.col("n").alias("l_n"), *quantiles(by_lang, "l_"))
    own = sketches.select("lang", "source", "n", *quantiles(sketches, "g_"))
    joined = own.join(langs, own["lang"].eqNullSafe(langs["l_lang"]), "left")
    for r in RULES:
        table = F.array(*map(F.lit, overall[r]))
        joined = joined.withColumn(r, blend(F.col(f"g_{r}"), F.col("n"), blend(F.col(f"l_{r}"), F.col("l_n"), table)))
    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"),
                         *[c for r in RULES for c in limits(r, F.col(r))])


def judged(docs: DataFrame, sketch_k: int = SKETCH_K) -> DataFrame:
    """Per document: base counts, base rule, and whether it is kept."""
    rows = stored(measured(docs), "quality-measures")
    limits = stored(thresholds(rows, sketch_k), "thresholds")
    met = rows.join(limits, rows["lang"].eqNullSafe(limits["t_lang"]) & rows["source"].eqNullSafe(limits["t_source"]), "left")
    inside = F.lit(True)
    for r in RULES:
        inside = inside & F.coalesce(F.col(r).between(F.col(f"{r}_low"), F.col(f"{r}_high")), F.lit(True))
    return met.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & inside).alias("kept"))
