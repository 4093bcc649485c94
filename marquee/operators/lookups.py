"""Point lookups of the reference, re-aimed as joins from a DataFrame of
requests so that a million lookups are one job. Every function returns one
row per input row (left joins against a side that is unique on the join
key), so a hot key never multiplies rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.semantics import ci_key


def customer_ids_by_email(customer: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Unique e-mail key -> customer id. The reference reads the first row
    of ``WHERE e_mail = ?``; we pin it as the smallest id. With ``keys`` (a
    frame holding ``_mail_key``) the Customer rows are first cut down to the
    requested e-mails by a semi join, so only matching rows are shuffled for
    the aggregation."""
    c = customer.where(F.col("e_mail").isNotNull()).select(
        ci_key("e_mail").alias("_mail_key"), "ID")
    if keys is not None:
        # distinct keys: a hot e-mail collapses map-side, and the build side
        # of the semi join stays one row per key
        c = c.join(keys.select("_mail_key").distinct(), "_mail_key", "left_semi")
    return c.groupBy("_mail_key").agg(F.min("ID").alias("customer_id"))


def customer_by_email(requests: DataFrame, customer: DataFrame) -> DataFrame:
    """customer id of each request's e-mail (NULL when unknown)."""
    keyed = requests.select("request_id", "e_mail", ci_key("e_mail").alias("_mail_key"))
    return (keyed.join(customer_ids_by_email(customer, keyed), "_mail_key", "left")
            .select("request_id", "e_mail", "customer_id"))


def quote_events(requests: DataFrame, event_catalog: DataFrame) -> DataFrame:
    """company and both prices of each request's event."""
    ev = event_catalog.select(F.col("ID").alias("event_id"), "company_id", "general_price",
                              "vip_price", F.lit(True).alias("_event_known"))
    return requests.join(ev, "event_id", "left")


def latest_ticket_id(ticket: DataFrame) -> DataFrame:
    """The newest ticket id (``ORDER BY ID DESC LIMIT 1``) as a plain
    max aggregate: partial max per task, one tiny final merge, no sort."""
    return ticket.agg(F.max("ID").alias("latest_ticket_id"))


def customer_profile(ids: DataFrame, customer: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """profile fields of each id; unknown or NULL ids give empty strings
    (``= NULL`` never matches)."""
    c = customer.select(F.col("ID").alias("_cid"), "first_name", "last_name", "e_mail", "phone_num")
    joined = ids.join(c, ids[id_col] == c["_cid"], "left")
    return joined.select(
        *[ids[x] for x in ids.columns],
        *[F.coalesce(F.col(x), F.lit("")).alias(x)
          for x in ("first_name", "last_name", "e_mail", "phone_num")])


def match_contacts(requests: DataFrame, customer: DataFrame) -> DataFrame:
    """customer id whose (e-mail, phone) equal the request's pair
    (case/accent-insensitive text equality); NULL when none, smallest id
    when several. Customer rows are cut to the requested pairs first."""
    keyed = requests.select("request_id", "e_mail", "phone_num",
                            ci_key("e_mail").alias("_mk"), ci_key("phone_num").alias("_pk"))
    ids = (customer.where(F.col("e_mail").isNotNull() & F.col("phone_num").isNotNull())
           .select(ci_key("e_mail").alias("_mk"), ci_key("phone_num").alias("_pk"), "ID")
           .join(keyed.select("_mk", "_pk").distinct(), ["_mk", "_pk"], "left_semi")
           .groupBy("_mk", "_pk")
           .agg(F.min("ID").alias("customer_id")))
    return (keyed.join(ids, ["_mk", "_pk"], "left")
            .select("request_id", "e_mail", "phone_num", "customer_id"))
