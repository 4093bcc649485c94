"""Data checks the plans rely on.

Several reports aggregate on ids first and attach names afterwards, and the
change fold treats keys as row identities; both equal the reference's
``GROUP BY id, name`` results only when keys are unique. These checks are
distributed aggregations (partial counts per key), never a collect of the
table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.schemas import TABLE_KEYS
from marquee.tables import Tables


def duplicate_keys(t: Tables) -> DataFrame:
    """(table, key text, copies) for every key held by more than one row."""
    parts = []
    for name in t.names():
        ks = TABLE_KEYS[name]
        key_txt = F.concat_ws(",", *[F.col(k).cast("string") for k in ks])
        parts.append(t.get(name).groupBy(*ks).agg(F.count(F.lit(1)).alias("copies"))
                     .where(F.col("copies") > 1)
                     .select(F.lit(name).alias("table"), key_txt.alias("key"), "copies"))
    return reduce(DataFrame.unionByName, parts)


def orphan_counts(t: Tables) -> DataFrame:
    """Rows whose parent is missing, per foreign key (they drop out of the
    inner-join reports, as in the reference)."""
    def orphans(child: DataFrame, fk: str, parent: DataFrame, label: str) -> DataFrame:
        return (child.where(F.col(fk).isNotNull()).select(fk)
                .join(parent.select(F.col("ID").alias(fk)), fk, "left_anti")
                .agg(F.count(F.lit(1)).alias("rows"))
                .select(F.lit(label).alias("link"), "rows"))
    return reduce(DataFrame.unionByName, [
        orphans(t.purchase, "ticket_id", t.ticket, "purchase.ticket_id"),
        orphans(t.purchase, "customer_id", t.customer, "purchase.customer_id"),
        orphans(t.ticket, "event_id", t.event_catalog, "ticket.event_id"),
        orphans(t.event_catalog, "company_id", t.company, "event.company_id"),
    ])
