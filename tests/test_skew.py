"""A hot event holding a third of all tickets and purchases: the reports
stay exact, ticket counts collapse map-side, and with broadcasts off the
remaining joins are split by AQE's skew handling instead of landing in one
task."""

import datetime as dt
from decimal import Decimal

import pytest

from marquee import schemas as S
from marquee.operators import reports
from marquee.tables import Tables

N = 30000
HOT = 7


@pytest.fixture(scope="module")
def skewed(spark):
    from pyspark.sql import functions as F
    t0 = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(i, f"e{i}", ["Concert", "Opera", "Fair"][i % 3], "x", t0, Decimal("10.00"),
          Decimal("20.00"), str(i), None, None, i % 50) for i in range(1000)], S.EVENT_CATALOG)
    company = spark.createDataFrame([(i, f"c{i}", "x") for i in range(50)], S.COMPANY)
    customer = spark.createDataFrame([(i, f"f{i}", f"l{i}", f"m{i}@x.com", "5550000000")
                                      for i in range(3000)], S.CUSTOMER)
    ids = spark.range(N)
    ticket = ids.select(
        F.col("id").alias("ID"), F.when(F.col("id") % 2 == 0, "vip").otherwise("General").alias("type"),
        F.lit(100).alias("tickets_available"), F.lit(1).alias("tickets_sold"),
        F.lit(Decimal("12.50")).cast("decimal(10,2)").alias("price"),
        F.when(F.col("id") % 3 == 0, F.lit(HOT)).otherwise(F.col("id") % 1000).alias("event_id"),
        F.lit(1).cast("bigint").alias("distributer_id"))
    ticket = ticket.select(*[F.col(f.name).cast(f.dataType) for f in S.TICKET.fields])
    purchase = spark.createDataFrame(
        [(i, i % 3000, i, "Cash", t0) for i in range(N)], S.PURCHASE)
    cust_of = spark.createDataFrame([], S.CUST_OF)
    distributer = spark.createDataFrame([(1, "d", "x")], S.DISTRIBUTER)
    return Tables(events, company, distributer, customer, ticket, purchase, cust_of)


def test_hot_event_reports_exact(spark, skewed):
    rows = {r.EventType: r.TotalTicketsSold for r in
            reports.event_type_popularity(skewed).collect()}
    assert sum(rows.values()) == N
    top = reports.company_most_tickets(skewed).collect()[0]
    assert top.CompanyID == HOT % 50
    loyalty = reports.customer_loyalty(skewed)
    assert loyalty.groupBy().sum("PurchaseCount").collect()[0][0] == N


def test_skewed_joins_are_split(spark, skewed):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = reports.top_customer_by_class(skewed, k=5)
        got = df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text
        assert "skew=true" in text, text
        expected = got
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert [tuple(r) for r in reports.top_customer_by_class(skewed, k=5).collect()] == \
        [tuple(r) for r in expected]
