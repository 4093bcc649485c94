"""Plan checks: the physical plans keep the shape the operators are
"""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from marquee.operators import reports
from marquee.sources import snapshots
from marquee.sources import testdata as td

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    root = tempfile.mkdtemp(prefix="plans-", dir=spark.conf.get("spark.checkpoint.dir"))
    snapshots.write_snapshot(td.load_tables(spark, SF), root, "1")
    return snapshots.read_snapshot(spark, root)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def lines(df) -> list[str]:
    return plan(df).splitlines()


def first_line(ls, pattern) -> int:
    for i, line in enumerate(ls):
        if re.search(pattern, line):
            return i
    return -1


@pytest.mark.parametrize("fn", [reports.event_type_popularity, reports.company_most_tickets])
def test_ticket_counts_aggregate_partially_below_the_join(t, fn):
    ls = lines(fn(t))
    partial = first_line(ls, r"partial_count\(event_id")
    join = first_line(ls, r"Join")
    assert partial > join >= 0, "\n".join(ls)


def test_sales_ranking_sums_before_the_outer_join(t):
    ls = lines(reports.company_sales_ranking(t))
    assert first_line(ls, r"partial_sum") > first_line(ls, r"Join") >= 0


def test_no_single_partition_exchange_in_full_reports(t):
    for fn in (reports.event_type_popularity, reports.event_revenue,
               reports.company_sales_ranking, reports.customer_loyalty, reports.event_listing):
        assert "SinglePartition" not in plan(fn(t)), fn.__name__


def test_top1_reports_use_take_ordered(t):
    for fn in (reports.top_customer_by_class, reports.top_customer_price_count,
               reports.company_most_events, reports.company_most_tickets):
        text = plan(fn(t))
        assert "TakeOrderedAndProject" in text, fn.__name__


def test_scans_are_pruned_and_filters_pushed(t):
    text = plan(reports.event_revenue(t))
    assert re.search(r"ReadSchema: struct<ID:bigint,name:string,income:string>", text), text
    assert text.count("regexp_extract") == 1, text
    text = plan(reports.company_most_events(t))
    assert "PushedFilters: [IsNotNull(company_id)]" in text, text


def test_text_rules_stay_native(t):
    for fn in (reports.event_revenue, reports.top_customer_by_class,
               reports.event_type_popularity):
        text = plan(fn(t))
        assert "PythonUDF" not in text and "BatchEvalPython" not in text
        assert "ArrowEvalPython" not in text


def test_point_lookup_reads_one_of_many_files(spark):
    """Whole tables lie in key ranges: a key filter reads the rows of one file
    (scan metrics), however the rows arrived."""
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    root = tempfile.mkdtemp(prefix="ranges-", dir=spark.conf.get("spark.checkpoint.dir"))
    n = 40_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).cast("int").alias("purchase_id"), F.lit(1).alias("customer_id"),
                                 F.lit(1).alias("ticket_id")).repartition(8)
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        path = snapshots.write_table(rows, root, "1", "purchase")
        added = snapshots.write_table(rows.limit(100), root, "2", "purchase", by_range=False)
    finally:
        spark.conf.set(conf, before)
    assert spark.read.parquet(path).count() == n and spark.read.parquet(added).count() == 100
    spans = sorted(spark.read.parquet(path).groupBy(F.input_file_name().alias("file"))
                   .agg(F.min("purchase_id").alias("low"), F.max("purchase_id").alias("high")).drop("file").collect())
    assert len(spans) == 8 and all(a.high < b.low for a, b in zip(spans, spans[1:]))
    found = spark.read.parquet(path).where(F.col("purchase_id") == 12_345)
    assert len(found.collect()) == 1
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < n / 4
