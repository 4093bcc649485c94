"""The derived tables are dealt over tasks by their row counts, and what many
readers share is made once."""

import pytest
from marquee.plans import bundles, registry
from marquee.sources import testdata as td
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def many_lines(spark, tmp_path_factory):
    """16,000 lines of 4,000 orders; some keys are null, some lines come twice."""
    d = str(tmp_path_factory.mktemp("many"))
    k = F.col("id")
    order = F.when(k % 401 != 0, F.floor(k / 4)).cast("bigint")
    lines = spark.range(16_000).select(
        order.alias("l_orderkey"), (k * 7 % 900).alias("l_partkey"), (k % 10).alias("l_suppkey"), (k % 4 + 1).cast("int").alias("l_linenumber"),
        (k / 8).alias("l_extendedprice"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "R").otherwise("N").alias("l_returnflag"))
    lines.union(lines.where(k % 50 == 0)).coalesce(2).write.parquet(f"{d}/lineitem.parquet")
    spark.range(4_000).select(k.alias("o_orderkey"), (k * 13 % 3001).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"),
                              F.lit("2020-01-02").cast("timestamp").alias("o_orderdate")).coalesce(1).write.parquet(f"{d}/orders.parquet")
    spark.range(900).select(k.alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("t").alias("p_type"), F.lit("b").alias("p_brand"),
                            (k % 50 + 1).cast("int").alias("p_size"), F.lit(9.5).alias("p_retailprice")).coalesce(1).write.parquet(f"{d}/part.parquet")
    spark.range(10).select(k.alias("s_suppkey")).coalesce(1).write.parquet(f"{d}/supplier.parquet")
    return d


def most_in_a_task(df) -> int:
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_no_task_holds_much_more_than_its_share_of_the_links(spark, many_lines, monkeypatch):
    expected = {tuple(r) for r in td.cust_of(spark, many_lines).collect()}
    monkeypatch.setattr(td, "TASK_ROWS", 800, raising=False)
    links = td.cust_of(spark, many_lines)
    assert {tuple(r) for r in links.collect()} == expected and len(expected) > 4_000
    assert most_in_a_task(links) < 1_200


def test_lines_are_dealt_once_for_the_grouping_and_their_orders(spark, many_lines):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = td.purchase(spark, many_lines)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # one exchange of the lines, one of the orders
    assert plan.count("Exchange hashpartitioning") == 2


def test_the_admin_page_keeps_the_line_grouping_while_it_writes(spark, monkeypatch):
    seen, write = [], bundles.Bundle.write
    loaded = {}

    def load(*args, **kwargs):
        loaded["t"] = tables(*args, **kwargs)
        return loaded["t"]

    def watched(self, *args, **kwargs):
        seen.append([df.is_cached for df in loaded["t"].cached])
        return write(self, *args, **kwargs)

    tables = td.load_tables
    monkeypatch.setattr(td, "load_tables", load)
    monkeypatch.setattr(bundles.Bundle, "write", watched)
    lines = registry.BUNDLES["admin_bundle"](spark, SF)
    assert seen == [[True]] and not loaded["t"].cached[0].is_cached
    assert lines.where("report = 'purchase'").count() == tables(spark, SF).purchase.count()
