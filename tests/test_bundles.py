"""Bundles give the same reports as the stand-alone operators, and write
each report as its own table."""

import os
import tempfile

from marquee.operators import reports
from marquee.plans import bundles
from marquee.sources import testdata as td

SF = "/root/testdata/sf0.01"


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_admin_bundle_matches_operators(spark):
    t = td.load_tables(spark, SF)
    b = bundles.admin_bundle(t, class_spend=True)
    try:
        assert same(b.reports["customer_loyalty"], reports.customer_loyalty(t))
        assert same(b.reports["event_type_popularity"], reports.event_type_popularity(t))
        assert same(b.reports["company_most_customers"], reports.company_most_tickets(t))
        assert same(b.reports["most_spending_customer"], reports.top_customer_by_class(t))
        assert b.reports["ticket"].columns == ["ID", "type", "price", "event_id", "distributer_id"]
        assert len(b.cached) == 2
    finally:
        b.release()
    assert b.cached == []


def test_manager_and_public_bundles_write_tables(spark):
    t = td.load_tables(spark, SF)
    root = tempfile.mkdtemp(prefix="bundle-", dir=spark.conf.get("spark.checkpoint.dir"))
    paths = bundles.manager_bundle(t).write(os.path.join(root, "manager"), parallelism=3)
    assert set(paths) == {"top_revenue_events", "company_most_event_types",
                          "company_sales_ranking", "customer_loyalty", "event_type_popularity",
                          "events", "distributers"}
    loyalty = spark.read.parquet(paths["customer_loyalty"])
    assert loyalty.columns == ["CustomerName", "CompanyName", "PurchaseCount"]
    assert loyalty.count() == reports.customer_loyalty(t).count()
    admin = bundles.admin_bundle(t)
    admin_paths = admin.write(os.path.join(root, "admin"), parallelism=4)
    assert admin.cached == []
    assert spark.read.parquet(admin_paths["customer_loyalty"]).count() == loyalty.count()
    pub = bundles.public_bundle(t)
    ranked = [r.EventType for r in pub.reports["event_types_ranked"].collect()]
    assert ranked == [r.EventType for r in reports.event_type_popularity(t).collect()]
