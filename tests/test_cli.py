"""The command line end to end on sf0.001: load, report, bundle, intake,
apply-changes; later versions only rewrite the tables they change."""

import os
import tempfile

from marquee.__main__ import main
from marquee.operators import changes
from marquee.schemas import TABLE_SCHEMAS
from marquee.sources import snapshots
from marquee.sources import testdata as td

SF = "/root/testdata/sf0.001"


def test_cli_round_trip(spark):
    work = tempfile.mkdtemp(prefix="cli-", dir=spark.conf.get("spark.checkpoint.dir"))
    root = os.path.join(work, "store")
    # main() stops the session it builds; run everything against the shared
    # test session by building on it (getOrCreate) and re-creating afterwards
    import marquee.__main__ as cli
    cli.build_session = lambda master=None: spark
    stop = spark.stop
    spark.stop = lambda: None
    try:
        main(["load-testdata", "--sf-dir", SF, "--root", root])
        assert snapshots.current_version(spark, root) == "000000000000"
        main(["report", "--root", root, "--name", "customer_loyalty", "--out", f"{work}/r9"])
        assert spark.read.parquet(f"{work}/r9").count() > 0
        main(["bundle", "--root", root, "--page", "public", "--out", f"{work}/public"])
        td.visits(spark, SF).write.json(f"{work}/visits")
        main(["lookup", "--root", root, "--name", "customer_profile", "--requests",
              f"{work}/visits", "--format", "json", "--out", f"{work}/profiles"])
        assert spark.read.parquet(f"{work}/profiles").count() == td.visits(spark, SF).count()
        assert os.path.isdir(f"{work}/public/event_types_ranked")
        td.purchase_requests(spark, SF).write.parquet(f"{work}/requests")
        main(["intake", "--root", root, "--requests", f"{work}/requests", "--out", f"{work}/in1"])
        assert snapshots.current_version(spark, root) == "000000000001"
        m1 = snapshots.manifest(spark, root, "000000000001")
        assert m1["company"] == [f"{root}/v=000000000000/company"]            # reused
        assert m1["purchase"] == [f"{root}/v=000000000000/purchase",
                                  f"{root}/v=000000000001/purchase"]          # appended
        ids = snapshots.max_ids(spark, root, "000000000001")
        assert ids["purchase"] == spark.read.parquet(*m1["purchase"]).agg(
            {"purchase_id": "max"}).first()[0]
        n_new = spark.read.parquet(f"{work}/in1/new_purchases").count()
        t0 = snapshots.read_snapshot(spark, root, "000000000000")
        t1 = snapshots.read_snapshot(spark, root)
        assert t1.purchase.count() == t0.purchase.count() + n_new
        td.customer_changes(spark, SF).write.parquet(f"{work}/changes")
        main(["apply-changes", "--root", root, "--table", "customer", "--changes",
              f"{work}/changes"])
        m2 = snapshots.manifest(spark, root, snapshots.current_version(spark, root))
        assert m2["purchase"] == m1["purchase"]
        assert m2["customer"] == [f"{root}/v=000000000002/customer"]
        # a second intake batch continues the numbering from the manifest
        main(["intake", "--root", root, "--requests", f"{work}/requests", "--out", f"{work}/in2"])
        p2 = spark.read.parquet(f"{work}/in2/new_purchases")
        assert p2.agg({"purchase_id": "min"}).first()[0] == ids["purchase"] + 1
        main(["compact", "--root", root, "--table", "purchase"])
        m4 = snapshots.manifest(spark, root, snapshots.current_version(spark, root))
        assert len(m4["purchase"]) == 1
        t4 = snapshots.read_snapshot(spark, root)
        assert t4.purchase.count() == t0.purchase.count() + n_new + p2.count()
        # cascades: purchases with their tickets, links with their customers
        doomed = t4.purchase.orderBy("purchase_id").limit(5).collect()
        spark.createDataFrame([(r.purchase_id,) for r in doomed] + [(-7,)], "purchase_id bigint") \
            .write.parquet(f"{work}/gone")
        main(["delete-purchases", "--root", root, "--requests", f"{work}/gone"])
        t5 = snapshots.read_snapshot(spark, root)
        assert t5.purchase.count() == t4.purchase.count() - 5
        assert t5.ticket.count() == t4.ticket.count() - len({r.ticket_id for r in doomed})
        link = t5.cust_of.orderBy("company_id", "customer_id").first()
        spark.createDataFrame([(1, f"{link.company_id},{link.customer_id}"), (2, "no pair")],
                              "seq bigint, pair_text string").write.json(f"{work}/pairs")
        main(["delete-cust-of", "--root", root, "--requests", f"{work}/pairs", "--format", "json"])
        t6 = snapshots.read_snapshot(spark, root)
        assert t6.cust_of.count() == t5.cust_of.count() - 1
        assert t6.customer.count() == t5.customer.count() - 1
        rejects = spark.read.parquet(f"{root}/rejects/v={snapshots.current_version(spark, root)}")
        assert [r.seq for r in rejects.collect()] == [2]
        # forms as text: new keys appended, the others no-ops, bad texts rejected
        td.purchase_forms(spark, SF).write.json(f"{work}/forms")
        main(["insert-forms", "--root", root, "--table", "purchase", "--requests", f"{work}/forms", "--format", "json"])
        now = snapshots.current_version(spark, root)
        t7, t6 = snapshots.read_snapshot(spark, root), snapshots.read_snapshot(spark, root, snapshots.version_name(int(now) - 1))
        want, bad = changes.insert_forms(t6.purchase, td.purchase_forms(spark, SF), TABLE_SCHEMAS["purchase"], "purchase_id")
        assert t7.purchase.exceptAll(want).isEmpty() and want.exceptAll(t7.purchase).isEmpty()
        assert t7.purchase.count() > t6.purchase.count()
        assert sorted(snapshots.manifest(spark, root, now)["purchase"])[:-1] == \
            sorted(snapshots.manifest(spark, root, snapshots.version_name(int(now) - 1))["purchase"])
        got = spark.read.parquet(f"{root}/rejects/v={now}")
        assert got.count() == bad.count() > 0
    finally:
        spark.stop = stop


def test_read_table_follows_manifest(spark):
    import tempfile
    work = tempfile.mkdtemp(prefix="snap-", dir=spark.conf.get("spark.checkpoint.dir"))
    t = td.load_tables(spark, SF)
    snapshots.write_snapshot(t, work, snapshots.version_name(0))
    more = t.with_table("purchase", t.purchase.limit(3))
    snapshots.write_snapshot(more, work, snapshots.version_name(1),
                             reuse={n: snapshots.manifest(spark, work, "000000000000")[n]
                                    for n in t.names() if n != "purchase"},
                             append={"purchase": snapshots.manifest(spark, work,
                                                                    "000000000000")["purchase"]})
    n0 = snapshots.read_table(spark, work, "000000000000", "purchase").count()
    assert snapshots.read_table(spark, work, "000000000001", "purchase").count() == n0 + 3
    assert snapshots.current_version(spark, work) == "000000000001"
