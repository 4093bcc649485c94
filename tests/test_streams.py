"""Streams equal batches; replayed micro-batches are idempotent."""

import os
import tempfile

from pyspark.sql import functions as F

from marquee import schemas as S
from marquee.operators import changes as ch
from marquee.operators import intake
from marquee.sources import snapshots
from marquee.sources import testdata as td
from marquee.streaming import streams

SF = "/root/testdata/sf0.01"


def _work(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="stream-test-", dir=base)


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_intake_stream_in_ordered_batches_equals_batch(spark):
    work = _work(spark)
    in_dir, root, ckpt = f"{work}/in", f"{work}/store", f"{work}/ckpt"
    requests = td.purchase_requests(spark, SF)
    # three request files written in request order -> three micro-batches
    cuts = requests.approxQuantile("request_id", [1 / 3, 2 / 3], 0.0)
    bounds = [(None, cuts[0]), (cuts[0], cuts[1]), (cuts[1], None)]
    for i, (lo, hi) in enumerate(bounds):
        part = requests
        if lo is not None:
            part = part.where(F.col("request_id") > lo)
        if hi is not None:
            part = part.where(F.col("request_id") <= hi)
        part.coalesce(1).write.parquet(f"{in_dir}/part{i}")
        os.utime(f"{in_dir}/part{i}", None)
    t = td.load_tables(spark, SF)
    snapshots.write_snapshot(t, root, streams.BASE_VERSION, publish=False)
    q = streams.purchase_intake_stream(spark, f"{in_dir}/*", root, ckpt, max_files_per_trigger=1)
    q.awaitTermination()
    batch = intake.purchase_intake(requests, snapshots.read_snapshot(spark, root, streams.BASE_VERSION))
    assert same(streams.read_deltas(spark, root, "purchase"), batch.new_purchases)
    assert same(streams.read_deltas(spark, root, "customer"), batch.new_customers)
    assert same(streams.read_deltas(spark, root, "ticket"), batch.new_tickets)
    assert same(streams.read_deltas(spark, root, "cust_of"), batch.new_cust_of)
    # replaying the last micro-batch rewrites its own slice only: same state
    last = spark.read.schema(S.PURCHASE_REQUEST).parquet(f"{in_dir}/part2")
    before = streams.read_deltas(spark, root, "purchase").count()
    n_batches = len(q.recentProgress) and max(p["batchId"] for p in q.recentProgress)
    streams.run_intake_batch(last, n_batches, root)
    assert streams.read_deltas(spark, root, "purchase").count() == before
    assert same(streams.read_deltas(spark, root, "purchase"), batch.new_purchases)


def test_changes_stream_equals_batch_fold_and_skips_replay(spark):
    work = _work(spark)
    in_dir, root, ckpt = f"{work}/in", f"{work}/store", f"{work}/ckpt"
    log = td.customer_changes(spark, SF)
    cut = log.approxQuantile("seq", [0.5], 0.0)[0]
    log.where(F.col("seq") <= cut).write.parquet(f"{in_dir}/a")
    log.where(F.col("seq") > cut).write.parquet(f"{in_dir}/b")
    customer = td.customer(spark, SF)
    streams.init_change_table(customer, root, "customer")
    q = streams.table_changes_stream(spark, f"{in_dir}/*", root, "customer", ckpt)
    q.awaitTermination()
    folded, _ = ch.apply_changes(customer, log, schema=S.CUSTOMER)
    result = streams.read_change_table(spark, root, "customer")
    assert same(result, folded)
    last_id = max(p["batchId"] for p in q.recentProgress)
    streams.run_change_batch(log.where(F.col("seq") > cut), last_id, root, "customer")
    assert same(streams.read_change_table(spark, root, "customer"), folded)


def test_intake_stream_reads_json_form_posts(spark):
    work = _work(spark)
    in_dir, root, ckpt = f"{work}/in", f"{work}/store", f"{work}/ckpt"
    requests = td.purchase_requests(spark, "/root/testdata/sf0.001")
    # form posts as JSON lines, time stamps with microseconds
    requests.write.option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(in_dir)
    t = td.load_tables(spark, "/root/testdata/sf0.001")
    snapshots.write_snapshot(t, root, streams.BASE_VERSION, publish=False)
    streams.purchase_intake_stream(spark, in_dir, root, ckpt, fmt="json").awaitTermination()
    batch = intake.purchase_intake(requests, snapshots.read_snapshot(spark, root,
                                                                     streams.BASE_VERSION))
    assert same(streams.read_deltas(spark, root, "purchase"), batch.new_purchases)
