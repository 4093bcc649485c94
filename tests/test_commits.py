"""Commits on the base version, streams told apart, marks merged on read,
cascades over several tables, long chains of key changes."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from marquee import schemas as S
from marquee.operators import changes as ch
from marquee.sources import snapshots
from marquee.sources import testdata as td
from marquee.streaming import streams

SF = "/root/testdata/sf0.001"
V0, V1, V2 = (snapshots.version_name(n) for n in range(3))


def _work(spark):
    return tempfile.mkdtemp(prefix="commits-", dir=spark.conf.get("spark.checkpoint.dir"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    t = td.load_tables(spark, SF, persist=True)
    yield t
    t.release()


@pytest.fixture
def root(spark, tables):
    path = f"{_work(spark)}/store"
    snapshots.write_snapshot(tables, path, V0, parallelism=4)
    return path


def test_two_jobs_from_one_version(spark, root):
    base = snapshots.read_snapshot(spark, root, V0)
    fewer = base.company.where("ID <> 1")
    edited = base.distributer.withColumn("name", F.lit("x"))
    assert snapshots.commit(spark, root, V0, rewrite={"company": fewer}) == V1
    # another table: on top of the first; both changes are there
    assert snapshots.commit(spark, root, V0, rewrite={"distributer": edited}) == V2
    now = snapshots.read_snapshot(spark, root)
    assert now.company.where("ID = 1").isEmpty() and now.distributer.where("name <> 'x'").isEmpty()
    # the same table, or one it was computed from: refused, nothing published
    with pytest.raises(snapshots.VersionClash):
        snapshots.commit(spark, root, V0, rewrite={"company": base.company})
    with pytest.raises(snapshots.VersionClash):
        snapshots.commit(spark, root, V1, append={"cust_of": base.cust_of.limit(0)}, reads={"distributer"})
    assert snapshots.current_version(spark, root) == V2
    # a version that is taken cannot be put in place again, and its manifest stays
    with pytest.raises(snapshots.VersionClash):
        snapshots.publish_version(spark, root, V2, {"company": ["nowhere"]})
    assert snapshots.read_snapshot(spark, root).company.where("ID = 1").isEmpty()


def test_rejects_are_listed_by_the_version(spark, root, tables):
    bad = spark.createDataFrame([(7, "why")], streams.CHANGE_REJECTS)
    snapshots.commit(spark, root, V0, rewrite={"company": tables.company}, rejects=bad)
    assert rows(snapshots.read_rejects(spark, root, streams.CHANGE_REJECTS)) == [(7, "why")]


def test_marks_are_merged_by_age(spark, root, tables):
    """Marks over rows, rows appended after a mark, marks over marks, a deleted and revived key."""
    pair = tables.cust_of.orderBy("company_id", "customer_id").first()
    dead = spark.createDataFrame([(*pair, False), (-1, -1, False)], snapshots.marks_schema("cust_of"))
    n = tables.cust_of.count()

    def linked():
        return snapshots.read_snapshot(spark, root).cust_of

    v = snapshots.commit(spark, root, V0, marks={"cust_of": dead})
    assert linked().count() == n - 1
    v = snapshots.commit(spark, root, v, append={"cust_of": spark.createDataFrame([pair, (-5, -5)], S.CUST_OF)})
    assert linked().count() == n + 1 and linked().where("company_id = -5").count() == 1
    v = snapshots.commit(spark, root, v, marks={"cust_of": spark.createDataFrame([(-5, -5, False), (-6, -6, True)],
                                                                                snapshots.marks_schema("cust_of"))})
    before = rows(linked())
    assert linked().where("company_id = -5").isEmpty() and linked().where("company_id = -6").count() == 1
    streams.compact(spark, root, "cust_of")
    assert rows(linked()) == before
    assert {f.kind for f in snapshots.folders(spark, root, snapshots.current_version(spark, root)) if f.table == "cust_of"} == {"rows"}


def test_marks_count_for_new_ids(spark, root):
    top = snapshots.max_ids(spark, root, V0)["customer"]
    mark = spark.createDataFrame([(top + 100, "a", "b", "c", "d", True)], snapshots.marks_schema("customer"))
    v = snapshots.commit(spark, root, V0, marks={"customer": mark})
    assert snapshots.max_ids(spark, root, v)["customer"] == top + 100


def test_second_checkpoint_goes_on_after_the_first(spark, tables):
    """The same store, two checkpoints with other requests: all purchases are kept; restarts add nothing."""
    work = _work(spark)
    root = f"{work}/store"
    snapshots.write_snapshot(tables, root, V0, publish=False)
    requests = td.purchase_requests(spark, SF)
    cut = requests.approxQuantile("request_id", [0.5], 0.0)[0]
    requests.where(F.col("request_id") <= cut).write.parquet(f"{work}/a")
    requests.where(F.col("request_id") > cut).write.parquet(f"{work}/b")

    def run(part, ckpt):
        streams.purchase_intake_stream(spark, f"{work}/{part}", root, f"{work}/{ckpt}").awaitTermination()
        return {r[0] for r in streams.read_deltas(spark, root, "purchase").select("purchase_id").collect()}

    first = run("a", "ckpt1")
    both = run("b", "ckpt2")
    assert first and first < both
    assert run("a", "ckpt1") == both
    # the lost checkpoint: the same files arrive as a new stream, and are booked again rather than over the old ones
    assert run("a", "ckpt3") > both
    ids = [r[0] for r in snapshots.read_snapshot(spark, root).purchase.select("purchase_id").collect()]
    assert len(ids) == len(set(ids))


def test_change_stream_with_a_new_checkpoint_is_not_skipped(spark):
    work = _work(spark)
    streams.init_change_table(td.company(spark, SF), work, "company")
    schema = S.change_schema(S.COMPANY)

    def run(name, ckpt, log):
        spark.createDataFrame(log, schema).write.mode("append").parquet(f"{work}/{name}")
        streams.table_changes_stream(spark, f"{work}/{name}", work, "company", f"{work}/{ckpt}").awaitTermination()
        return {r.ID: r.name for r in streams.read_change_table(spark, work, "company").collect()}

    run("in1", "c1", [(1, "update", 1, "name", "one", None)])
    run("in1", "c1", [(2, "delete", 2, None, None, None)])
    got = run("in2", "c2", [(1, "update", 3, "name", "three", None), (2, "insert", 900, None, None, (900, "new", "L"))])
    assert got[1] == "one" and 2 not in got and got[3] == "three" and got[900] == "new"
    # a batch writes touched rows only
    listed = snapshots.folders(spark, f"{work}/company", snapshots.current_version(spark, f"{work}/company"))
    marks = [f for f in listed if f.kind == snapshots.MARKS]
    assert len(marks) == 3
    assert sorted(spark.read.parquet(f.path).count() for f in marks) == [1, 1, 2]


def test_change_marks_equal_the_fold(spark, monkeypatch):
    customer, log = td.customer(spark, SF), td.customer_key_changes(spark, SF)
    marks, rejects = ch.change_marks(customer, log, schema=S.CUSTOMER)
    out, bad = ch.apply_changes(customer, log, schema=S.CUSTOMER)
    marks = marks.persist()
    merged = customer.join(marks, "ID", "left_anti").unionByName(marks.where("_alive").drop("_alive"))
    assert rows(merged) == rows(out) and rows(rejects) == rows(bad)
    marks.unpersist()


def _model(live, moves):
    at, failed = {k: k for k in live}, []
    for seq, old, new in sorted(moves):
        if old in at and old != new:
            if new in at:
                failed.append(seq)
            else:
                at[new] = at.pop(old)
    return at, failed


@pytest.mark.parametrize("replayed", [1_000_000, 7, 1])
def test_renames_whatever_the_pass_holds(spark, monkeypatch, replayed):
    monkeypatch.setattr(ch, "REPLAYED", replayed)
    draw = random.Random(replayed)
    live = list(range(12))
    moves = [(i, draw.randrange(16), draw.randrange(16)) for i in range(25)]
    out, rejects = ch.rename_keys(spark.createDataFrame([(k, f"r{k}", "L") for k in live], S.COMPANY),
                                  spark.createDataFrame([(s, o, str(n)) for s, o, n in moves], "seq long, key long, new_value string"))
    at, failed = _model(live, moves)
    assert {r.ID: r.name for r in out.collect()} == {k: f"r{v}" for k, v in at.items()}
    assert sorted(r.seq for r in rejects.collect()) == failed


def test_a_chain_of_ten_thousand_takes_few_jobs(spark):
    """One key renamed along 5,000 keys, another to and fro 5,000 times."""
    moves = [(2 * i, 100_000 + i, 100_001 + i) for i in range(5_000)]
    moves += [(2 * i + 1, 1 + i % 2, 2 - i % 2) for i in range(5_000)]
    snap = spark.createDataFrame([(100_000, "chain", "L"), (1, "fro", "L")], S.COMPANY)
    log = spark.createDataFrame([(s, "update", o, "ID", str(n), None) for s, o, n in moves]
                                + [(8_999, "update", 100_000 + 4_500, "location", "on the way", None)], S.change_schema(S.COMPANY))
    sc = spark.sparkContext
    for name, run in (("fold", lambda: ch.apply_changes(snap, log, schema=S.COMPANY)[0]),
                      ("renames", lambda: ch.rename_keys(snap, log.where("property = 'ID'"))[0])):
        sc.setJobGroup(name, name)
        got = {r.ID: (r.name, r.location) for r in run().collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup(name))
        assert got == {105_000: ("chain", "on the way" if name == "fold" else "L"), 1: ("fro", "L")}
        assert jobs < 40, jobs
    sc.setJobGroup("", "")


def test_rows_without_seq(spark):
    snap = spark.createDataFrame([(1, "a", "L")], S.COMPANY)
    late = spark.createDataFrame([(None, 2, "no seq", "L"), (None, 2, "a no seq", "L"), (None, 3, "z", "L"), (5, 3, "first", "L"),
                                  (None, 1, "live", "L")], "seq long, ID long, name string, location string")
    assert rows(ch.insert_rows(snap, late)) == [(1, "a", "L"), (2, "a no seq", "L"), (3, "first", "L")]
    log = spark.createDataFrame([(None, "delete", 1, None, None, None), (None, "insert", 9, None, None, (9, "n", "L")),
                                 (None, "update", 1, "ID", "4", None), (3, "update", 1, "name", "b", None)], S.change_schema(S.COMPANY))
    out, rejects = ch.apply_changes(snap, log, schema=S.COMPANY)
    assert rows(out) == [(1, "b", "L")]
    assert [r.reason for r in rejects.collect()] == [ch.NO_SEQ_ERROR] * 3
    out, rejects = ch.update_property(snap, log.where("op = 'update'"), schema=S.COMPANY)
    assert rows(out) == [(1, "b", "L")] and {r.reason for r in rejects.collect()} == {ch.NO_SEQ_ERROR}


def test_cascades_by_seq(spark, tables):
    """A pair deleted and linked again, one linked and deleted; edits before and after their ticket goes."""
    pair = tables.cust_of.orderBy("company_id", "customer_id").first()
    other = tables.cust_of.orderBy(F.desc("company_id"), F.desc("customer_id")).first()
    bought = tables.purchase.where("ticket_id IS NOT NULL").orderBy("purchase_id").limit(2).collect()
    text = f"{pair.company_id},{pair.customer_id}"
    log = [(1, "delete_pair", None, None, text), (2, "insert_pair", None, None, text),
           (3, "insert_pair", None, None, "-3,-4"), (4, "delete_pair", None, None, "-3,-4"), (5, "insert_pair", None, None, "-8,-9"),
           (6, "delete_pair", None, None, f"{other.company_id},{other.customer_id}"), (7, "delete_pair", None, None, "no pair"),
           (8, "update_ticket", bought[0].ticket_id, "type", "Gone"), (9, "delete_purchase", bought[0].purchase_id, None, None),
           (10, "update_ticket", bought[0].ticket_id, "type", "Late"), (11, "update_ticket", bought[1].ticket_id, "price", "$1,234.50"),
           (12, "update_ticket", bought[1].ticket_id, "price", "dear"), (13, "delete_purchase", -77, None, None),
           (14, "delete_purchase", None, None, None), (15, "drop", 1, None, None), (None, "delete_purchase", bought[1].purchase_id, None, None)]
    marks, rejects = ch.cascade_marks(tables, spark.createDataFrame(log, S.CASCADE_CHANGE))
    got = {name: rows(df) for name, df in marks.items()}
    assert [(r[0], r[-1]) for r in got["purchase"]] == [(bought[0].purchase_id, False)]
    assert sorted((r[0], str(r[4]), r[-1]) for r in got["ticket"]) == sorted(
        [(bought[0].ticket_id, "None", False), (bought[1].ticket_id, "1234.50", True)])
    assert set(got["cust_of"]) == {(*pair, True), (-8, -9, True), (*other, False)}
    assert {(r[0], r[-1]) for r in got["customer"]} <= {(pair.customer_id, False), (other.customer_id, False)}
    assert sorted((r.seq or 0, r.reason) for r in rejects.collect()) == [
        (0, ch.NO_SEQ_ERROR), (7, ch.BAD_PAIR_ERROR), (12, ch.BAD_VALUE_ERROR), (14, ch.NO_KEY_ERROR), (15, "unknown op")]
