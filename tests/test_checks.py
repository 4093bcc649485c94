from marquee.plans import checks
from marquee.sources import testdata as td

SF = "/root/testdata/sf0.01"


def test_mapped_tables_have_unique_keys_and_no_orphans(spark):
    t = td.load_tables(spark, SF)
    assert checks.duplicate_keys(t).count() == 0
    assert {r.link: r.rows for r in checks.orphan_counts(t).collect()} == {
        "purchase.ticket_id": 0, "purchase.customer_id": 0, "ticket.event_id": 0,
        "event.company_id": 0}


def test_duplicate_keys_are_reported(spark):
    from test_reports import make_tables
    t = make_tables(spark, companies=[(1, "a", "x"), (1, "b", "y"), (2, "c", "z")])
    rows = [(r.table, r.key, r.copies) for r in checks.duplicate_keys(t).collect()]
    assert rows == [("company", "1", 2)]


def test_a_snapshot_with_repeated_keys_is_not_published(spark):
    import tempfile

    import pytest

    from marquee.sources import snapshots
    from marquee.sources import testdata as td
    root = tempfile.mkdtemp(prefix="keys-", dir=spark.conf.get("spark.checkpoint.dir"))
    t = td.load_tables(spark, "/root/testdata/sf0.001")
    twice = t.with_table("company", t.company.union(t.company.limit(1)))
    with pytest.raises(ValueError, match="company"):
        snapshots.write_snapshot(twice, root, snapshots.version_name(0), check_keys=True)
    assert not snapshots.any_published(spark, root)
    snapshots.write_snapshot(t, root, snapshots.version_name(1), check_keys=True)
    assert snapshots.current_version(spark, root) == snapshots.version_name(1)
    with pytest.raises(FileNotFoundError):
        snapshots.manifest(spark, root, snapshots.version_name(0))
