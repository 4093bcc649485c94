import __spark_entry__ as entry_mod


def test_entry_runs_with_stable_schema(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["EventType", "TotalTicketsSold"]
    rows = df.collect()
    assert len(rows) > 0
    assert entry_mod.entry(spark).schema == df.schema
