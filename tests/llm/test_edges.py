"""Stages on ids and columns of other kinds, and on very short benchmark items."""

from pyspark.sql import functions as F

from marquee.llm import decontamination as dec
from marquee.llm import simhash

BENCH = "item_id long, text string"


def test_short_items_are_reported_but_drop_nothing(spark, make_docs):
    docs = make_docs([(1, "the first ordinary text of the day"), (2, "of the old"), (3, "name the four moons of it, please do"), (4, None)],
                     extra=True)
    bench = spark.createDataFrame([(1, "the"), (2, "of the"), (3, "Name the four moons"), (4, ""), (5, None)], BENCH)
    assert {(r.doc_id, r.item_id) for r in dec.report(docs, bench).collect()} == {(1, 1), (2, 1), (3, 1), (1, 2), (2, 2), (3, 3)}
    kept = dec.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert sorted(r.doc_id for r in dec.clean(docs, bench, least_words=2).collect()) == [4]


def test_text_ids(spark, make_docs):
    words = " ".join(f"word{i}" for i in range(60))
    docs = make_docs([(1, words), (2, words), (3, "Name the four moons of it"), (4, "quite another text " + words[::-1])]) \
        .withColumn("doc_id", F.concat(F.lit("a"), "doc_id"))
    bench = spark.createDataFrame([(3, "Name the four moons")], BENCH)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == ["a1", "a3", "a4"]
    assert sorted(r.doc_id for r in dec.clean(docs, bench).collect()) == ["a1", "a2", "a4"]
    assert [r.doc_id for r in dec.report(docs, bench).collect()] == ["a3"]
