import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from harness import compare, duck
from marquee.llm import substrings
from marquee.llm.common import table
from marquee.session import scratch_dir


def brute(rows, window):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in docs:
        for s in range(len(words) - window + 1):
            key = tuple(words[s:s + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in docs:
        gone = set()
        for s in range(len(words) - window + 1):
            if i is not None and first[tuple(words[s:s + window])] < i:
                gone.update(range(s, s + window))
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out.append((i, len(words), len(gone), kept))
    return sorted(out, key=str)


def run(docs, **more):
    return sorted((tuple(r) for r in substrings.removed(docs, **more).collect()), key=str)


def test_given_table(spark):
    d = "/root/testdata/sf0.01"
    ok, what = compare(substrings.report(table(spark, d, "documents")), duck(d), substrings.ORACLE)
    assert ok, what


def test_cover():
    assert substrings.is_cover(substrings.COVER, substrings.PERIOD)
    assert not substrings.is_cover((0, 1, 3), 13)


@pytest.mark.parametrize("window,period,cover", [(50, 31, substrings.COVER), (8, 7, (0, 1, 3)), (20, 13, (0, 1, 3, 9))])
def test_brute_force_on_shared_passages(make_docs, window, period, cover):
    """Passages just under, at and over the window length, at all places, within and across documents; a hot one."""
    draw = random.Random(window)
    fresh = iter(range(10**9))
    passages = [[f"p{k}w{i}" for i in range(window + extra)] for k, extra in enumerate((-1, 0, 1, 5, 30, 0))]

    def text(i):
        words = [f"u{next(fresh)}" for _ in range(draw.randrange(40))]
        for _ in range(draw.randrange(3)):
            words += draw.choice(passages) + [f"u{next(fresh)}" for _ in range(draw.randrange(25))]
        if i % 3 == 0:
            words += passages[1]
        return draw.choice((" ", "\n", "\t ")).join(words)

    rows = [(i, text(i)) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(0, 60, 4)] + [(300, " ".join(passages[4] * 3))]
    draw.shuffle(rows)
    assert run(make_docs(rows), window=window, period=period, cover=cover) == brute(rows, window)


def test_bundles_and_ranges(make_docs, monkeypatch):
    """Small bundles and several hash ranges give the same rows."""
    monkeypatch.setattr(substrings, "RANGE_WORDS", 1_000)
    draw = random.Random(1)
    passages = [" ".join(f"p{k}w{i}" for i in range(60)) for k in range(5)]
    rows = [(i, f"start{i} " + " ".join(draw.sample(passages, 2)) + f" end{i}") for i in range(120)]
    assert run(make_docs(rows).repartition(16)) == brute(rows, 50)


def test_few_different_words(make_docs):
    """Runs of one word and short cycles: every window repeats within the text."""
    rows = [(1, "a " * 70), (2, "a " * 49), (3, "a b " * 40), (4, "b a " * 26 + "c"), (5, "a " * 120), (0, "x " * 50 + "a " * 50)]
    assert run(make_docs(rows)) == brute(rows, 50)


def test_hard_rows(make_docs, hard_rows):
    rows = [*hard_rows, (9, hard_rows[3][1]), (None, hard_rows[3][1]), (11, "   " + "w " * 60), (4, "tail " * 60),
            (4, "tail " * 60), (12, "tail " * 61)]
    docs = make_docs(rows, extra=True)
    for c in ("words", "first", "rep", "sha", "kept", "g", "low", "high", "marks", "starts"):
        docs = docs.withColumn(c, F.lit(1))
    assert run(docs) == brute(rows, 50)


def test_empty_table_and_bad_cover(make_docs):
    assert run(make_docs([])) == []
    with pytest.raises(ValueError):
        substrings.removed(make_docs([]), period=13, cover=(0, 1, 3))


def test_ids_of_the_whole_range_across_bundles(make_docs, monkeypatch):
    """The smallest id of a window is sent as a distance from others, whatever their sign."""
    monkeypatch.setattr(substrings, "RANGE_WORDS", 500)
    passages = [" ".join(f"p{k}w{i}" for i in range(70)) for k in range(6)]
    ids = [-2**63, 2**63 - 1, 0, -1, 255, 256, 70_000, 2**32, 2**40, -2**33, 7, 2**63 - 2]
    rows = [(i, f"{passages[n % 6]} own{n} {passages[(n * 5 + 1) % 6]}") for n, i in enumerate(ids)] * 2
    assert run(make_docs(rows).repartition(7)) == brute(rows, 50)


def test_disk_per_shared_word(spark, make_docs):
    """Half of the words stand in two bundles. Answers are bits, a window's id is sent
    once and texts are dealt once: shuffled and stored bytes stay near the words' own."""
    def files():
        local = [d.getPath() for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
        found = [p for d in local for p in Path(d).glob("*/shuffle_*.data")]
        found += Path(scratch_dir(spark, "substrings-x").removeprefix("file:")).parent.glob("substrings-*/*/*.parquet")
        return {p: p.stat().st_size for p in found}

    draw = random.Random(3)
    shared = [" ".join(f"{draw.randrange(10**6):06}" for _ in range(2_000)) for _ in range(40)]
    rows = [(i, f"{shared[i % 40]} " + " ".join(f"{draw.randrange(10**6):06}" for _ in range(2_000))) for i in range(80)]
    docs = make_docs(rows).repartitionByRange(2, "doc_id").localCheckpoint()
    before = files()
    assert sum(r[2] for r in run(docs)) >= 40 * 2_000
    bytes_per_word = sum(n for p, n in files().items() if p not in before) / (80 * 4_000)
    assert 4 < bytes_per_word < 20  # 31 with 64-bit answers, ids sent twice and texts dealt twice
