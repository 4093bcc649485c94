import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harness import compare, duck
from marquee.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k=5, share=(80, 100)):
    kept = {}
    for vec_id, x, label in rows:
        if label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v = tuple(math.floor(max(-2.0**28, min(2.0**28, 256 * float(np.float32(c))))) for c in x)
            kept[(vec_id, label, v)] = None

    def order(f):
        return (-f[0], f[1] is None, f[1] or 0)

    out = []
    for a in kept:
        if a[0] is None or a[0] % every:
            continue
        scored = [(sum(p * q for p, q in zip(a[2], b[2])), b[0], b) for b in kept if b != a]
        for score, pos, _ in sorted((f for f in scored if f[2][1] == a[1]), key=order)[:k]:
            fits = [f for f in scored if f[2][1] != a[1] and share[0] * score <= share[1] * f[0] <= share[1] * score]
            out += [(a[0], pos, i + 1, f[1], score, f[0]) for i, f in enumerate(sorted(fits, key=order)[:k])]
    return sorted(out, key=str)


def mined(spark, rows, every, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("shard", "block", "v", "uid", "a", "w", "rank", "score", "scores", "home", "p"):
        df = df.withColumn(c, F.lit("x"))
    return sorted((tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, **more).collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables(spark, sf):
    d = f"/root/testdata/{sf}"
    ok, what = compare(negatives.report(spark, d), duck(d), negatives.ORACLE)
    assert ok, what


def test_ties_hot_vectors_and_labels(spark, monkeypatch):
    """A third of the rows share one vector, half one label; coordinates are few, so scores tie."""
    monkeypatch.setattr(negatives, "SMALL_SHARD", 40)
    draw = random.Random(4)
    rows = [(i, [0.5, 0.25, 0.0] if i % 3 == 0 else [draw.choice((-0.5, 0.0, 0.25, 0.5)) for _ in range(3)],
             0 if i % 2 else draw.randrange(4)) for i in range(600)]
    assert mined(spark, rows, 20) == brute(rows, 20)
    assert mined(spark, rows, 50, positives=2, negatives=9, share=(50, 100)) == [
        r for r in brute_k(rows, 50, 2, 9, (50, 100))]


def brute_k(rows, every, positives, negatives_k, share):
    kept = [(i, tuple(math.floor(256 * c) for c in x), label) for i, x, label in rows]
    out = []
    for a in kept:
        if a[0] % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a[1], b[1])), b[0], b[2]) for b in kept if b[0] != a[0])
        for s, pos, _ in [f for f in scored if f[2] == a[2]][:positives]:
            fits = [f for f in scored if f[2] != a[2] and share[0] * -s <= share[1] * -f[0] <= share[1] * -s][:negatives_k]
            out += [(a[0], pos, i + 1, f[1], -s, -f[0]) for i, f in enumerate(fits)]
    return sorted(out, key=str)


def test_hard_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (3, [0.9, 0.5], 2), (4, None, 1),
            (5, [1.0, None], 1), (6, [float("nan"), 1.0], 2), (7, [float("inf"), 1.0], 2), (8, [0.9, 0.4], None), (9, [], 2),
            (10, [0.5], 2), (12, [1.0, 0.5, 0.0], 1), (20, [3e37, -1.0], 2), (21, [3e37, 0.0], 1), (30, [2.0**19, 2.0**19], 3)]
    padded = [(i, x if x is None else (x + [0.0] * 3)[:3], label) for i, x, label in rows]
    padded = [r for r in padded if r[0] != 12] + [(12, [1.0, 0.5, 0.0], 1)]
    got = mined(spark, rows, 10)
    assert got == brute(padded, 10)
    assert {r[0] for r in got} == {0, 10}


def test_null_ids_come_last_and_repeated_ids_stay_apart(spark):
    rows = [(0, [1.0], 1), (2, [1.0], 1), (None, [0.9], 2), (7, [0.9], 2), (7, [0.9, 0.1], 2), (3, [0.85], 3)]
    got = [r[3] for r in mined(spark, rows, 10, negatives=9)]
    assert sorted(got[:4], key=str) == sorted([7, 7, None, 3], key=str)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)], 10) == []


def test_boxes_are_dropped():
    """Clustered rows: the queue opens a part of the leaves only, and finds the same rows."""
    draw = np.random.default_rng(5)
    centres = draw.integers(-200, 200, (40, 8))
    v = (centres[draw.integers(0, 40, 20_000)] + draw.integers(-4, 5, (20_000, 8))).astype(np.float64)
    labels, ids = draw.integers(0, 3, 20_000), np.arange(20_000)
    tree = negatives.Tree(ids, ids + 0, labels, v)
    opened = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                opened.append(key)
            return super().__getitem__(key)

    tree.v = tree.v.view(Counted)
    q = v[:20]
    down, up = tree.intervals(q)
    for i in range(20):
        best = tree.search(q[i], down[i], up[i], int(labels[i]), i, [(-math.inf, math.inf)], 5, True)[0]
        scores = v @ q[i]
        expected = sorted((-s, j) for j, s in enumerate(scores.tolist()) if labels[j] == labels[i] and j != i)[:5]
        assert [(s, j) for s, j, *_ in best] == expected
    assert len(opened) < 20 * tree.leaves / 4
