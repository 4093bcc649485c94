"""Fingerprints and components against all-pairs brute force."""

import random
import re

import numpy as np
import xxhash
from marquee.llm import simhash


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints):
    """prints: fingerprint -> ids."""
    keys = np.array(sorted(prints), dtype=np.uint64)
    parent = list(range(len(keys)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(keys ^ keys[i]) <= 4):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i, k in enumerate(keys.tolist()):
        groups.setdefault(find(i), []).extend(prints[k])
    return {d: min(x for x in g if x is not None) if any(x is not None for x in g) else None for g in groups.values() for d in g}


def check(rows, got):
    prints = {}
    for i, t in rows:
        prints.setdefault(slow_fingerprint(t), []).append(i)
    expected = slow_components(prints)
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, set()).add(f"{slow_fingerprint(t):016x}")
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint in by_id[r.doc_id]
        assert r.component_id == expected[r.doc_id], r


def test_hard_rows(make_docs, hard_rows):
    check(hard_rows, simhash.report(make_docs(hard_rows, extra=True)).collect())
    assert simhash.report(make_docs([])).count() == 0


def test_clusters_of_near_copies(make_docs):
    """Copies edited in place, chains of edits, and one cluster holding a third of all rows."""
    rnd, rows = random.Random(3), []
    vocabulary = [f"w{i}" for i in range(3000)]
    for c in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 160))]
        for _ in range(60 if c == 0 else rnd.randint(1, 6)):
            edited = list(base)
            for _ in range(rnd.randint(0, 2)):
                edited[rnd.randrange(len(edited))] = rnd.choice(vocabulary)
            if rnd.random() < 0.4:
                base = edited
            rows.append((len(rows), " ".join(edited)))
    rnd.shuffle(rows)
    check(rows, simhash.report(make_docs(rows)).collect())


def test_links_of_dense_fingerprints(spark):
    """Direct fingerprints around few centres: every pivot path is taken."""
    rnd, values = random.Random(5), set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(70):
            f = centre
            for b in rnd.sample(range(64), rnd.randint(0, 7)):
                f ^= 1 << b
            values.add(f)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v, rnd.randint(1, 5)) for v in signed], "fp bigint, n bigint")
    for pivots in (0, 3, 32):
        root = {r.node: r.root for r in simhash.components(simhash.links(prints, pivots=pivots) if pivots else
                                                           simhash.links(prints, pivots=1)).collect()}
        of = slow_components({v: [v] for v in values})
        got = {}
        for v, s in zip(values, signed, strict=True):
            got.setdefault(root.get(s, s), set()).add(v)
        expected = {}
        for v in values:
            expected.setdefault(of[v], set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(901, 900)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 901: 900}


def test_keep_one(make_docs, hard_rows):
    docs = make_docs(hard_rows, extra=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "None", "7", "8"])


def test_keep_one_by_component_not_by_id(make_docs):
    rows = [(None, "A first text without a number that is about the sea and its tides."),
            (None, "Quite another matter: seven recipes for bread, none of them with yeast."),
            (7, "One of two unrelated texts whose rows share a number, on railways."),
            (7, "The other one of them tells of an orchard, its owner and a dry summer."),
            (None, "A pair of equal texts, one of which has no number at all here."),
            (3, "A pair of equal texts, one of which has no number at all here.")]
    kept = simhash.keep_one(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in [*rows[:4], rows[5]])
