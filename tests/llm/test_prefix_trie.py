import hashlib
import random
import zlib

import pytest

from harness import compare, duck
from marquee.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, part string, turns string, ref string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(int(c / 5) * 5, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {p: 0 for p in members}, {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), kids.get(p, 0), leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p)).encode()).hexdigest())
                   for p, who in members.items()), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.nodes(prefix_trie.rebuilt(df), **more).collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables(spark, sf):
    d = f"/root/testdata/{sf}"
    ok, what = compare(prefix_trie.report(spark, d), duck(d), prefix_trie.ORACLE)
    assert ok, what


@pytest.mark.parametrize("cells", [1, 7, 60, 2_000_000])
def test_brute_force_whatever_the_blocks(spark, cells):
    """Two words for texts, so that most prefixes are shared and span blocks and partitions; a hot conversation."""
    draw = random.Random(cells)
    rows = []
    for c in range(300):
        if c % 3 == 0:
            turns = [("user", "hot"), ("assistant", "é hot")]
        else:
            turns = [(draw.choice(("user", "assistant")), draw.choice(("a", "bb"))) for _ in range(draw.randrange(1, 14))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    assert run(spark, rows, cells=cells) == brute(rebuilt(rows))


def test_hard_rows(spark):
    long = [(40, i, "user", f"turn {i % 7}") for i in range(150)]
    rows = [(0, 1, "user", "b"), (0, None, "user", "a"), (0, 0, None, None), (0, 2, "", ""), (None, 0, "user", "a"), (-7, 0, "user", "a"),
            (-7, 1, "user", "x" * 100_000), (-5, 0, "user", "a"), (3, 0, "us", "era"), (8, 0, "user", "a"), (8, 0, "user", "a"), *long]
    assert run(spark, rows, cells=500) == brute(rebuilt(rows))


def test_empty_table(spark):
    assert run(spark, []) == []
