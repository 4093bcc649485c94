"""SimHash near-duplicates by pivot distance tables.

Fingerprints: lower-case A-Z, words, word shingles (repeats included), XXH64
of each (UTF-8, seed 42); a bit is set where more than half of the hashes have
it. Fewer words than a shingle give the whole sequence, no words fingerprint 0.

Links: two fingerprints at ``max_bits`` or fewer differing bits. All work is
on distinct fingerprints, so exact copies cost nothing.

* Blocks: 64 bits in ``max_bits + 2`` blocks. At most ``max_bits`` of them
  differ, so some pair of blocks is equal in both fingerprints: candidates come
  from equality joins on every pair of blocks, and no link can be missed.
* Pivots: up to ``pivots`` reference fingerprints, pairwise further apart than
  ``max_bits``, taken from the densest blocks. Each fingerprint carries its
  distances to all of them. A candidate pair whose distances to some pivot
  differ by more than ``max_bits`` cannot be a link (triangle inequality) and
  is discarded; the bit count verifies the survivors.
* Dense groups: a fingerprint within ``max_bits`` of a pivot links to it at
  once. Two such fingerprints of one pivot are already connected and are never
  paired; of two pivots they are paired only if the pivots are near enough.

Components: minimum-neighbour contraction with pointer jumping; every round's
tables are stored in the shared folder.

Null texts count as empty (fingerprint 0); null ids never name a component
unless all its ids are null; repeated rows give repeated result rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_, or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import free_names, row_key, stored, text_pass

SHINGLE_WORDS = 4
MAX_BITS = 4
PIVOTS = 32

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash
    # bytes.split() parts at exactly the six white-space bytes of the word rule
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-shingle] + 1))
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist(), strict=True)]
    set_bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[i:i + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, columns: list[str], shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``columns`` and ``fp``: the fingerprint's 64 bits as a signed long."""
    def start():
        def one(text: str | None) -> tuple[int]:
            f = fingerprint(text, shingle)
            return (f - (1 << 64) if f >> 63 else f,)
        return one
    return text_pass(docs, T.StructType([T.StructField("fp", T.LongType())]), start, columns)


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def block_pairs(max_bits: int) -> list[int]:
    """Bit masks of all pairs of ``max_bits + 2`` near-equal blocks."""
    n = max_bits + 2
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x | y for x, y in combinations(masks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bits_apart(a: int, b: int) -> int:
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def choose_pivots(prints: DataFrame, max_bits: int, pivots: int) -> list[int]:
    """Reference fingerprints: the commonest one of each of the densest block
    buckets, then the commonest ones at all, skipping any near an earlier one.
    Only a bounded list reaches the driver."""
    masks = block_pairs(max_bits)
    n = max_bits + 2
    disjoint = [i for i, (a, b) in enumerate(combinations(range(n), 2)) if b == a + 1 and a % 2 == 0]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(masks[i]))).alias("key"))
                     for i in disjoint])
    dense = (prints.select("fp", "n", F.explode(keys).alias("b")).groupBy("b")
             .agg(F.count("*").alias("size"), F.max(F.struct("n", "fp")).alias("top"))
             .select("size", F.col("top.fp").alias("fp"), F.col("top.n").alias("n"))
             .orderBy(F.desc("size"), F.desc("n"), "fp").limit(8 * pivots))
    common = prints.select(F.lit(0).cast("bigint").alias("size"), "fp", "n").orderBy(F.desc("n"), "fp").limit(pivots)
    chosen: list[int] = []
    for part in (dense, common):
        for r in part.collect():
            if len(chosen) < pivots and all(_bits_apart(r.fp, p) > max_bits for p in chosen):
                chosen.append(r.fp)
    return chosen


def links(prints: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS) -> DataFrame:
    """Pairs (a > b) of distinct fingerprints whose components are those of the
    full link graph. ``prints``: distinct ``fp`` with its row count ``n``."""
    refs = choose_pivots(prints, max_bits, pivots)
    if not refs:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    at = [distance(F.col("fp"), F.lit(p)) for p in refs]
    # the first pivot within reach; -1 where there is none
    cover = F.coalesce(*[F.when(d <= max_bits, F.lit(i)) for i, d in enumerate(at)], F.lit(-1))
    masks = block_pairs(max_bits)
    tabled = stored(prints.select("fp", F.array(*[d.cast("tinyint") for d in at]).alias("row"), cover.alias("cover")),
                    "pivot-table")
    to_pivot = (tabled.where("cover >= 0")
                .select("fp", F.element_at(F.array(*map(F.lit, refs)), F.col("cover") + 1).alias("ref"))
                .where("fp <> ref").select(F.greatest("fp", "ref").alias("a"), F.least("fp", "ref").alias("b")))
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                     for i, m in enumerate(masks)])
    keyed = tabled.select("fp", "row", "cover", F.explode(keys).alias("k")).select("fp", "row", "cover", "k.t", "k.key")
    x, y = keyed.alias("x"), keyed.alias("y")
    same = [F.col("x.t") == F.col("y.t"), F.col("x.key") == F.col("y.key")]
    near = [F.abs(F.col("x.row")[i] - F.col("y.row")[i]) <= max_bits for i in range(len(refs))]
    near.append(distance(F.col("x.fp"), F.col("y.fp")) <= max_bits)
    pair = [F.greatest("x.fp", "y.fp").alias("a"), F.least("x.fp", "y.fp").alias("b")]
    loose = x.where("x.cover < 0").join(
        y, reduce(and_, [*same, (F.col("y.cover") >= 0) | (F.col("x.fp") < F.col("y.fp")), *near])).select(*pair)
    found = [to_pivot, loose]
    close = [(i, j) for (i, p), (j, q) in combinations(enumerate(refs), 2)
             if _bits_apart(p, q) <= 3 * max_bits]
    if close:  # members of two pivots can only meet if the pivots are near
        other = reduce(or_, [(F.col("x.cover") == i) & (F.col("o") == j) for i, j in close])
        left = x.where("x.cover >= 0").withColumn("o", F.explode(F.array(*[F.lit(j) for j in sorted({j for _, j in close})]))).where(other)
        found.append(left.join(y, reduce(and_, [*same, F.col("o") == F.col("y.cover"), *near])).select(*pair))
    return reduce(DataFrame.union, found).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node`` -> ``root`` (its component's smallest node) for every node of
    ``edges`` (a > b) that is not its own root.

    Each round points every node at its smallest neighbour if that is smaller,
    jumps pointers until they end at roots, and keeps the edges between
    different roots; at most half of a component's nodes survive a round."""
    spark = edges.sparkSession
    edges = stored(edges, name)
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        up = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), name)
        while True:  # pointer jumping: up = up after up
            further = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stored(up.join(further, "root", "left").select(
                "node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), name)
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        maps.append(up)
        ends = edges
        for c in ("a", "b"):
            ends = ends.join(up.select(F.col("node").alias(c), F.col("root").alias("r")), c, "left").withColumn(
                c, F.coalesce("r", c)).drop("r")
        edges = stored(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                       .distinct(), name)
    if not maps:
        return spark.createDataFrame([], "node bigint, root bigint")
    total = maps[-1]
    for earlier in reversed(maps[:-1]):  # a node's root of round k may have moved on in later rounds
        on = total.select(F.col("node").alias("root"), F.col("root").alias("last"))
        total = earlier.join(on, "root", "left").select("node", F.coalesce("last", "root").alias("root")).union(total)
    return total


def near_duplicates(docs: DataFrame, columns: list[Column] = (), shingle: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, pivots: int = PIVOTS) -> DataFrame:
    """Per document: ``doc_id``, ``columns``, ``fp``, ``root`` (the fingerprint
    that names its component) and ``component_id``, the smallest doc_id
    reachable over links."""
    named = docs.select("doc_id", "text", *columns)
    kept = [c for c in named.columns if c != "text"]
    rows = stored(fingerprints(named, kept, shingle), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least_id")), "prints")
    of = components(links(prints, max_bits, pivots))
    rooted = prints.join(of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = stored(rooted.select("fp", "root").join(ids, "root").select("fp", "root", "component_id"), "component-ids")
    return rows.join(by_print, "fp").select(*kept, "fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    d = near_duplicates(docs)
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of each component (one without an id
    only where no row has one); of equal rows, one."""
    plain, names = docs.select("doc_id", "text"), free_names(docs, "row_k1", "row_k2")
    near = near_duplicates(plain, row_key(plain))
    first = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row_k1", "row_k2")
    keep = stored(near.groupBy("root").agg(F.min(first).alias("k"))
                  .select(F.col("k.row_k1").alias(names[0]), F.col("k.row_k2").alias(names[1])), "kept")
    return (docs.select("*", *row_key(docs, names)).join(keep, list(names)).dropDuplicates(list(names))
            .select(*docs.columns))
