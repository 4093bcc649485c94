"""Hard-negative mining with an STR-packed R-tree.

Vectors become integers (``floor(256 x)``), so scores are exact integer inner
products. The rows are cut into shards in sort-tile order (label, slab of the
first coordinate, second coordinate, id), and every shard packs its rows into an
R-tree by sort-tile-recursive: minimum bounding boxes over all coordinates, boxes
of boxes above. For an anchor a box gives the interval in which the inner
products of all its rows lie: per coordinate the better and the worse end. The
search takes boxes from a queue, best upper end first, and drops a box that
misses every score window, or that lies strictly below the kth row found (at the
kth row's score: that holds only larger ids).

Two rounds over the stored shards: the anchors' best rows of the same label
(positives), then, with a window per positive, the best rows of other labels.
Anchors meet the shards in blocks, so that a task holds at most one shard and
one block; per anchor and shard at most k rows a window are returned, and the
best k of them are kept.

Rows with a null label, a null vector, or a null or non-finite component take no
part. Components beyond +-2**20 count as that; missing components of a shorter
(or empty) vector count as 0. Equal rows count once; different rows with one id
are rows of their own, and ties of score and id go by a hash of the row. A null
id comes after all others. A label or vector that very many rows share only
spreads over more shards: the id is part of the sort key. Extra columns are not
read. No rows or no anchors give no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.common import stored, table

SHARD_ROWS, SMALL_SHARD, BLOCK_ANCHORS = 32_768, 512, 4_096
LEAF, FANOUT, TILED = 256, 8, 4
SCALE, LARGEST = 256, float(1 << 28)
INFINITY = math.inf


def points(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v, uid): the rows that take part, as integers."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(INFINITY)))

    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x.cast("double") * SCALE))).cast("bigint")

    return (vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
            .select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
                    F.transform("embedding", whole).alias("v"))
            .distinct().withColumn("uid", F.xxhash64("vec_id", "label", "v")))


def sharded(rows: DataFrame) -> DataFrame:
    """``rows`` in shards of neighbours, stored, with the shard's number."""
    spark = rows.sparkSession
    rows = stored(rows, "negatives-points")
    first = F.coalesce(F.get("v", F.lit(0)), F.lit(0))
    n, cuts = rows.agg(F.count(F.lit(1)), F.percentile_approx(first, [i / 256 for i in range(1, 256)], 4096)).first()
    shards = max(1, -(-n // SHARD_ROWS), min(3 * spark.sparkContext.defaultParallelism, -(-n // SMALL_SHARD)))
    step = max(1, 256 // math.ceil(math.sqrt(shards)))
    cuts = sorted(set((cuts or [])[step - 1::step]))
    slab = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < first)) if cuts else F.lit(0)
    tiled = rows.repartitionByRange(shards, F.col("label"), slab, F.get("v", F.lit(1)), F.col("vec_id"), F.col("uid"))
    return stored(tiled.withColumn("shard", F.spark_partition_id()), "negatives-shards")


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """A list column as a matrix, short rows filled with 0."""
    lists = column.combine_chunks()
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
    sizes, values = np.diff(ends), lists.flatten().to_numpy(zero_copy_only=False)
    width = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def tiles(v: np.ndarray, rows: np.ndarray, axes: list[int]) -> list[np.ndarray]:
    """Sort-tile-recursive packing of ``rows`` into leaves of at most ``LEAF``."""
    pages = -(-len(rows) // LEAF)
    if pages <= 1 or not axes:
        return [rows[i:i + LEAF] for i in range(0, len(rows), LEAF)]
    slabs = math.ceil(pages ** (1 / len(axes)))
    size = -(-pages // slabs) * LEAF
    rows = rows[np.argsort(v[rows, axes[0]], kind="stable")]
    return [leaf for i in range(0, len(rows), size) for leaf in tiles(v, rows[i:i + size], axes[1:])]


class Tree:
    """The R-tree of one shard. Boxes are numbered from the leaves up; the last is the root."""

    def __init__(self, ids: np.ndarray, uids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        order = np.lexsort((uids, ids, labels))
        spread = v.astype(np.float64).var(axis=0) if len(v) else np.zeros(v.shape[1])
        axes = np.argsort(-spread, kind="stable")[:TILED].tolist()
        cuts = np.flatnonzero(np.diff(labels[order])) + 1
        leaves = [leaf for rows in np.split(order, cuts) for leaf in tiles(v, rows, axes)]
        rows = np.concatenate(leaves)
        self.rows, self.ids, self.uids, self.labels, self.v = rows, ids[rows], uids[rows], labels[rows], v[rows]
        ends = np.cumsum([len(leaf) for leaf in leaves])
        starts = np.concatenate(([0], ends[:-1]))
        self.parts = list(zip(starts.tolist(), ends.tolist()))
        self.leaves = len(self.parts)
        level = [np.minimum.reduceat(self.v, starts), np.maximum.reduceat(self.v, starts), np.minimum.reduceat(self.ids, starts),
                 np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)]
        levels, base = [level], 0
        while len(levels[-1][0]) > 1:
            n = len(levels[-1][0])
            heads = np.arange(0, n, FANOUT)
            self.parts += [(base + a, base + min(a + FANOUT, n)) for a in heads.tolist()]
            levels.append([f.reduceat(x, heads) for f, x in
                           zip((np.minimum, np.maximum, np.minimum, np.minimum, np.maximum), levels[-1])])
            base += n
        self.low, self.high, self.first, self.label_low, self.label_high = (
            np.concatenate([level[i] for level in levels]) for i in range(5))

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per anchor and box the least and the greatest possible inner product."""
        plus, minus = np.maximum(q, 0), np.minimum(q, 0)
        return plus @ self.low.T + minus @ self.high.T, plus @ self.high.T + minus @ self.low.T

    def search(self, q, down, up, label: int, uid: int, windows: list[tuple], k: int, same: bool) -> list[list[tuple]]:
        """Per window (least, greatest score) the best ``k`` rows as (-score, id, uid, row)."""
        found: list[list[tuple]] = [[] for _ in windows]

        def worth(box: int) -> bool:
            if not (self.label_low[box] <= label <= self.label_high[box] if same
                    else self.label_low[box] < self.label_high[box] or self.label_low[box] != label):
                return False
            for (least, most), best in zip(windows, found):
                if up[box] >= least and down[box] <= most:
                    if len(best) < k or (-min(up[box], most), self.first[box]) <= best[-1][:2]:
                        return True
            return False

        root = len(self.parts) - 1
        queue = [(-up[root], self.first[root], root)]
        while queue:
            box = heapq.heappop(queue)[2]
            if not worth(box):
                continue
            a, b = self.parts[box]
            if box >= self.leaves:
                for child in range(a, b):
                    if worth(child):
                        heapq.heappush(queue, (-up[child], self.first[child], child))
                continue
            scores = self.v[a:b] @ q
            fits = (self.labels[a:b] == label) & (self.uids[a:b] != uid) if same else self.labels[a:b] != label
            floor = min(least if len(best) < k else -best[-1][0] for (least, _), best in zip(windows, found))
            fits &= (scores >= floor) & (scores <= max(most for _, most in windows))
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            at = at[np.lexsort((self.uids[a:b][at], self.ids[a:b][at], -scores[at]))]
            for (least, most), best in zip(windows, found):
                inside = at[(scores[at] >= least) & (scores[at] <= most)][:k]
                for i in inside.tolist():
                    insort(best, (-scores[i], self.ids[a + i], self.uids[a + i], self.rows[a + i]))
                del best[k:]
        return found


FOUND = "a struct<uid:bigint,vec_id:bigint>, w int, score bigint, vec_id bigint, uid bigint"
LAST = np.iinfo(np.int64).max


def _searched(k: int, same: bool, share: tuple[int, int]):
    """The task: one shard's tree, searched for one block of anchors."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("a_uid", "a_id", "w", "score", "vec_id", "uid")}
        if len(rows) and len(anchors):
            width = max(matrix(rows["v"]).shape[1], matrix(anchors["v"]).shape[1])
            v, q = matrix(rows["v"], width), matrix(anchors["v"], width)
            most = max(int(np.abs(v).max(initial=0)), int(np.abs(q).max(initial=0)))
            exact = np.float64 if most * most * max(1, width) < 1 << 53 else object
            ids = rows["vec_id"].to_pylist()
            tree = Tree(np.array([LAST if i is None else i for i in ids], dtype=np.int64),
                        rows["uid"].to_numpy(), rows["label"].to_numpy(), v.astype(exact))
            tree.low, tree.high = tree.low.astype(exact), tree.high.astype(exact)
            q = q.astype(exact)
            down, up = tree.intervals(q)
            scores = anchors["scores"].to_pylist()
            for i, (label, uid, own) in enumerate(zip(*(anchors[c].to_pylist() for c in ("label", "uid", "vec_id")))):
                windows = [(-INFINITY, INFINITY)] if same else [(-(-share[0] * s // share[1]), s) for s in scores[i]]
                for w, best in enumerate(tree.search(q[i], down[i], up[i], label, uid, windows, k, same)):
                    for score, _, other, row in best:
                        for c, value in zip(out, (uid, own, w, -int(score), ids[row], int(other))):
                            out[c].append(value)
        a = pa.StructArray.from_arrays([pa.array(out["a_uid"], pa.int64()), pa.array(out["a_id"], pa.int64())], ["uid", "vec_id"])
        return pa.table({"a": a, "w": pa.array(out["w"], pa.int32()),
                         **{c: pa.array(out[c], pa.int64()) for c in ("score", "vec_id", "uid")}})
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of all shards' rows per anchor and window, ``rank`` from 1."""
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5,
         share: tuple[int, int] = (80, 100)) -> DataFrame:
    """Hard negatives of ``vectors`` (vec_id, embedding, label): for each anchor and
    each of its best ``positives`` rows of the same label the best ``negatives`` rows
    of other labels whose score is between ``share[0] / share[1]`` of the positive's
    and the positive's own. Columns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    rows = sharded(points(vectors))
    given = stored(rows.where(is_anchor).select("vec_id", "uid", "label", "v"), "negatives-anchors")
    top, n = rows.agg(F.max("shard")).first()[0] or 0, given.count()
    blocks = max(1, -(-n // BLOCK_ANCHORS))
    anchors = given.withColumn("block", F.pmod("uid", F.lit(blocks)).cast("int"))
    cells = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("shard", "block")

    def round_of(asked: DataFrame, k: int, same: bool) -> DataFrame:
        return cells.cogroup(asked.groupBy("shard", "block")).applyInArrow(_searched(k, same, share), FOUND)

    homes = rows.select("label", F.col("shard").alias("home")).distinct()
    alike = anchors.withColumn("scores", F.array().cast("array<bigint>")).join(homes, "label").withColumnRenamed("home", "shard")
    best = _best(round_of(alike, positives, True), positives)
    chosen = stored(best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p")),
                    "negatives-positives")
    asked = (anchors.withColumn("a", F.struct("uid", "vec_id")).join(chosen, "a")
             .select("vec_id", "uid", "label", "v", "block", F.col("p.score").alias("scores"),
                     F.explode(F.sequence(F.lit(0), F.lit(top))).alias("shard")))
    picked = _best(round_of(asked, negatives, False), negatives)
    positive = F.element_at("p", F.col("w") + 1)
    return picked.join(chosen, "a").select(
        F.col("a.vec_id").alias("anchor_id"), positive["vec_id"].alias("positive_id"), F.col("rank"),
        F.col("vec_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))


ANCHOR_EVERY, MOVED_EVERY, LABELS = 100, 7, 10


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every seventh row's label moves on by one first."""
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % ANCHOR_EVERY == 0)


ORACLE = """
WITH q AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike,
         CAST(list_inner_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike
  AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
"""
