"""Dense key assignment (``max(ID) + 1, + 2, ...`` in a given order) without
a single-partition global window.

1. Cut the order key into ``n`` ranges at approximate quantiles, ``n`` following
   the row count (one count, and one ``percentile_approx`` aggregate ten times
   finer than the ranges, partial per task; only the cut points reach the
   driver, just as a range partitioner's sample does).
2. A key that fills ``HEAVY`` ranges or more (it repeats among the cut points;
   its rows are then counted exactly) gets ranges of its own, dealt by a hash of
   the row. NULL is a key like any other and comes first.
3. Bucket every row by binary search in one literal array of the cut points (a
   pure function of the row, so every re-evaluation or retried task gives the
   same bucket).
4. Count rows per bucket (at most ``2 n`` buckets), turn the counts into running
   offsets, and number rows inside each bucket with ``row_number``.
5. Broadcast the offsets (bounded by ``2 n``) back: id = base + offset + rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows a bucket should hold, and the most buckets (the broadcast offsets and
#: the literal array have one entry per bucket).
BUCKET_ROWS = 100_000
MOST_BUCKETS = 8_192
#: Ranges a key must fill to be split. Three shares always hold two cut points.
HEAVY = 3


class Cuts(list):
    """Sorted distinct cut points; ``ways``: into how many ranges the rows of a
    heavy key are dealt (None for NULL)."""

    def __init__(self, points=(), ways: dict | None = None):
        super().__init__(points)
        self.ways = ways or {}


def bucket_expr(key: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are below ``key``: binary search in one
    literal array, about log2(len(cuts)) steps. NULL keys come first."""
    widths = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    at = F.array(*map(F.lit, cuts))

    def step(found: Column, width: Column) -> Column:
        # past the last cut the comparison is NULL
        return found + F.when(F.get(at, found + width - 1) < key, width).otherwise(0)

    return F.aggregate(F.array(*map(F.lit, widths)), F.lit(0), step)


def cut_points(df: DataFrame, order_col: str, n_buckets: int | None = None) -> Cuts:
    """``n - 1`` approximate quantiles of ``order_col`` and its heavy keys (only
    these values reach the driver); without ``n_buckets``, ``n`` follows the row
    count."""
    n = n_buckets or min(MOST_BUCKETS, -(-df.count() // BUCKET_ROWS))
    if n <= 1:
        return Cuts()
    probs = [i / n for i in range(1, n)]
    points, rows, known = df.agg(F.percentile_approx(order_col, probs, max(10_000, 10 * n)),
                                 F.count(F.lit(1)), F.count(order_col)).first()
    points = sorted(points or [])
    sizes = {None: rows - known}
    repeated = sorted({a for a, b in zip(points, points[1:]) if a == b})
    if repeated:
        sizes |= {r.key: r.n for r in df.where(F.col(order_col).isin(repeated)).groupBy(F.col(order_col).alias("key"))
                  .agg(F.count(F.lit(1)).alias("n")).collect()}
    return Cuts(sorted(set(points)), {k: size * n // rows for k, size in sizes.items() if size * n >= HEAVY * rows > 0})


def _range_of(key: Column, row_hash: Column, cuts: list) -> tuple[Column, Column, Column]:
    """Bucket of a row, its part of a heavy key's rows (0 for all other keys),
    and the place inside the part."""
    ways = getattr(cuts, "ways", {})
    bucket = bucket_expr(key, cuts) if cuts else F.lit(0)
    if not ways:
        return bucket, F.lit(0), F.lit(0)
    parts = F.lit(0)
    if cuts:  # a heavy key is a cut point: the one at its bucket's upper end
        at, dealt = F.array(*map(F.lit, cuts)), F.array(*[F.lit(ways.get(k, 0)) for k in cuts])
        parts = F.when(F.get(at, bucket) == key, F.get(dealt, bucket)).otherwise(0)
    if None in ways:
        parts = F.when(key.isNull(), ways[None]).otherwise(parts)
        bucket = F.when(key.isNull(), -1).otherwise(bucket)
    draw = row_hash.bitwiseAND(F.lit((1 << 31) - 1))
    part = F.when(parts > 0, 1 + F.shiftright(draw * parts, 31)).otherwise(0)
    return bucket, part.cast("int"), F.when(parts > 0, draw).otherwise(0)


def dense_rank_by(df: DataFrame, order_col: str, rank_col: str = "_pos",
                  n_buckets: int | None = None, cuts: list | None = None) -> DataFrame:
    """Add ``rank_col`` = 1-based position of each row in ``order_col``
    order. Ties go by the remaining columns; those of a heavy key by a hash of
    the row first, so that its rows spread over ranges (rows alike in every
    column stay together). ``cuts`` may come from a superset of the rows (e.g.
    all requests of a batch when ranking the accepted ones): any sorted cut
    points give the same ranks, they only steer the bucket balance."""
    if cuts is None:
        cuts = cut_points(df, order_col, n_buckets)
    key = F.col(order_col)
    # Remaining columns break ties, so the numbering is a function of the
    # data alone (a partition recomputed after an executor loss numbers its
    # rows the same way even if the order key repeats).
    sortable = [c for c, t in df.dtypes if c != order_col
                and not t.startswith(("map", "array", "struct", "binary"))]
    bucket, part, place = _range_of(key, F.xxhash64(*sortable) if sortable else F.lit(0).cast("bigint"), cuts)
    bucketed = df.withColumns({"_bucket": bucket, "_part": part, "_place": place})
    counts = bucketed.groupBy("_bucket", "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_bucket", "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_bucket", "_part")
                                    .rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"))
    ranked = bucketed.withColumn("_rn", F.row_number().over(
        Window.partitionBy("_bucket", "_part").orderBy(key, "_place", *sortable)))
    return (ranked.join(F.broadcast(offsets), ["_bucket", "_part"])
            .withColumn(rank_col, (F.col("_offset") + F.col("_rn")).cast("bigint"))
            .drop("_bucket", "_part", "_place", "_offset", "_rn"))


def next_ids_base(existing: DataFrame, key_col: str) -> Column:
    """``max(key)`` of a table as a scalar subquery, 0 when empty."""
    return F.coalesce(existing.agg(F.max(key_col)).scalar(), F.lit(0)).cast("bigint")


def assign_ids(df: DataFrame, order_col: str, existing: DataFrame, existing_key: str,
               id_col: str, n_buckets: int | None = None) -> DataFrame:
    """M2: new ids ``max(existing) + position`` in ``order_col`` order."""
    ranked = dense_rank_by(df, order_col, "_pos", n_buckets)
    return ranked.withColumn(id_col, next_ids_base(existing, existing_key) + F.col("_pos")) \
        .drop("_pos")
