"""Helpers shared by the text operators: table reading, stored intermediate
results, row-wise Arrow passes and small column-expression tools."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.session import scratch_dir

#: A word is a run of characters other than these six.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: cuts the
    lineage, survives lost executors, and gives the planner the real size."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark, name)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the
    body names it (a lambda variable cannot be inlined by the optimizer)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def train_fold(doc_id: Column) -> Column:
    """True for rows labels may be learned from (crc32 of the id, mod 5, not 0).
    A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def share_below(key: Column, share: float) -> Column:
    """True for a pseudo-random, id-determined ``share`` of the rows."""
    return F.coalesce(F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1 << 30)) < int(share * (1 << 30)),
                      F.lit(False))


def text_pass(df: DataFrame, schema: T.StructType, start: Callable[[], Callable[[str], tuple]],
              columns: list[str]) -> DataFrame:
    """One result row per row of ``df``: ``columns`` copied, followed by what the
    function made by ``start`` (once per task) returns for the row's ``text``
    (null text is passed on as None)."""
    kept = T.StructType([df.schema[c] for c in columns])
    out = T.StructType(kept.fields + schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        target = to_arrow_schema(out)
        score = start()
        for batch in batches:
            if not batch.num_rows:
                continue
            values = list(zip(*[score(t) for t in batch.column("text").to_pylist()], strict=True))
            arrays = [batch.column(c).cast(target.field(c).type) for c in columns]
            arrays += [pa.array(v, type=target.field(len(columns) + i).type) for i, v in enumerate(values)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    names = list(dict.fromkeys([*columns, "text"]))
    return df.select(*names).mapInArrow(run, out)


def rows_pass(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Filter or edit whole rows; every column of ``df`` keeps its name and type."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edit = start()
        for batch in batches:
            if batch.num_rows:
                yield edit(batch)

    return df.mapInArrow(run, schema)


def row_key(df: DataFrame, names: tuple[str, str] = ("row_k1", "row_k2")) -> list[Column]:
    """Non-null join keys that tell rows with different id or text apart; equal
    rows share them. The id may be of any type; one that is no number is told by
    the hash alone."""
    return [F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.isnull("text")).alias(names[0]),
            F.coalesce(F.col("doc_id").try_cast("bigint"), F.lit(-1).cast("bigint")).alias(names[1])]


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """``names``, lengthened where ``df`` has such a column (in any case) itself."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return tuple(out)
