"""Structured Streaming front ends.

The reference receives purchases and row edits one HTTP form at a time. Here
they arrive as files (any file source works the same way) and every
micro-batch runs the batch operator through ``foreachBatch`` and commits one
version of a snapshot store:

* intake: the batch's new rows are appended as one more folder per grown
  table. New ids continue from the largest keys in the manifest, never from
  a scan of the big tables;
* changes: the batch adds one folder of marks per changed table (the final
  row, or a delete mark, of every touched key), merged when read; untouched
  rows are not written again until :func:`compact` folds the marks in;
* cascades: the same over several tables at once, one version per batch.

Every version records the stream and the batch it comes from. A stream's id
is stored beside its checkpoint, so a batch is told from its replay (which
changes nothing) and from a batch of another stream, or of the same files
under a new checkpoint: that one goes on top of what is there. Two streams on
one store commit one after the other; the loser of a race computes its batch
again from the winner's version.

Progress lives in the checkpoint folder, which must be on shared storage
(``spark.checkpoint.dir`` by default).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marquee.operators.changes import cascade_marks, change_marks
from marquee.operators.intake import purchase_intake
from marquee.schemas import CASCADE_CHANGE, PURCHASE_REQUEST, TABLE_SCHEMAS, change_schema
from marquee.sources import snapshots
from marquee.tables import Tables

BASE_VERSION = snapshots.version_name(0)
INTAKE_TABLES = ("customer", "cust_of", "ticket", "purchase")
REJECT_SCHEMA = StructType([StructField("request_id", PURCHASE_REQUEST["request_id"].dataType),
                            StructField("reject_reason", PURCHASE_REQUEST["e_mail"].dataType)])
CHANGE_REJECTS = StructType([StructField("seq", LongType()), StructField("reason", StringType())])
UNNAMED = "unnamed"


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id stored beside a checkpoint; the first start draws it."""
    path = f"{checkpoint.rstrip('/')}/stream_id"
    try:
        return spark.read.schema("id string").parquet(path).first().id
    except (AnalysisException, AttributeError):
        spark.createDataFrame([(uuid.uuid4().hex,)], "id string").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema("id string").parquet(path).first().id


def _ensure_base(spark: SparkSession, root: str) -> None:
    """Publish the base tables under ``root`` as version 0 if none is
    published yet, with their largest keys (read once; later versions carry
    theirs in the manifest)."""
    if snapshots.any_published(spark, root):
        return
    paths = {name: snapshots.table_path(root, BASE_VERSION, name) for name in TABLE_SCHEMAS}
    tops = {paths[name]: snapshots.max_key(spark, paths[name], name) for name in snapshots.NUMBERED_TABLES}
    snapshots.publish_version(spark, root, BASE_VERSION, paths, tops)


def _committed(spark: SparkSession, root: str, batch_id: int, stream: str | None, work: Callable[[str, tuple[str, int]], str]) -> None:
    """Run ``work(base version, (stream, batch))``, which commits, until it is
    the next one; nothing is done for a batch that the store already holds.
    Without ``stream``, the last stream that the store knows is meant."""
    while True:
        base = snapshots.current_version(spark, root)
        listed = snapshots.folders(spark, root, base)
        if stream is None:
            known = [f for f in listed if f.kind == snapshots.STREAM]
            stream = max(known, key=lambda f: f.order).path if known else UNNAMED
        if snapshots.stream_batch(listed, stream) >= batch_id:
            return
        try:
            work(base, (stream, batch_id))
            return
        except snapshots.VersionClash:
            continue


def read_deltas(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows that the streams have added to a table since version 0 (or, for
    ``rejects``, the rejects), of committed batches only."""
    if name == "rejects":
        return snapshots.read_rejects(spark, root, REJECT_SCHEMA)
    schema = TABLE_SCHEMAS[name]
    base = set(snapshots.manifest(spark, root, BASE_VERSION)[name])
    new = [p for p in snapshots.manifest(spark, root, snapshots.current_version(spark, root))[name] if p not in base]
    return spark.read.schema(schema).parquet(*new) if new else spark.createDataFrame([], schema)


def intake_state(spark: SparkSession, root: str) -> Tables:
    """Tables as the next batch sees them."""
    return snapshots.read_snapshot(spark, root)


def run_intake_batch(requests: DataFrame, batch_id: int, root: str, stream: str | None = None) -> None:
    spark = requests.sparkSession
    requests = requests.persist()

    def work(base: str, batch: tuple[str, int]) -> str:
        tops = snapshots.max_ids(spark, root, base)
        res = purchase_intake(requests, snapshots.read_snapshot(spark, root, base), persist=True,
                              id_bases={n: tops.get(n) or 0 for n in snapshots.NUMBERED_TABLES})
        try:
            return snapshots.commit(spark, root, base, reads={"event_catalog"}, rejects=res.rejects, stream=batch, append={
                "customer": res.new_customers, "cust_of": res.new_cust_of,
                "ticket": res.new_tickets, "purchase": res.new_purchases})
        finally:
            res.release()

    try:
        _committed(spark, root, batch_id, stream, work)
    finally:
        requests.unpersist()


def _reader(spark: SparkSession, schema: StructType, fmt: str, max_files_per_trigger):
    """File stream with the declared schema (never inferred); ``fmt`` is any
    file source -- parquet, json (one form post per line) or csv with a
    header."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader


def _started(reader, in_dir: str, checkpoint: str, available_now: bool, run: Callable[[DataFrame, int], None]) -> StreamingQuery:
    writer = reader.load(in_dir).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def purchase_intake_stream(spark: SparkSession, in_dir: str, root: str, checkpoint: str,
                           max_files_per_trigger: int | None = None,
                           available_now: bool = True, fmt: str = "parquet") -> StreamingQuery:
    """I8: purchase requests (files shaped like ``PURCHASE_REQUEST``) ->
    versions of the store ``root`` (whose base tables must exist)."""
    _ensure_base(spark, root)
    stream = stream_id(spark, checkpoint)
    return _started(_reader(spark, PURCHASE_REQUEST, fmt, max_files_per_trigger), in_dir, checkpoint, available_now,
                    lambda df, bid: run_intake_batch(df, bid, root, stream))


def _table_root(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def run_change_batch(changes: DataFrame, batch_id: int, root: str, name: str,
                     key: str = "ID", stream: str | None = None) -> None:
    spark = changes.sparkSession
    troot, schema = _table_root(root, name), TABLE_SCHEMAS[name]
    changes = changes.persist()

    def work(base: str, batch: tuple[str, int]) -> str:
        marks, rejects = change_marks(snapshots.read_table(spark, troot, base, name), changes, key, schema)
        return snapshots.commit(spark, troot, base, marks={name: marks}, rejects=rejects, stream=batch)

    try:
        _committed(spark, troot, batch_id, stream, work)
    finally:
        changes.unpersist()


def init_change_table(df: DataFrame, root: str, name: str) -> None:
    spark, troot = df.sparkSession, _table_root(root, name)
    path = snapshots.write_table(df.select(*[F.col(f.name).cast(f.dataType) for f in TABLE_SCHEMAS[name].fields]),
                                 troot, BASE_VERSION, name)
    snapshots.publish_version(spark, troot, BASE_VERSION, {name: [path]})


def read_change_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    troot = _table_root(root, name)
    return snapshots.read_table(spark, troot, snapshots.current_version(spark, troot), name)


def compact(spark: SparkSession, root: str, name: str) -> str:
    """Fold a table's appended rows and marks into one folder, as a new
    version of the store ``root``. Fails with a clash if the table changes
    meanwhile; streams that run beside it compute their batch again."""
    base = snapshots.current_version(spark, root)
    return snapshots.commit(spark, root, base, rewrite={name: snapshots.read_table(spark, root, base, name)})


def compact_change_table(spark: SparkSession, root: str, name: str) -> str:
    return compact(spark, _table_root(root, name), name)


def table_changes_stream(spark: SparkSession, in_dir: str, root: str, name: str,
                         checkpoint: str, key: str = "ID",
                         max_files_per_trigger: int | None = None,
                         available_now: bool = True, fmt: str = "parquet") -> StreamingQuery:
    """Change rows (``change_schema`` of the table) -> new versions of
    the table under ``root/<name>`` (initialised by :func:`init_change_table`).
    Change rows carry a nested ``row`` struct, so use parquet or json."""
    stream = stream_id(spark, checkpoint)
    return _started(_reader(spark, change_schema(TABLE_SCHEMAS[name]), fmt, max_files_per_trigger), in_dir, checkpoint,
                    available_now, lambda df, bid: run_change_batch(df, bid, root, name, key, stream))


def run_cascade_batch(log: DataFrame, batch_id: int, root: str, rekey: bool = False, stream: str | None = None) -> None:
    spark = log.sparkSession
    log = log.persist()

    def work(base: str, batch: tuple[str, int]) -> str:
        marks, rejects = cascade_marks(snapshots.read_snapshot(spark, root, base), log, rekey)
        return snapshots.commit(spark, root, base, marks=marks, rejects=rejects, stream=batch)

    try:
        _committed(spark, root, batch_id, stream, work)
    finally:
        log.unpersist()


def table_cascades_stream(spark: SparkSession, in_dir: str, root: str, checkpoint: str, rekey: bool = False,
                          max_files_per_trigger: int | None = None,
                          available_now: bool = True, fmt: str = "parquet") -> StreamingQuery:
    """I9 over several tables: an ordered log of cascading deletes, pair edits
    and ticket edits (``CASCADE_CHANGE``) -> one version of the store ``root``
    per micro-batch, with marks in every table it touches."""
    _ensure_base(spark, root)
    stream = stream_id(spark, checkpoint)
    return _started(_reader(spark, CASCADE_CHANGE, fmt, max_files_per_trigger), in_dir, checkpoint, available_now,
                    lambda df, bid: run_cascade_batch(df, bid, root, rekey, stream))
