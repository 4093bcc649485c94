"""Table storage: versioned parquet snapshots and an RDBMS reader.

A snapshot version lists, per table, one or more parquet folders (a manifest
under ``<root>/_versions/version=<version>``, with each folder's largest
key). A new version writes only what changed -- a rewritten table, one more
folder of appended rows, or one more folder of *marks* (the final row, or a
delete mark, of every key that changed) -- and lists the untouched folders
again. Readers merge: a key's newest mark hides its rows in older folders.
The current version is the greatest published one (versions are zero-padded
so text order is version order).

Commits are optimistic (:func:`commit`): a job publishes the version after
the one it read. If others published meanwhile, it goes on top of them when
they changed none of the tables it read or wrote, and fails with
:class:`VersionClash` otherwise. A manifest is put in place by a rename that
refuses an existing target, which file systems with atomic renames (HDFS, a
POSIX mount) decide for one of two jobs; a plain object store needs one that
offers the same (a put-if-absent) in front.

Nothing is ever overwritten in place -- not the data, not the pointer -- so
no job rewrites a path another job is reading; readers pin a version.
Tables are read with their declared schemas (never inferred). Files are sorted by the table's key, and whole tables are
dealt to them in key ranges, so parquet min/max statistics let a key filter skip all files but a few; small folders (added
rows, marks) are not dealt anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from marquee.plans.checks import duplicate_keys
from marquee.schemas import TABLE_KEYS, TABLE_SCHEMAS
from marquee.tables import Tables

VERSIONS = "_versions"
# Tables whose new rows get generated ids: their folders' largest keys are
# recorded in the manifest so numbering never scans the table.
NUMBERED_TABLES = ("customer", "ticket", "purchase")


ROWS, MARKS, REJECTS, STREAM = "rows", "marks", "rejects", "stream"
ALIVE = "_alive"


class VersionClash(RuntimeError):
    """Another job has published a version that this one's result does not know of."""


@dataclass(frozen=True)
class Folder:
    """A line of a manifest: a folder of a table (``order``: the version that
    added it), a version's rejects, or the last batch (``max_id``) of a stream
    (``path``: its id)."""
    table: str
    path: str
    max_id: int | None = None
    kind: str = ROWS
    order: int = 0
    base: str | None = None
    changed: bool = True


def table_path(root: str, version: str, name: str) -> str:
    return f"{root.rstrip('/')}/v={version}/{name}"


def write_table(df: DataFrame, root: str, version: str, name: str,
                max_records_per_file: int | None = None, keys: list[str] | None = None,
                by_range: bool = True) -> str:
    """Write one folder of a table, with ``by_range`` in key ranges (pairs of
    two columns by both, so a hot first column is split)."""
    path = table_path(root, version, name)
    keys = keys or TABLE_KEYS[name]
    dealt = df.repartitionByRange(*keys) if by_range else df
    writer = dealt.sortWithinPartitions(*keys).write.mode("errorifexists")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(path)
    return path


def _as_list(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def max_key(spark: SparkSession, path: str, name: str):
    """Largest key in one table folder (reads the key column only)."""
    key = TABLE_KEYS[name][0]
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(path).agg(F.max(key)).first()[0]


def write_snapshot(t: Tables, root: str, version: str, publish: bool = True,
                   reuse: dict | None = None, append: dict | None = None,
                   parallelism: int = 1, check_keys: bool = False) -> dict[str, list[str]]:
    """Write the tables of ``t`` as version ``version`` and (optionally)
    publish it. Tables named in ``reuse`` (name -> existing folders) are not
    rewritten: the manifest points at the existing folders. Tables named in
    ``append`` (name -> existing folders) are written as one more folder
    holding only the rows of ``t`` (new rows), added to the existing ones --
    so growing a table never copies what it already holds. With
    ``parallelism`` > 1 the independent table writes are submitted from a
    thread pool (after any shared persisted input of ``t`` is filled once).
    With ``check_keys`` a table with a repeated key is an error and nothing
    is published (the id-first reports and the folds rely on unique keys)."""
    spark = t.customer.sparkSession
    reuse, append = reuse or {}, append or {}
    paths: dict[str, list[str]] = {name: _as_list(reuse[name]) for name in t.names()
                                   if name in reuse}
    todo = [name for name in t.names() if name not in reuse]

    def write_one(name: str) -> str:
        schema = TABLE_SCHEMAS[name]
        return write_table(
            t.get(name).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]),
            root, version, name, by_range=name not in append)

    if parallelism > 1:
        for df in t.cached:
            df.count()
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            new_folders = dict(zip(todo, pool.map(write_one, todo)))
    else:
        new_folders = {name: write_one(name) for name in todo}
    for name, folder in new_folders.items():
        paths[name] = _as_list(append.get(name, [])) + [folder]
    if check_keys:
        written = Tables(**{name: spark.read.schema(TABLE_SCHEMAS[name]).parquet(*paths[name])
                            for name in t.names()})
        repeated = duplicate_keys(written).select("table").distinct().collect()
        if repeated:
            raise ValueError(f"repeated keys in {sorted(r.table for r in repeated)}; "
                             f"version {version} is not published")
    if publish:
        known = folder_max_ids(spark, root) if (reuse or append) else {}
        publish_version(spark, root, version, paths,
                        {f: known[f] if f in known else max_key(spark, f, n)
                         for n in NUMBERED_TABLES for f in paths[n]})
    return paths


def version_name(n: int) -> str:
    """Zero-padded version text: text order equals numeric order."""
    return f"{n:012d}"


MANIFEST_SCHEMA = "table string, path string, max_id bigint, kind string, order bigint, base string, changed boolean"


def _put_if_absent(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder to ``target``, or raise :class:`VersionClash` if that exists."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(source), hadoop.Path(target)
    files = hadoop.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()) if new.toUri().getScheme() \
        else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    try:
        files.rename(old, new, spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError as e:
        files.delete(old, True)
        if files.util().exists(new):
            raise VersionClash(f"{target} is taken") from e
        raise


def put_manifest(spark: SparkSession, root: str, version: str, folders: Iterable[Folder]) -> None:
    """Make ``version`` visible: its manifest is written aside and put in place
    whole. A version that another job has taken is a :class:`VersionClash`."""
    rows = [(f.table, f.path, f.max_id, f.kind, f.order, f.base, f.changed) for f in folders] or [(None,) * 7]
    where = f"{root.rstrip('/')}/{VERSIONS}"
    aside = f"{where}/_new-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.parquet(aside)
    _put_if_absent(spark, aside, f"{where}/version={version}")


def publish_version(spark: SparkSession, root: str, version: str, paths: dict | None = None,
                    max_ids: dict | None = None) -> None:
    """Publish ``version`` as these folders of rows (table -> folders)."""
    max_ids = max_ids or {}
    put_manifest(spark, root, version, [Folder(name, p, max_ids.get(p)) for name, ps in (paths or {}).items() for p in _as_list(ps)])


def current_version(spark: SparkSession, root: str) -> str:
    """Greatest published version (one aggregate value reaches the driver)."""
    try:
        rows = (spark.read.schema(MANIFEST_SCHEMA + ", version string")
                .parquet(f"{root.rstrip('/')}/{VERSIONS}")
                .agg(F.max("version")).collect())
    except AnalysisException as e:
        if not _none_published(e):
            raise
        raise FileNotFoundError(f"no published snapshot under {root}") from e
    if not rows or rows[0][0] is None:
        raise FileNotFoundError(f"no published snapshot under {root}")
    return rows[0][0]


def _none_published(e: AnalysisException) -> bool:
    """Whether the error says that the versions folder, or the asked version's, is absent."""
    return e.getCondition() == "PATH_NOT_FOUND"


def any_published(spark: SparkSession, root: str) -> bool:
    try:
        current_version(spark, root)
    except FileNotFoundError:
        return False
    return True


def folders(spark: SparkSession, root: str, version: str) -> list[Folder]:
    """A version's manifest, from its own folder alone (a few small rows). A
    root without any published version has the default layout; a version that
    is not among the published ones is an error."""
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{root.rstrip('/')}/{VERSIONS}/version={version}").collect()
    except AnalysisException as e:
        if not _none_published(e):
            raise
        if any_published(spark, root):
            raise FileNotFoundError(f"version {version} is not published under {root}") from e
        return [Folder(name, table_path(root, version, name)) for name in TABLE_SCHEMAS]
    return [Folder(r.table, r.path, r.max_id, r.kind or ROWS, r.order or 0, r.base, r.changed is not False)
            for r in rows if r.table is not None]


def folder_max_ids(spark: SparkSession, root: str) -> dict:
    """Largest key of every folder the current version lists (folder -> max id)."""
    try:
        version = current_version(spark, root)
    except FileNotFoundError:
        return {}
    return {f.path: f.max_id for f in folders(spark, root, version) if f.max_id is not None and f.kind != STREAM}


def manifest(spark: SparkSession, root: str, version: str) -> dict[str, list[str]]:
    """Folders of rows of every table in a version; tables it does not list
    have the default layout."""
    listed: dict[str, list[str]] = {}
    for f in folders(spark, root, version):
        if f.kind == ROWS:
            listed.setdefault(f.table, []).append(f.path)
    return {name: [table_path(root, version, name)] for name in TABLE_SCHEMAS} | {k: sorted(v) for k, v in listed.items()}


def max_ids(spark: SparkSession, root: str, version: str) -> dict:
    """Largest key per table of a version, from the manifest only (no scan
    of the tables): ``{table: int | None}``."""
    out: dict[str, int | None] = {}
    for f in folders(spark, root, version):
        if f.kind in (ROWS, MARKS):
            known = [x for x in (out.get(f.table), f.max_id) if x is not None]
            out[f.table] = max(known) if known else None
    return out


def stream_batch(listed: list[Folder], stream: str) -> int:
    """The last batch of a stream that a version holds, -1 if none."""
    return max((f.max_id for f in listed if f.kind == STREAM and f.path == stream), default=-1)


def marks_schema(name: str) -> StructType:
    return StructType([*TABLE_SCHEMAS[name].fields, StructField(ALIVE, BooleanType(), True)])


def _read_folders(spark: SparkSession, listed: list[Folder], name: str) -> DataFrame:
    """Merge on read: rows whose key has no newer mark, and the newest marks'
    rows. The rows' side is only anti-joined to the marked keys."""
    schema, keys = TABLE_SCHEMAS[name], TABLE_KEYS[name]
    rows = [f for f in listed if f.table == name and f.kind == ROWS]
    marks = [f for f in listed if f.table == name and f.kind == MARKS]
    if not marks:
        return spark.read.schema(schema).parquet(*sorted(f.path for f in rows))
    newest = reduce(DataFrame.unionByName, [
        spark.read.schema(marks_schema(name)).parquet(f.path).withColumn("_at", F.lit(f.order)) for f in marks])
    if len(marks) > 1:
        whole = F.struct(*newest.columns)
        newest = newest.groupBy(*keys).agg(F.max_by(whole, "_at").alias("_m")).select("_m.*")
    # folders between the same two marks are read together
    ages: dict[int, list[Folder]] = {}
    for f in rows:
        ages.setdefault(sum(m.order > f.order for m in marks), []).append(f)
    parts = []
    for newer, same in sorted(ages.items()):
        part = spark.read.schema(schema).parquet(*sorted(f.path for f in same))
        if newer:
            since = max(f.order for f in same)
            part = part.join(newest.where(F.col("_at") > since).select(*keys), keys, "left_anti")
        parts.append(part)
    parts.append(newest.where(ALIVE).select(*schema.names))
    return reduce(DataFrame.unionByName, [p.select(*schema.names) for p in parts])


def read_table(spark: SparkSession, root: str, version: str, name: str) -> DataFrame:
    listed = folders(spark, root, version)
    if not any(f.table == name for f in listed):
        listed = [Folder(name, table_path(root, version, name))]
    return _read_folders(spark, listed, name)


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> Tables:
    v = version or current_version(spark, root)
    listed = folders(spark, root, v)
    have = {f.table for f in listed}
    listed += [Folder(name, table_path(root, v, name)) for name in TABLE_SCHEMAS if name not in have]
    return Tables(**{name: _read_folders(spark, listed, name) for name in TABLE_SCHEMAS})


def _claimed_folder(spark: SparkSession, root: str, version: str) -> str:
    """The folder name of one attempt at ``version``: the version itself for the
    first, so that a second job (or the rest of a job that died) never shares it."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    claim = hadoop.Path(f"{root.rstrip('/')}/_claims/{version}")
    files = claim.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(claim.getParent())
    return version if files.createNewFile(claim) else f"{version}.{uuid.uuid4().hex[:12]}"


def commit(spark: SparkSession, root: str, base: str, rewrite: dict[str, DataFrame] | None = None,
           append: dict[str, DataFrame] | None = None, marks: dict[str, DataFrame] | None = None,
           reads: Iterable[str] = (), rejects: DataFrame | None = None, stream: tuple[str, int] | None = None) -> str:
    """Publish a change made from version ``base``: tables written anew, rows
    added, or marks added (final rows and delete marks per key); ``rejects`` are
    written before the version shows and listed by it. ``reads`` names tables
    that the result depends on besides those it changes. With ``stream`` (id,
    batch) the version records the batch, and a batch that is already recorded
    changes nothing. Returns the version that holds the change."""
    parts = [(name, df, kind) for kind, tables in (("rewrite", rewrite), (ROWS, append), (MARKS, marks))
             for name, df in (tables or {}).items()]
    changed = {name for name, _, _ in parts}
    folder = _claimed_folder(spark, root, version_name(int(base) + 1))
    written = []
    for name, df, kind in parts:
        schema = marks_schema(name) if kind == MARKS else TABLE_SCHEMAS[name]
        path = write_table(df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), root, folder,
                           name if kind != MARKS else f"{name}-marks", keys=TABLE_KEYS[name], by_range=kind == "rewrite")
        top = max_key(spark, path, name) if name in NUMBERED_TABLES else None
        written.append((kind, Folder(name, path, top, ROWS if kind == "rewrite" else kind)))
    if rejects is not None:
        path = f"{root.rstrip('/')}/rejects/v={folder}"
        rejects.write.mode("errorifexists").parquet(path)
        written.append((REJECTS, Folder("rejects", path, None, REJECTS)))
    while True:
        current = current_version(spark, root)
        listed = folders(spark, root, current)
        if stream and stream_batch(listed, stream[0]) >= stream[1]:
            return current
        since: set[str] = set()
        for n in range(int(base) + 1, int(current) + 1):
            since |= {f.table for f in folders(spark, root, version_name(n)) if f.changed}
        if since & (changed | set(reads)):
            raise VersionClash(f"version {current} changed {sorted(since & (changed | set(reads)))} after version {base} was read")
        order = int(current) + 1
        again = {f.table for kind, f in written if kind == "rewrite"}
        keep = [replace(f, changed=False, base=current) for f in listed
                if f.table not in again and f.kind != REJECTS and not (stream and f.kind == STREAM and f.path == stream[0])]
        new = [replace(f, order=order, base=current) for _, f in written]
        if stream:
            new.append(Folder("stream", stream[0], stream[1], STREAM, order, current, False))
        try:
            put_manifest(spark, root, version_name(order), keep + new)
            return version_name(order)
        except VersionClash:
            continue  # taken meanwhile: look at what it changed


def read_rejects(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The rejects of all published versions."""
    rows = (spark.read.schema(MANIFEST_SCHEMA + ", version string").parquet(f"{root.rstrip('/')}/{VERSIONS}")
            .where(F.col("kind") == REJECTS).select("path").distinct().collect())
    paths = sorted(r.path for r in rows)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_jdbc(spark: SparkSession, url: str, table: str, name: str, *,
              partition_column: str | None = None, lower_bound: int | None = None,
              upper_bound: int | None = None, num_partitions: int | None = None,
              properties: dict | None = None, raw: bool = False) -> DataFrame:
    """One of the seven tables straight from the source database, read
    in parallel ranges of a numeric key when bounds are given. Connection
    options (user, password, driver) come from the caller."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column and num_partitions:
        reader = (reader.option("partitionColumn", partition_column)
                  .option("lowerBound", str(lower_bound)).option("upperBound", str(upper_bound))
                  .option("numPartitions", str(num_partitions)))
    df = reader.load()
    if raw:
        return df
    schema = TABLE_SCHEMAS[name]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


# Table names in the source database (the reference's spelling).
SOURCE_TABLES = {
    "event_catalog": "events",
    "company": "Company",
    "distributer": "Distributer",
    "customer": "Customer",
    "ticket": "TICKET",
    "purchase": "Purchase",
    "cust_of": "cust_of",
}


def read_jdbc_tables(spark: SparkSession, url: str, properties: dict | None = None,
                     num_partitions: int = 32, source_tables: dict | None = None) -> Tables:
    """All seven tables from the source database. Tables with a numeric key
    are read in ``num_partitions`` parallel key ranges; the range bounds
    come from one ``min``/``max`` query per table (two numbers reach the
    driver)."""
    names = source_tables or SOURCE_TABLES
    frames = {}
    for name, table in names.items():
        key = TABLE_KEYS[name][0]
        lo = hi = None
        if num_partitions > 1:
            bounds = read_jdbc(spark, url, f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) b",
                               name, properties=properties, raw=True).first()
            lo, hi = bounds[0], bounds[1]
        frames[name] = read_jdbc(
            spark, url, table, name,
            partition_column=key if lo is not None else None, lower_bound=lo, upper_bound=hi,
            num_partitions=num_partitions if lo is not None else None, properties=properties)
    return Tables(**frames)
