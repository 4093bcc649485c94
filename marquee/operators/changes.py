"""Row edits of the reference (one INSERT / UPDATE / DELETE per form POST),
re-aimed as batch jobs: ``snapshot + ordered changes -> new snapshot``.

Rules of the sequential log (what a series of single-row statements does):
insert of a live key is a no-op (key constraint), update or delete of an
absent key is a no-op, a delete voids what came before and a later insert
revives the key with the inserted row. Invalid values (a money text that
does not parse, an unknown column) are statement errors: no effect, and the
change is listed in the rejects.

Every fold is written as per-key aggregates (partial aggregation, so a hot
key never gathers its whole history in one task) joined back on the key;
no per-key window and no collect.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import (DecimalType, IntegerType, LongType, StringType, StructType,
                               TimestampNTZType)

from marquee.functions.semantics import clean_money, split_pair
from marquee.operators.keys import bucket_expr, cut_points
from marquee.session import scratch_dir
from marquee.tables import Tables

KEY_CHANGE_ERROR = "key change"
UNKNOWN_PROPERTY_ERROR = "unknown property"
BAD_VALUE_ERROR = "invalid value"
BAD_PAIR_ERROR = "invalid pair"
NO_KEY_ERROR = "missing key"
NO_SEQ_ERROR = "missing seq"


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


# ------------------------------------------------------------------ M1, M8

def insert_rows(snapshot: DataFrame, rows: DataFrame, key="ID", seq_col: str | None = "seq") \
        -> DataFrame:
    """M1: add rows whose key is not live; within the batch the first insert
    (by ``seq``) of a key wins, later ones are no-ops. Rows without a ``seq``
    come after all others; equal ``seq`` (or none) goes by the smallest row."""
    return snapshot.unionByName(fresh_rows(snapshot, rows, key, seq_col))


def fresh_rows(snapshot: DataFrame, rows: DataFrame, key="ID", seq_col: str | None = "seq") -> DataFrame:
    """The rows that :func:`insert_rows` adds."""
    ks = _keys(key)
    cols = snapshot.columns
    if seq_col and seq_col in rows.columns:
        firsts = (rows.groupBy(*ks)
                  .agg(F.min(F.struct(F.col(seq_col).isNull().alias("_last"), F.col(seq_col).alias("_seq"),
                                      F.struct(*cols).alias("_r"))).alias("_f"))
                  .select("_f._r.*"))
    else:
        # no order given: keep the smallest row per key, a deterministic pick
        # (unlike dropDuplicates, which keeps whichever row a task sees first)
        firsts = (rows.groupBy(*ks).agg(F.min(F.struct(*[F.col(c) for c in cols])).alias("_r"))
                  .select("_r.*"))
    return firsts.join(snapshot.select(*ks), ks, "left_anti").select(*cols)


def insert_forms(snapshot: DataFrame, forms: DataFrame, schema: StructType, key="ID") \
        -> tuple[DataFrame, DataFrame]:
    """M1 as the form posts it: every column of ``schema`` arrives as text,
    with ``seq``. A missing key or a text that does not convert is a statement
    error: no effect, and a row (seq, reason) of the rejects. The others are
    inserted as by :func:`insert_rows`. Returns (table, rejects)."""
    fresh, rejects = fresh_forms(snapshot, forms, schema, key)
    return snapshot.select(*schema.names).unionByName(fresh), rejects


def fresh_forms(snapshot: DataFrame, forms: DataFrame, schema: StructType, key="ID") -> tuple[DataFrame, DataFrame]:
    """(the rows that :func:`insert_forms` adds, rejects); of the snapshot only the key is read."""
    ks = _keys(key)
    typed = {f.name: _typed(F.col(f.name), f.dataType).cast(f.dataType) for f in schema.fields}
    missing, bad = F.lit(False), F.lit(False)
    for f in schema.fields:
        if f.name in ks:
            missing = missing | F.col(f.name).isNull()
        bad = bad | (F.col(f.name).isNotNull() & typed[f.name].isNull())
    checked = forms.withColumn("_reject", F.when(missing, F.lit(NO_KEY_ERROR)).when(bad, F.lit(BAD_VALUE_ERROR)))
    rows = checked.where(F.col("_reject").isNull()).select("seq", *[c.alias(n) for n, c in typed.items()])
    return (fresh_rows(snapshot.select(*typed), rows, key),
            checked.where(F.col("_reject").isNotNull()).select("seq", F.col("_reject").alias("reason")))


def delete_rows(snapshot: DataFrame, keys: DataFrame, key="ID") -> DataFrame:
    """M8: remove rows whose key is listed (absent keys are no-ops)."""
    ks = _keys(key)
    return snapshot.join(keys.select(*ks), ks, "left_anti")


# ------------------------------------------------------------------ typed values

def _typed(value: Column, dtype) -> Column:
    """Form text -> column type, NULL when the statement would fail.
    Numeric columns take the money clean-up (drop ``,``/``$``), integers
    round half away from zero; text columns keep the text."""
    if isinstance(dtype, StringType):
        return value
    if isinstance(dtype, DecimalType):
        return clean_money(value).try_cast(dtype)
    if isinstance(dtype, (LongType, IntegerType)):
        return F.round(clean_money(value), 0).try_cast(dtype)
    if isinstance(dtype, TimestampNTZType):
        return F.trim(value).try_cast(dtype)
    return value.try_cast(dtype)


def _check_updates(changes: DataFrame, schema: StructType, key: str) -> DataFrame:
    """Add ``_reject`` to update rows: key changes, unknown columns and
    values that do not convert are rejected."""
    known = [f.name for f in schema.fields if f.name != key]
    ok_value = F.lit(False)
    for f in schema.fields:
        if f.name == key:
            continue
        ok_value = F.when(F.col("property") == f.name,
                          _typed(F.col("new_value"), f.dataType).isNotNull()).otherwise(ok_value)
    reason = (F.when(F.col("seq").isNull(), F.lit(NO_SEQ_ERROR))
              .when(F.col("property") == key, F.lit(KEY_CHANGE_ERROR))
              .when(F.col("property").isNull() | ~F.col("property").isin(*known),
                    F.lit(UNKNOWN_PROPERTY_ERROR))
              .when(F.col("new_value").isNull() | ~ok_value, F.lit(BAD_VALUE_ERROR)))
    return changes.withColumn("_reject", reason)


def _latest_values(updates: DataFrame, schema: StructType, key: str) -> DataFrame:
    """Per key, the last (by seq) valid text of every property, one column
    per property (NULL = not updated): a pivot over the known column list,
    planned as one conditional aggregation with partial aggregation."""
    props = [f.name for f in schema.fields if f.name != key]
    return (updates.groupBy(F.col("key").alias("_key"))
            .pivot("property", props)
            .agg(F.max_by("new_value", "seq")))


def _apply_latest(base: DataFrame, latest: DataFrame, schema: StructType, key: str) -> DataFrame:
    props = [f.name for f in schema.fields if f.name != key]
    renamed = latest.select("_key", *[F.col(p).alias(f"_new_{p}") for p in props])
    joined = base.join(renamed, base[key] == renamed["_key"], "left")
    out = []
    for f in schema.fields:
        if f.name == key:
            out.append(F.col(key))
        else:
            new = F.col(f"_new_{f.name}")
            out.append(F.when(new.isNotNull(), _typed(new, f.dataType))
                       .otherwise(F.col(f.name)).cast(f.dataType).alias(f.name))
    return joined.select(*out)


# ------------------------------------------------------------------ M4-M7

def update_property(snapshot: DataFrame, changes: DataFrame, key: str = "ID",
                    schema: StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """M4-M7: ``UPDATE t SET <property> = <new_value> WHERE key = <key>``
    for a batch; the last valid value per (key, property) wins, updates of
    absent keys are no-ops. Key changes go through :func:`rename_keys`. The
    per-key summary is stored, so the planner knows its size: a small one
    is broadcast and the snapshot is not shuffled.
    Returns (snapshot, rejects(seq, reason))."""
    schema = schema or snapshot.schema
    checked = _check_updates(changes, schema, key)
    valid = checked.where(F.col("_reject").isNull())
    latest = _stored(_latest_values(valid, schema, key))
    rejects = checked.where(F.col("_reject").isNotNull()) \
        .select("seq", F.col("_reject").alias("reason"))
    return _apply_latest(snapshot, latest, schema, key), rejects


def rename_keys(snapshot: DataFrame, renames: DataFrame, key: str = "ID") \
        -> tuple[DataFrame, DataFrame]:
    """Key changes (``SET ID = <new> WHERE ID = <old>``), with the result of
    applying them one by one by ``seq``: a rename of an absent key is a no-op,
    a rename onto a live key fails like a duplicate-key error, chains and
    retries after a failure take effect.

    Up to ``REPLAYED`` renames are replayed in one sorted pass over the keys that
    the batch names (see :func:`_replayed`). More than that go in rounds first
    (see :func:`_judged`): renames of separate keys share a round, and the pass
    takes what is left, or, when chains leave a round little to do, the earliest
    ``REPLAYED``. Returns (snapshot, rejects(seq, reason))."""
    dtype = dict((f.name, f.dataType) for f in snapshot.schema.fields)[key]
    typed = _typed_renames(renames, dtype)
    valid = typed.where(VALID_RENAME)
    # k -> the snapshot key of the row that stands there now, or null
    state = _stored(_named(valid).join(snapshot.select(F.col(key).alias("k"), F.col(key).alias("row")), "k", "left"))
    start = state.where("row IS NOT NULL").select("k")
    opened, applied, left, last = valid, [], valid.count(), None
    while left:
        if left <= REPLAYED or (last and last - left < last // 10):
            now = opened
            if left > REPLAYED:
                until = opened.approxQuantile("seq", [REPLAYED / left], 0.0005)[0]
                now = opened.where(F.col("seq") <= until)
            done = _replayed(state.where("row IS NOT NULL"), now.select("seq", F.lit("move").alias("kind"), "old", "new"), dtype)
            applied.append(now.join(done.where("what = 'go'").select("seq"), "seq", "left_semi").select("seq", "old", "new"))
            placed = done.where("what = 'stay'").select(F.col("place").alias("k"), F.col("origin").alias("row"))
            state = _stored(state.select("k").join(placed, "k", "left"))
            if left <= REPLAYED and len(applied) == 1:
                failed = done.where("what = 'bad'").select("seq", F.lit(KEY_CHANGE_ERROR).alias("reason"))
                break
            opened = opened.join(now.select("seq"), "seq", "left_anti")
            left, last = opened.count(), None
            continue
        keys = (state.join(_open_seqs(opened), "k")
                .select("k", F.col("row").isNotNull().alias("live"), "any", "out", "into",
                        F.lit(None).cast("bigint").alias("ins"), F.lit(None).cast("bigint").alias("del")))
        judged = _stored(_judged(opened, _stored(keys)))
        go = judged.where("go")
        applied.append(go.select("seq", "old", "new"))
        moved = go.select(F.col("old").alias("k"), F.lit(None).cast(dtype).alias("now")) \
            .union(go.join(state, go["old"] == state["k"]).select("new", "row")).withColumn("hit", F.lit(True))
        state = _stored(state.join(moved, "k", "left").select(
            "k", F.when(F.col("hit"), F.col("now")).otherwise(F.col("row")).alias("row")))
        opened = judged.where("NOT go AND NOT gone").select("seq", "old", "new")
        left, last = opened.count(), left
    else:
        failed = _duplicate_keys(valid, applied, start)
    moves = state.where("row IS NOT NULL AND row <> k").select(F.col("row").alias(key), F.col("k").alias("_new"))
    out = (snapshot.join(moves, key, "left")
           .withColumn(key, F.coalesce(F.col("_new"), F.col(key)).cast(dtype))
           .select(*snapshot.columns))
    bad = typed.where("old IS NULL OR new IS NULL").select(
        "seq", F.when(F.col("old").isNull(), F.lit(NO_KEY_ERROR)).otherwise(F.lit(KEY_CHANGE_ERROR)).alias("reason"))
    return out, bad.unionByName(failed)


#: Log rows that one task replays, a few dozen bytes each.
REPLAYED = 1_000_000


def _replayed(live: DataFrame, events: DataFrame, dtype) -> DataFrame:
    """Replay at most about ``REPLAYED`` events (seq, kind, old, new) on the keys
    ``live`` (k, row: where its row stood at first) in one sorted pass that only
    follows which row stands where. Kinds: move, insert, delete, update. Rows
    (what, seq, n, origin, place): ``stay``: row ``n`` (``origin``: its first key,
    or null and ``seq`` of its insert) ends at ``place``; ``touch``: the update
    ``seq`` meets row ``n``; ``go`` and ``bad``: the move ``seq`` took effect, or met
    a taken key."""
    kind = dtype.simpleString()

    def run(batches):
        at, rows, out = {}, [], []
        for batch in batches:
            for seq, what, old, new in zip(*(batch.column(c).to_pylist() for c in ("seq", "kind", "old", "new"))):
                if what == "live" or (what == "insert" and old not in at):
                    at[old] = len(rows)
                    rows.append((seq, new))
                elif what == "delete":
                    at.pop(old, None)
                elif what == "update" and old in at:
                    out.append(("touch", seq, at[old], None, None))
                elif what == "move" and old in at and old != new:
                    if new in at:
                        out.append(("bad", seq, None, None, None))
                    else:
                        at[new] = at.pop(old)
                        out.append(("go", seq, None, None, None))
        out += [("stay", rows[n][0], n, rows[n][1], key) for key, n in at.items()]
        for i in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out[i:i + 50_000]), (pa.string(), pa.int64(), pa.int64(), key_type, key_type))],
                names=["what", "seq", "n", "origin", "place"])

    key_type = to_arrow_type(dtype)
    first = live.select(F.lit(None).cast("bigint").alias("seq"), F.lit("live").alias("kind"), F.col("k").alias("old"),
                        F.col("row").alias("new"))
    ordered = (first.unionByName(events.select(F.col("seq").cast("bigint").alias("seq"), "kind", "old", "new"))
               .repartition(1).sortWithinPartitions("seq", "kind", "old", "new"))
    return _stored(ordered.mapInArrow(run, f"what string, seq bigint, n bigint, origin {kind}, place {kind}"))


VALID_RENAME = "old IS NOT NULL AND new IS NOT NULL AND old <> new"


def _typed_renames(renames: DataFrame, dtype) -> DataFrame:
    return _stored(renames.select("seq", F.col("key").cast(dtype).alias("old"),
                                  _typed(F.col("new_value"), dtype).alias("new")))


def _named(valid: DataFrame) -> DataFrame:
    """Every key that a rename leads from or to, once."""
    return valid.select(F.col("old").alias("k")).union(valid.select("new")).distinct()


def _open_seqs(opened: DataFrame) -> DataFrame:
    """Per key the smallest ``seq`` of the open renames that touch it, lead
    away from it and lead to it."""
    return (opened.select(F.col("old").alias("k"), "seq", F.col("seq").alias("out"))
            .unionByName(opened.select(F.col("new").alias("k"), "seq", F.col("seq").alias("into")),
                         allowMissingColumns=True)
            .groupBy("k").agg(F.min("seq").alias("any"), F.min("out").alias("out"), F.min("into").alias("into")))


def _judged(opened: DataFrame, keys: DataFrame) -> DataFrame:
    """Open renames with ``gone`` (it can no longer take effect: its old key
    is empty and no earlier rename or insert fills it, or its new key is taken
    and no earlier rename or delete frees it) and ``go`` (it takes effect now:
    not gone and the earliest open rename of both its keys). ``keys`` holds
    per key whether it is ``live`` before ``any``, its open renames' smallest
    seqs and those of its waiting inserts and deletes."""
    old = keys.select(*[F.col(c).alias("old" if c == "k" else f"o_{c}") for c in keys.columns])
    new = keys.select(*[F.col(c).alias("new" if c == "k" else f"n_{c}") for c in keys.columns])

    def earlier(c: str) -> Column:
        return F.coalesce(F.col(c) < F.col("seq"), F.lit(False))

    gone = (~F.col("o_live") & ~earlier("o_into") & ~earlier("o_ins")) \
        | (F.col("n_live") & ~earlier("n_out") & ~earlier("n_del"))
    go = ~gone & (F.col("o_any") == F.col("seq")) & (F.col("n_any") == F.col("seq"))
    return opened.join(old, "old").join(new, "new").select("seq", "old", "new", gone.alias("gone"), go.alias("go"))


def _stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back (cuts the lineage between rounds)."""
    path = scratch_dir(df.sparkSession, "renames")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _duplicate_keys(valid: DataFrame, applied: list[DataFrame], start: DataFrame,
                    edits: DataFrame | None = None) -> DataFrame:
    """Renames that were not applied although a row stood at their old key
    just before them. An as-of search for the last mark (applied rename,
    insert, delete) of the old key; a key's history is cut at quantiles of
    ``seq``, as many as the rows need, so that no task gets a hot key's whole
    history, and only one value a range is carried on to the next."""
    if not applied:
        return valid.select("seq", F.lit(KEY_CHANGE_ERROR).alias("reason")).limit(0)
    done = reduce(DataFrame.union, applied)
    asked = valid.join(done.select("seq"), "seq", "left_anti") \
        .select(F.col("old").alias("k"), "seq", F.lit(None).cast("boolean").alias("mark"), F.lit(True).alias("asked"))
    marks = done.select(F.col("old").alias("k"), "seq", F.lit(False).alias("mark")) \
        .union(done.select("new", "seq", F.lit(True)))
    if edits is not None:
        marks = marks.union(edits.where("op IN ('insert', 'delete')")
                            .select("key", "seq", (F.col("op") == "insert")))
    rows = _stored(marks.withColumn("asked", F.lit(False)).unionByName(asked))
    cuts = cut_points(rows, "seq")
    rows = rows.withColumn("range", bucket_expr(F.col("seq"), cuts) if cuts else F.lit(0))
    ends = rows.groupBy("k", "range").agg(
        F.max_by("mark", F.when(F.col("mark").isNotNull(), F.col("seq"))).alias("end"))
    carried = ends.select("k", "range", F.last("end", True).over(
        Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    last = rows.withColumn("last", F.last("mark", True).over(
        Window.partitionBy("k", "range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
    return (last.where("asked").join(carried, ["k", "range"])
            .join(start.select("k", F.lit(True).alias("initially")), "k", "left")
            .where(F.coalesce("last", "carried", "initially", F.lit(False)))
            .select("seq", F.lit(KEY_CHANGE_ERROR).alias("reason")))


# ------------------------------------------------------------------ M3

def update_customers(customer: DataFrame, updates: DataFrame) -> DataFrame:
    """M3: the profile form sets all four fields at once; the last update
    (by seq) per customer wins; unknown ids are no-ops."""
    fields = ["first_name", "last_name", "e_mail", "phone_num"]
    latest = _stored(updates.where("ID IS NOT NULL AND seq IS NOT NULL").groupBy(F.col("ID").alias("_key"))
                     .agg(F.max_by(F.struct(*fields), "seq").alias("_u")))
    joined = customer.join(latest, customer["ID"] == latest["_key"], "left")
    return joined.select(
        "ID", *[F.when(F.col("_key").isNotNull(), F.col(f"_u.{f}")).otherwise(F.col(f)).alias(f)
                for f in fields])


# ------------------------------------------------------------------ full fold

def _pivot_latest(updates: DataFrame, schema: StructType, key: str, prefix: str) -> DataFrame:
    """Per key, the last valid text of every property as ``<prefix><prop>``."""
    props = [f.name for f in schema.fields if f.name != key]
    latest = _latest_values(updates, schema, key)
    return latest.select(F.col("_key").alias("key"),
                         *[F.col(p).alias(f"{prefix}{p}") for p in props])


def _overlay(base_cols: dict, prefix: str, schema: StructType, key: str) -> list[Column]:
    """Row columns with the pivoted updates ``<prefix><prop>`` applied."""
    out = []
    for f in schema.fields:
        col = base_cols[f.name]
        if f.name != key:
            new = F.col(f"{prefix}{f.name}")
            col = F.when(new.isNotNull(), _typed(new, f.dataType)).otherwise(col)
        out.append(col.cast(f.dataType).alias(f.name))
    return out


def _fold(snapshot: DataFrame, log: DataFrame, key: str = "ID",
          schema: StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """Fold an ordered log of inserts, updates and deletes
    (``seq, op, key, property, new_value, row``) into a snapshot.

    For a key in the log let ``last_del`` be its last delete and
    ``start_ins`` its first insert after that. At the end the key is
      * the snapshot row with every valid update applied, if it was live and
        never deleted (inserts of a live key are no-ops);
      * otherwise the ``start_ins`` row with the updates after ``start_ins``;
      * otherwise absent.
    Everything per key is computed from the log alone (aggregates with
    partial aggregation; joins of the log salted, so a hot key's history is
    spread over tasks) and written to the shared folder. The snapshot is then
    read once: the planner sees the summary's real size, so a small one is
    broadcast before the snapshot would be shuffled; keys the log inserts
    fresh come in by a key-column-only anti join.
    Returns (snapshot, rejects(seq, reason))."""
    schema = schema or snapshot.schema
    cols = [f.name for f in schema.fields]
    rejects = _statement_errors(log, schema, key)
    log = log.where(F.col("key").isNotNull())
    per_key = log.groupBy("key").agg(
        F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("last_del"))
    inserts = (_met(log.where(F.col("op") == "insert"), per_key)
               .where(F.col("last_del").isNull() | (F.col("seq") > F.col("last_del")))
               .groupBy("key")
               .agg(F.min_by("row", "seq").alias("ins_row"), F.min("seq").alias("start_ins")))
    valid = _check_updates(log.where(F.col("op") == "update"), schema, key).where(F.col("_reject").isNull())
    # updates that apply to a never-deleted live row: all of them
    all_updates = _pivot_latest(valid, schema, key, "_all_")
    # updates that apply to an incarnation started by an insert
    after_ins = _pivot_latest(_met(valid, inserts.select("key", "start_ins"))
                              .where(F.col("seq") > F.col("start_ins")), schema, key, "_ins_")
    summary = _stored(per_key.join(inserts, "key", "left")
                      .join(all_updates, "key", "left")
                      .join(after_ins, "key", "left"))
    # one pass over the snapshot
    joined = snapshot.join(summary.withColumnRenamed("key", "_skey"),
                           snapshot[key] == F.col("_skey"), "left")
    kept = joined.where(F.col("_skey").isNull() | F.col("last_del").isNull()
                        | F.col("start_ins").isNotNull())
    snap_cols = {c: F.col(c) for c in cols}
    ins_cols = {c: F.col(f"ins_row.{c}") for c in cols}
    ins_cols[key] = F.col("_skey")
    as_snapshot = _overlay(snap_cols, "_all_", schema, key)
    as_insert = _overlay(ins_cols, "_ins_", schema, key)
    from_snapshot = kept.select(*[
        F.when(F.col("_skey").isNull(), F.col(c).cast(schema[c].dataType))
        .when(F.col("last_del").isNull(), a)
        .otherwise(b).alias(c)
        for c, a, b in zip(cols, as_snapshot, as_insert)])
    # keys the snapshot does not hold: only an insert can bring them in
    fresh = (summary.where(F.col("start_ins").isNotNull())
             .join(snapshot.select(F.col(key).alias("key")), "key", "left_anti")
             .withColumnRenamed("key", "_skey"))
    from_log = fresh.select(*_overlay(ins_cols, "_ins_", schema, key))
    return from_snapshot.unionByName(from_log), rejects


SALTS = 16


def _met(log: DataFrame, per_key: DataFrame) -> DataFrame:
    """``log`` joined with one row per key, on the key and a salt: a hot key's
    rows are spread over ``SALTS`` tasks, and the aggregation that follows is
    partial before its own exchange."""
    salted = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return log.withColumn("_salt", F.pmod(F.hash("seq"), F.lit(SALTS))).join(salted, ["key", "_salt"]).drop("_salt")


def _statement_errors(log: DataFrame, schema: StructType, key: str) -> DataFrame:
    """Log rows that fail whatever the table holds."""
    keyed = log.where(F.col("key").isNotNull())
    return (_check_updates(keyed.where(F.col("op") == "update"), schema, key)
            .where(F.col("_reject").isNotNull()).select("seq", F.col("_reject").alias("reason"))
            .unionByName(keyed.where(F.col("op").isNull() | ~F.col("op").isin("insert", "update", "delete"))
                         .select("seq", F.lit("unknown op").alias("reason")))
            .unionByName(log.where(F.col("key").isNull()).select("seq", F.lit(NO_KEY_ERROR).alias("reason"))))


def apply_changes(snapshot: DataFrame, log: DataFrame, key: str = "ID",
                  schema: StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """Fold an ordered change log (``seq, op, key, property, new_value,
    row``) into a snapshot: inserts, updates and deletes as in
    :func:`_fold`, plus key changes (``update`` of the key property).

    With key changes in the log, the keys they lead from or to are folded apart,
    the rest at once. Up to ``REPLAYED`` log rows of such keys are replayed in one
    pass that follows which row stands where (:func:`_replayed`); each row then
    gets the last valid updates that met it. More go in rounds: a round folds each such key's edits up to its
    earliest open key change, then applies or drops the key changes that can
    be judged (:func:`_judged`); only these keys' rows and edits are written
    between rounds. The result is that of applying the log one by one.
    Returns (snapshot, rejects(seq, reason))."""
    schema = schema or snapshot.schema
    dtype = schema[key].dataType
    unordered = log.where("seq IS NULL").select("seq", F.lit(NO_SEQ_ERROR).alias("reason"))
    log = log.where("seq IS NOT NULL")
    is_rename = (F.col("key").isNotNull() & F.col("op").eqNullSafe("update") & F.col("property").eqNullSafe(key))
    renames = log.where(is_rename)
    if renames.isEmpty():
        out, rejects = _fold(snapshot, log, key, schema)
        return out, rejects.unionByName(unordered)
    typed = _typed_renames(renames, dtype)
    valid = typed.where(VALID_RENAME)
    linked = _stored(_named(valid))
    on_key = F.col("key").cast(dtype) == F.col("k")
    edits = log.where(~is_rename)
    folded, _ = _fold(snapshot, edits.join(linked, on_key, "left_anti"), key, schema)
    linked_edits = _stored(edits.join(linked, on_key, "left_semi"))
    state = _stored(snapshot.join(linked, snapshot[key] == linked["k"], "left_semi"))
    errors = (_statement_errors(edits, schema, key).unionByName(unordered)
              .unionByName(typed.where("new IS NULL").select("seq", F.lit(BAD_VALUE_ERROR).alias("reason"))))
    rest = folded.join(linked, folded[key] == linked["k"], "left_anti")
    if linked_edits.count() + valid.count() <= REPLAYED:
        placed, failed = _replay_log(state, linked_edits, valid, key, schema)
        return rest.unionByName(placed), errors.unionByName(failed)
    start = state.select(F.col(key).alias("k"))
    opened, waiting, applied = valid, linked_edits, []
    while not opened.isEmpty():
        first = _stored(_open_seqs(opened))
        timed = waiting.join(first.select("k", "any"), on_key, "left")
        due = timed.where("any IS NULL OR seq < any").select(*waiting.columns)
        later = _stored(timed.where("seq > any").select(*waiting.columns))
        state = _stored(_fold(state, due, key, schema)[0])
        waits = later.groupBy(F.col("key").cast(dtype).alias("k")).agg(
            F.min(F.when(F.col("op") == "insert", F.col("seq"))).alias("ins"),
            F.min(F.when(F.col("op") == "delete", F.col("seq"))).alias("del"))
        keys = (first.join(waits, "k", "left")
                .join(state.select(F.col(key).alias("k"), F.lit(True).alias("live")), "k", "left")
                .withColumn("live", F.coalesce("live", F.lit(False))))
        judged = _stored(_judged(opened, _stored(keys)))
        go = judged.where("go")
        applied.append(go.select("seq", "old", "new"))
        moves = go.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        state = _stored(state.join(moves, state[key] == moves["_old"], "left")
                        .withColumn(key, F.coalesce("_new", key)).select(*state.columns))
        waiting = later
        opened = judged.where("NOT go AND NOT gone").select("seq", "old", "new")
    state, _ = _fold(state, waiting, key, schema)
    return rest.unionByName(state), errors.unionByName(_duplicate_keys(valid, applied, start, linked_edits))


def _replay_log(state: DataFrame, edits: DataFrame, moves: DataFrame, key: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The rows of the linked keys after all their edits and moves."""
    dtype, cols = schema[key].dataType, schema.names
    valid = _check_updates(edits.where(F.col("op") == "update"), schema, key).where(F.col("_reject").isNull())
    at = F.col("key").cast(dtype)
    events = (edits.where(F.col("op").isin("insert", "delete")).select("seq", F.col("op").alias("kind"), at.alias("old"))
              .unionByName(valid.select("seq", F.lit("update").alias("kind"), at.alias("old")))
              .withColumn("new", F.lit(None).cast(dtype))
              .unionByName(moves.select("seq", F.lit("move").alias("kind"), "old", "new")))
    done = _replayed(state.select(F.col(key).alias("k"), F.col(key).alias("row")), events, dtype)
    stay = done.where("what = 'stay'").select("n", F.col("seq").alias("_born"), F.col("origin").alias("_from"), F.col("place").alias("_place"))
    met = done.where("what = 'touch'").select("seq", "n")
    latest = _pivot_latest(valid.drop("key").join(met, "seq").withColumnRenamed("n", "key"), schema, key, "_new_") \
        .withColumnRenamed("key", "n")
    kept = stay.where("_from IS NOT NULL").join(state, F.col("_from") == state[key]).select("n", "_place", *cols)
    born = (stay.where("_from IS NULL").join(edits.where("op = 'insert'").select(F.col("seq").alias("_born"), "row"), "_born")
            .select("n", "_place", *[F.col(f"row.{c}").alias(c) for c in cols]))
    rows = kept.unionByName(born).join(latest, "n", "left")
    columns = {c: F.col(c) for c in cols} | {key: F.col("_place")}
    return (rows.select(*_overlay(columns, "_new_", schema, key)),
            done.where("what = 'bad'").select("seq", F.lit(KEY_CHANGE_ERROR).alias("reason")))


# ------------------------------------------------------------------ marks

def _as_marks(before: DataFrame, after: DataFrame, key) -> DataFrame:
    """The change from ``before`` to ``after`` (the same few keys' rows) as marks:
    the rows that are there afterwards, and a delete mark for each key that no
    longer is."""
    ks = _keys(key)
    gone = before.select(*ks).join(after.select(*ks), ks, "left_anti")
    return (after.withColumn("_alive", F.lit(True))
            .unionByName(gone.withColumn("_alive", F.lit(False)), allowMissingColumns=True))


def change_marks(snapshot: DataFrame, log: DataFrame, key: str = "ID",
                 schema: StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`apply_changes` as marks: only the rows whose keys the log names
    (or moves to) are read on into the fold, and only they come out.
    Returns (marks, rejects(seq, reason))."""
    schema = schema or snapshot.schema
    dtype = schema[key].dataType
    moved = log.where((F.col("op") == "update") & (F.col("property") == key)).select(_typed(F.col("new_value"), dtype).alias(key))
    named = (log.select(F.col("key").cast(dtype).alias(key)).union(moved)
             .where(F.col(key).isNotNull()).distinct())
    before = _stored(snapshot.join(_stored(named), key, "left_semi").select(*schema.names))
    after, rejects = apply_changes(before, log, key, schema)
    return _as_marks(before, _stored(after), key), rejects


# ------------------------------------------------------------------ cascades

def delete_purchases(purchase: DataFrame, ticket: DataFrame, purchase_ids: DataFrame) \
        -> tuple[DataFrame, DataFrame]:
    """M9: delete purchases and then each deleted purchase's ticket (ticket
    id 0 counts; the reference skips it as falsy, a slip we do not keep)."""
    doomed = purchase.join(purchase_ids.select("purchase_id"), "purchase_id", "left_semi")
    ticket_ids = doomed.where(F.col("ticket_id").isNotNull()).select(F.col("ticket_id").alias("ID"))
    return (purchase.join(purchase_ids.select("purchase_id"), "purchase_id", "left_anti"),
            ticket.join(ticket_ids, "ID", "left_anti"))


def delete_cust_of(cust_of: DataFrame, customer: DataFrame, pair_texts: DataFrame,
                   text_col: str = "pair_text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``"company,customer"`` texts delete the pair and then the
    customer itself, even when the pair was not linked. Malformed texts
    (not exactly two integers) change nothing and are rejected.
    Returns (cust_of, customer, rejects)."""
    comp, cust, ok = split_pair(F.col(text_col))
    parsed = pair_texts.select("*", comp.alias("company_id"), cust.alias("customer_id"),
                               ok.alias("_ok"))
    good = parsed.where(F.col("_ok"))
    new_cust_of = cust_of.join(good.select("company_id", "customer_id"),
                               ["company_id", "customer_id"], "left_anti")
    new_customer = customer.join(good.select(F.col("customer_id").alias("ID")), "ID", "left_anti")
    rejects = parsed.where(~F.col("_ok")).select(
        *[c for c in pair_texts.columns], F.lit(BAD_PAIR_ERROR).alias("reason"))
    return new_cust_of, new_customer, rejects


def rekey_parent_keys(parent: DataFrame, ticket_changes: DataFrame, property_name: str = "event_id") \
        -> tuple[DataFrame, DataFrame]:
    """M11 (opt-in, literal): after a ticket's ``event_id`` (or
    ``distributer_id``) changes, the reference runs
    ``UPDATE <parent> SET ID = <new> WHERE ID = <ticket id>`` -- keyed by the
    ticket's own id, one by one in the order of the changes. Values that do not
    convert are statement errors, a move onto a live key is a key error.
    Returns (parent, rejects(seq, reason))."""
    asked = ticket_changes.where(F.col("property") == property_name) \
        .select("seq", "key", F.round(clean_money("new_value"), 0).try_cast("bigint").cast("string").alias("new_value"))
    out, rejects = rename_keys(parent, asked.where("new_value IS NOT NULL"))
    bad = asked.where("new_value IS NULL").select("seq", F.lit(BAD_VALUE_ERROR).alias("reason"))
    return out, rejects.unionByName(bad)


def rekey_parents(parent: DataFrame, ticket_changes: DataFrame, property_name: str = "event_id") \
        -> DataFrame:
    """The parent table of :func:`rekey_parent_keys`."""
    return rekey_parent_keys(parent, ticket_changes, property_name)[0]


CASCADES = ("delete_purchase", "delete_pair", "insert_pair", "update_ticket")


def cascade_marks(t: Tables, log: DataFrame, rekey: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """M9, M10, M11 and pair edits in one ordered log (``seq, op, key, property,
    new_value``), as marks per table that is the log applied one by one:

    * ``delete_purchase`` (key): the purchase and its ticket;
    * ``delete_pair`` / ``insert_pair`` (new_value "company,customer"): the
      link, and with a delete the customer, even if the pair was not linked;
      a pair deleted and inserted again is there;
    * ``update_ticket`` (key, property, new_value): the ticket's property;
      with ``rekey`` event_id and distributer_id changes move the parent whose
      ID equals the ticket's, too.

    Only touched keys are read on: every step starts from a semi join of its
    table with the keys of the log. Returns (marks per table, rejects(seq,
    reason))."""
    known = F.col("op").isNotNull() & F.col("op").isin(*CASCADES)
    errors = log.select("seq", F.when(F.col("seq").isNull(), F.lit(NO_SEQ_ERROR)).when(~F.coalesce(known, F.lit(False)), F.lit("unknown op"))
                        .when(F.col("key").isNull() & F.col("op").isin("delete_purchase", "update_ticket"), F.lit(NO_KEY_ERROR))
                        .alias("reason")).where("reason IS NOT NULL")
    log = _stored(log.where("seq IS NOT NULL"))
    # purchases and their tickets
    ids = log.where("op = 'delete_purchase' AND key IS NOT NULL").select(F.col("key").alias("purchase_id")).distinct()
    doomed = _stored(t.purchase.join(ids, "purchase_id", "left_semi"))
    tickets_gone = doomed.where("ticket_id IS NOT NULL").select(F.col("ticket_id").alias("ID")).distinct()
    edits = log.where("op = 'update_ticket' AND key IS NOT NULL")
    touched = tickets_gone.union(edits.select("key")).distinct()
    tickets = _stored(t.ticket.join(touched, "ID", "left_semi"))
    edited, bad_edits = update_property(tickets.join(tickets_gone, "ID", "left_anti"), edits, schema=t.ticket.schema)
    # links and customers
    comp, cust, ok = split_pair(F.col("new_value"))
    pairs = _stored(log.where(F.col("op").isin("delete_pair", "insert_pair"))
                    .select("seq", "op", comp.alias("company_id"), cust.alias("customer_id"), F.coalesce(ok, F.lit(False)).alias("ok")))
    good = pairs.where("ok")
    last = good.groupBy("company_id", "customer_id").agg(F.max_by("op", "seq").alias("op"))
    links = _stored(t.cust_of.join(last, ["company_id", "customer_id"], "left_semi"))
    linked = last.where("op = 'insert_pair'").select("company_id", "customer_id")
    customers = _stored(t.customer.join(good.where("op = 'delete_pair'").select(F.col("customer_id").alias("ID")).distinct(),
                                        "ID", "left_semi"))
    marks = {"purchase": _as_marks(doomed, doomed.limit(0), "purchase_id"),
             "ticket": _as_marks(tickets, _stored(edited), "ID"),
             "cust_of": _as_marks(links, linked, ["company_id", "customer_id"]),
             "customer": _as_marks(customers, customers.limit(0), "ID")}
    rejects = [errors, bad_edits.select("seq", "reason"),
               pairs.where("NOT ok").select("seq", F.lit(BAD_PAIR_ERROR).alias("reason"))]
    if rekey:
        for name, prop in (("event_catalog", "event_id"), ("distributer", "distributer_id")):
            parent, moves = t.get(name), edits.where(F.col("property") == prop)
            new = F.round(clean_money("new_value"), 0).try_cast("bigint")
            keys = moves.select(F.col("key").alias("ID")).union(moves.select(new.alias("ID"))).where("ID IS NOT NULL").distinct()
            before = _stored(parent.join(_stored(keys), "ID", "left_semi"))
            after, bad = rekey_parent_keys(before, moves, prop)
            marks[name] = _as_marks(before, _stored(after), "ID")
            # values that do not convert are in the ticket's rejects already
            rejects.append(bad.where(F.col("reason") != BAD_VALUE_ERROR))
    return marks, reduce(DataFrame.unionByName, rejects)
