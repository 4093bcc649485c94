"""Spark-vs-DuckDB comparison used by the oracle tests (same idea as the
driver's gate: column names, row count, order-insensitive values)."""

from __future__ import annotations

import datetime as dt
import decimal
import os

import duckdb

DRIVER_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                "events", "documents", "embeddings", "pages", "benchmark", "labels",
                "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for v in DRIVER_VIEWS:
        p = os.path.join(sf_dir, f"{v}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        return ("f", round(v, 9))
    if isinstance(v, decimal.Decimal):
        return ("d", str(v))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    return ("v", v)


def _key(row):
    return tuple((x is None, str(x)) for x in row)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE", "boolean": "BOOLEAN"}


def spark_types(df):
    out = []
    for f in df.schema.fields:
        s = f.dataType.simpleString()
        out.append(SPARK_TO_DUCK.get(s, s.upper()))
    return out


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    s_cols = spark_df.columns
    s_types = spark_types(spark_df)
    s_rows = spark_df.collect()
    rel = con.sql(sql)
    d_cols = rel.columns
    d_types = [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: {s_cols} vs {d_cols}"
    st = dict(zip(s_cols, s_types))
    dty = dict(zip(d_cols, d_types))
    bad = {c: (st[c], dty[c]) for c in s_cols if st[c] != dty[c]}
    if bad:
        return False, f"types differ: {bad}"
    if len(s_rows) != len(d_rows):
        return False, f"row count {len(s_rows)} vs {len(d_rows)}"
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    sn = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=_key)
    dn = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=_key)
    if sn != dn:
        diff = [(a, b) for a, b in zip(sn, dn) if a != b][:3]
        return False, f"values differ, e.g. {diff}"
    return True, f"{len(s_rows)} rows"
