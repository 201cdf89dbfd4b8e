"""Runs a query and its SQL over the same folder and compares rows and values."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(p)[: -len(".parquet")]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "∅"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.6g}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows_of(frame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False))


def difference(spark, folder: str, f, sql: str, con=None) -> str:
    """Empty if both agree, else what differs."""
    got, want = f(spark, folder).toPandas(), (con or connect(folder)).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"rows {len(a)} and {len(b)}; only here {[x for x in a if x not in set(b)][:3]}; only there {[x for x in b if x not in set(a)][:3]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} differ: {bad[0]}"[:1500] if bad else ""
