"""Spark-vs-DuckDB comparison used by the tests (small fixtures only)."""

from __future__ import annotations

import datetime as _dt
import math
import os

import duckdb
import pandas as pd

STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in STAR_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t + '.parquet')}')")
    return con


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, _dt.date) and not isinstance(v, _dt.datetime):
        return _dt.datetime(v.year, v.month, v.day)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return v.item()
        except Exception:
            return v
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return out


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) for v in row)


def compare(spark_df, con, sql: str, ordered: bool = False, float_tol: float = 0.0):
    """Return (ok, message). Columns compared by name; rows as multisets."""
    s = spark_df.toPandas()
    d = con.execute(sql).df()
    if sorted(s.columns) != sorted(d.columns):
        return False, f"columns differ: {sorted(s.columns)} vs {sorted(d.columns)}"
    rs, rd = rows_of(s), rows_of(d)
    if len(rs) != len(rd):
        return False, f"row count {len(rs)} vs {len(rd)}"
    if not ordered:
        rs, rd = sorted(rs, key=_key), sorted(rd, key=_key)
    for i, (a, b) in enumerate(zip(rs, rd)):
        for j, (x, y) in enumerate(zip(a, b)):
            if x == y:
                continue
            if isinstance(x, float) and isinstance(y, float) and float_tol and abs(x - y) <= float_tol:
                continue
            col = sorted(s.columns)[j]
            return False, f"row {i} col {col}: {x!r} vs {y!r}\n spark={a}\n duck={b}"
    return True, f"{len(rs)} rows equal"
