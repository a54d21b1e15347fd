"""Row-by-row comparison of a Spark query with its SQL counterpart in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{src}')")
    return con


def _value(v):
    if isinstance(v, decimal.Decimal):
        return float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else float(f"{v:.9g}"))
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_value(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """'' when both results are equal, else what differs."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    exp_cols, exp = rows_of(rel.columns, rel.fetchall())
    if got_cols != exp_cols:
        return f"columns {got_cols} against {exp_cols}"
    if got != exp:
        a, b = set(map(repr, got)), set(map(repr, exp))
        return f"{len(got)} rows against {len(exp)}; only Spark {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
    return "" if got else "no rows"
