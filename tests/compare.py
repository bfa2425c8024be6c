"""Spark results against SQL results: same columns by name, same rows in any order."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb

SF = os.environ.get("TESSELLAR_SF", "/root/testdata/sf0.01")


def views(con: duckdb.DuckDBPyConnection, sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create or replace view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else float(f"{v:.12g}")
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return datetime.datetime(v.year, v.month, v.day)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def difference(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """Empty when equal, else what differs first."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        only = [r for r in got if r not in want][:3] if len(got) < 3000 else ""
        miss = [r for r in want if r not in got][:3] if len(want) < 3000 else ""
        return f"{len(got)} rows against {len(want)}: {only} / {miss}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} rows differ: {bad[:3]}" if bad else ""
