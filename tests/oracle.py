"""Compare a query with its SQL twin in DuckDB."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def same(df, sql, con):
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    left = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    right = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert len(left) == len(right)
    assert [(a, b) for a, b in zip(left, right, strict=True) if a != b][:3] == []
