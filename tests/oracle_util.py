"""Spark-vs-DuckDB comparison used by the tests (same rules as the driver:
column names, row count, order-insensitive multiset of values)."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

from strata.sources.tables import TABLE_NAMES

SF_SMALL = "/root/testdata/sf0.001"


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows, value=norm):
    """The multiset of rows, columns in the order of their names, values through ``value``."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(value(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = rows_of(s_cols, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = rows_of(d_cols, cur.fetchall())
    return sorted(s_cols) == sorted(d_cols), s_rows == d_rows, (s_rows - d_rows, d_rows - s_rows)
