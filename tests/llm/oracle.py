"""Spark result against oracle SQL on DuckDB, as multisets of rows."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _norm(v):
    if isinstance(v, float):
        return float(f"{v:.12g}")
    return tuple(map(_norm, v)) if isinstance(v, list | tuple) else v


def compare(spark, sf_dir, fn, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    out = con.execute(sql)
    names = sorted(d[0] for d in out.description)
    at = [[d[0] for d in out.description].index(n) for n in names]
    want = Counter(tuple(_norm(r[i]) for i in at) for r in out.fetchall())
    df = fn(spark, sf_dir)
    assert sorted(df.columns) == names
    got = Counter(tuple(_norm(r[n]) for n in names) for r in df.collect())
    assert got == want, (sum(got.values()), sum(want.values()), list((got - want))[:3], list((want - got))[:3])
    return sum(got.values())
