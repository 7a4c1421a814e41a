"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

    python tools/check_oracle.py [--sf DIR] [name ...]

Compares column names (sorted), row counts and the multiset of rows (values
normalised: floats rounded to 9 significant digits, dates/timestamps as ISO).
"""

from __future__ import annotations

import argparse
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from oracle_util import duck, norm, rows_of  # noqa: E402


def exact(v):
    """As :func:`norm`, but floats bit for bit."""
    return repr(v) if isinstance(v, float) else norm(v)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--tz", default=None, help="session time zone override")
    ap.add_argument("--exact", action="store_true", help="compare floats bit for bit, and types")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    value = exact if a.exact else norm

    from strata.plans import ORACLE, QUERIES
    from strata.session import build_session

    spark = build_session()
    if a.tz:
        spark.conf.set("spark.sql.session.timeZone", a.tz)
    con = duck(a.sf)
    names = a.names or sorted(QUERIES)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, a.sf)
            s_cols = df.columns
            cs = rows_of(s_cols, [tuple(r) for r in df.collect()], value)
        except Exception as e:  # noqa: BLE001
            print(f"{n}: SPARK ERROR {type(e).__name__}: {str(e)[:800]}")
            bad += 1
            continue
        t1 = time.time()
        if n not in ORACLE:
            print(f"{n}: rows={cs.total()} (no oracle) spark={t1 - t0:.1f}s")
            continue
        try:
            cur = con.execute(ORACLE[n])
            d_cols = [c[0] for c in cur.description]
            cd = rows_of(d_cols, cur.fetchall(), value)
        except Exception as e:  # noqa: BLE001
            print(f"{n}: DUCKDB ERROR {type(e).__name__}: {str(e)[:800]}")
            bad += 1
            continue
        ok_cols = sorted(s_cols) == sorted(d_cols)
        if a.exact:
            st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            dt_ = {c[0]: str(c[1]) for c in cur.description}
            m = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
            bad_t = {k: (st[k], dt_.get(k)) for k in st if m.get(st[k], st[k]) != dt_.get(k)}
            if bad_t:
                print(f"   types differ: {bad_t}")
        ok = ok_cols and cs == cd
        status = "OK" if ok else "MISMATCH"
        print(f"{n}: {status} rows spark={cs.total()} duck={cd.total()} "
              f"spark={t1 - t0:.1f}s")
        if not ok:
            bad += 1
            if not ok_cols:
                print("   spark cols", sorted(s_cols))
                print("   duck  cols", sorted(d_cols))
            only_s = list((cs - cd).elements())[:5]
            only_d = list((cd - cs).elements())[:5]
            print("   cols:", sorted(s_cols))
            print("   only spark:", only_s)
            print("   only duck: ", only_d)
    print(f"done: {len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
