"""Benchmark: run every registered query at one scale factor.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]

Each query is run to completion into Spark's ``noop`` sink (full
computation, no collect to the driver). The JVM is warmed once (flagship
query twice), then each query is timed BENCH_REPS times (default 2) and the
median is reported. Prints ONE JSON line:
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "2"))
    names = sys.argv[1:]

    from strata.plans import QUERIES
    from strata.session import build_session, release_tables

    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus)))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=parts)
    names = names or sorted(QUERIES)
    for _ in range(2):  # JVM / code-generation warm-up
        QUERIES["q_interval_bucket"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        try:
            runs = []
            for _ in range(reps):
                t0 = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - t0)
                release_tables(spark)
            timings[name] = round(statistics.median(runs), 3)
        except Exception as e:  # noqa: BLE001 - report and continue
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"{name}: {timings.get(name, errors.get(name))}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "sum_of_median_query_latency", "value": round(sum(timings.values()), 3),
           "unit": "sec", "queries": timings, "sf": sf, "cpus": cpus, "reps": reps,
           "spark_conf": {"spark.sql.shuffle.partitions": parts,
                          "spark.sql.adaptive.enabled": True}}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
