"""The one-pass performance table against the two-sided one, where labels of nulls and literals clash."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strata.operators.perf import group_performance, one_pass_performance

DAY = dt.date(2024, 6, 1)


def rows(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, "unknown", "a", "b"]), rng.choice([None, "unknown", "x"]), rng.choice([None, 1.25, -3.5, 0.005, 7.0]), rng.choice([None, "RF", "R3", "II", "SF"]),
             rng.choice([None, dt.date(2024, 1, 1), dt.date(2025, 1, 1)]), rng.choice([None, dt.date(2024, 3, 1), dt.date(2024, 6, 1)])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "n"), [(1, 0), (2, 5), (3, 40), (4, 400)])
@pytest.mark.parametrize("keys", [["k1"], ["k1", "k2"]])
@pytest.mark.parametrize("day", [DAY, None])
def test_same_rows(spark, seed, n, keys, day):
    df = spark.createDataFrame(rows(seed, n), "k1 string, k2 string, v double, run string, s date, e date")
    args = (keys, "v", "run", ["RF", "R3"], F.lit(day).cast("date"), "s", "e")
    got, want = (sorted(map(tuple, f(df, *args, prefix="p_").collect()), key=repr) for f in (one_pass_performance, group_performance))
    assert got == want
    assert one_pass_performance(df, *args).columns == group_performance(df, *args).columns


def test_rows_are_read_and_dealt_out_once(spark, tmp_path):
    spark.createDataFrame(rows(7, 200), "k1 string, k2 string, v double, run string, s date, e date").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = one_pass_performance(df, ["k1", "k2"], "v", "run", ["RF"], F.lit(DAY), "s", "e")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # partial sums by group, then one row per group by label
