"""Lookups with repeated keys, and the aggregate that removes duplicates."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators.lookups import LookupReport, checked_lookup, collapse_rows, reduced_lookup

ROWS = [(1, "a", 5), (2, "b", 6), (3, None, 7), (4, "zz", 8), (5, "a", None), (1, "a", 5)]
TABLE = [("a", 5, True, 3), ("a", 5, False, 1), ("a", 5, None, 2), ("b", 6, None, 1), ("b", 7, True, 1), (None, 7, True, 1), ("a", None, True, 1), ("c", 1, True, 1)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, code string, size int")


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(TABLE, "k1 string, k2 int, flag boolean, prio int").repartition(4)


def test_first_and_last_row_of_a_key(df, table):
    for rule, flag in (("first", False), ("last", True)):
        got = checked_lookup(df, table, [("code", "k1"), ("size", "k2")], {"export": "flag"}, rule=rule, order=["prio"], found="hit")
        assert got.columns == ["id", "code", "size", "export", "hit"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(
            [(1, "a", 5, flag, True), (1, "a", 5, flag, True), (2, "b", 6, None, True), (3, None, 7, None, False), (4, "zz", 8, None, False), (5, "a", None, None, False)], key=repr)


def test_repeated_key_ends_the_job_and_names_it(df, table):
    out = checked_lookup(df, table, [("code", "k1"), ("size", "k2")], {"export": "flag"}, name="export flags")
    with pytest.raises(Exception, match=r"export flags: repeated key .*\"k1\":\"a\""):
        out.collect()
    unique = table.where("prio = 1 and k2 is not null")
    got = checked_lookup(df, unique, [("code", "k1"), ("size", "k2")], {"export": "flag"}).collect()
    assert sorted((r.id, r.export) for r in got if r.code == "a" and r.size) == [(1, False), (1, False)] and len(got) == 6


def test_all_rows_of_a_key_without_equal_ones(df, table):
    twice = table.unionByName(table)
    got = checked_lookup(df, twice, [("code", "k1"), ("size", "k2")], {"export": "flag", "again": "flag"}, rule="all")
    ones = sorted(((r.export, r.again) for r in got.collect() if r.id == 1), key=repr)
    assert ones == sorted([(x, x) for x in (True, False, None)] * 2, key=repr)


def test_report_comes_with_the_job(df, table):
    report = LookupReport()
    checked_lookup(df, table, [("code", "k1"), ("size", "k2")], {"export": "flag"}, rule="first", order=["prio"], report=report).collect()
    assert report.counts == {"keys": 4, "repeated_keys": 1, "extra_rows": 2}
    empty = LookupReport()
    assert checked_lookup(df, table.limit(0), [("code", "k1")], {"x": "flag"}, report=empty).where("x is null").count() == 6


def test_a_hot_lookup_key_is_combined_before_the_shuffle(spark):
    hot = spark.range(0, 50_000, 1, 4).select(F.lit("k").alias("k1"), F.col("id").alias("prio"), (F.col("id") % 7).alias("v"))
    small = reduced_lookup(hot, ["k1"], ["v"], "last", ["prio"])
    assert [tuple(r) for r in small.collect()] == [("k", 49_999 % 7)]
    with pytest.raises(ValueError, match="none of"):
        reduced_lookup(hot, ["k1"], ["v"], "any")


def test_collapse_keeps_null_places_apart_and_any_value_does_not_depend_on_order(spark):
    rows = [(None, "a", 1, 5, "x"), ("a", None, 1, 5, "x"), ("a", None, 1, 4, "y"), ("a", "", 1, None, "a"), ("a", "", 1, 9, "a"), ("", "a", 2, 1, None), (None, None, None, None, None)]
    seen = set()
    for seed in range(4):
        mixed = random.Random(seed).sample(rows * 2, len(rows) * 2)
        df = spark.createDataFrame(mixed, "p string, q string, n int, v int, tag string").repartition(seed + 1)
        out = collapse_rows(df, {"v": ["tag"]}, drop=["tag"])
        assert out.columns == ["p", "q", "n", "v"]
        seen.add(tuple(sorted(map(tuple, out.collect()), key=repr)))
    assert seen == {tuple(sorted([(None, "a", 1, 5), ("a", None, 1, 5), ("a", "", 1, 9), ("", "a", 2, 1), (None, None, None, None)], key=repr))}


def test_collapse_shuffles_on_the_key(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "a int, b string, c double")
    plan = collapse_rows(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__k1" in plan and "hashpartitioning(a" not in plan
    assert collapse_rows(df.limit(0)).collect() == []
