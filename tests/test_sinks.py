"""Catalog tables end to end: replace, create once, declared schema and insert, reading by name."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import alloc, intervals, perf
from strata.sources.sinks import declare_table, insert_into, save_table
from strata.sources.tables import CatalogTables


@pytest.fixture
def name(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS strata_test")
    yield "strata_test.region"
    spark.sql("DROP DATABASE strata_test CASCADE")


def test_replace_create_once_and_read_by_name(spark, name):
    a = spark.createDataFrame([(1, "x")], "r_regionkey int, r_name string")
    save_table(a, name)
    save_table(a.withColumn("r_name", F.lit("y")), name, mode="ignore")
    assert CatalogTables(spark, "strata_test").region.first().r_name == "x"
    save_table(a.withColumn("r_name", F.lit("z")), name)
    assert [r.r_name for r in CatalogTables(spark, "strata_test").table("region").collect()] == ["z"]


def test_declared_schema_and_insert(spark, name):
    schema = T.StructType([T.StructField("b", T.DoubleType()), T.StructField("a", T.IntegerType())])
    declare_table(spark, name, schema)
    assert spark.table(name).count() == 0
    insert_into(spark.createDataFrame([(1, "2.5")], "a long, b string"), name)
    insert_into(spark.createDataFrame([(7, "8")], "a long, b string"), name)
    assert sorted(map(tuple, spark.table(name).collect())) == [(2.5, 1), (8.0, 7)]
    assert [f.dataType for f in spark.table(name).schema] == [T.DoubleType(), T.IntegerType()]


def test_performance_of_an_id_with_several_periods(spark):
    D = dt.date
    rows = [(1, "m", 10.0, "RF", D(2024, 1, 1), None), (1, "m", 5.0, "SF", D(2024, 1, 1), None), (2, None, 3.0, "SF", D(2024, 1, 1), None),
            (3, "m", 1.0, None, D(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "id long, kind string, v double, run string, s date, e date")
    settle = spark.createDataFrame([("RF", D(2024, 2, 1))], "run string, settlement_date date")
    got = perf.multi_run_performance(df, "id", "kind", "v", "run", "s", "e", [("rf", ["RF"])], settle)
    assert sorted(map(tuple, got.collect())) == [(1, "m", 5.0, 1, 10.0, 1, 15.0, 2, 5.0 / 15.0), (2, None, 3.0, 1, 0.0, 0, 3.0, 1, 1.0)]
    plain = perf.multi_run_performance(df, "id", "kind", "v", "run", "s", "e", [("rf", ["RF"])], settle, null_safe=False)
    assert [tuple(r) for r in plain.collect() if r.id == 2] == [(2, None, *[None] * 7)]


def test_repeated_lookup_keys_do_not_multiply_rows(spark):
    D = dt.date
    per = spark.createDataFrame([(1, 1, D(2024, 1, 1), None)], "pk long, id long, start_date date, end_date date")
    cp = spark.createDataFrame([(1, D(2024, 1, 5)), (1, D(2024, 1, 9))], "id long, cp_date date")
    ev = spark.createDataFrame([(1, dt.datetime(2024, 1, d)) for d in (2, 7, 9, 20)], "id long, ts timestamp_ntz")
    got = intervals.count_since_checkpoint(per, cp, ev, "pk", "id", "start_date", "end_date", "ts", "cp_date", D(2024, 6, 1)).collect()
    assert [r.count_since_checkpoint for r in got] == [2]
    cases = spark.createDataFrame([(1, "a", "T", "Open", "LoneCase", "s")], "id long, owner string, team string, status string, kind string, subject string")
    cap = spark.createDataFrame([("a", 5.0), ("a", 8.0)], "owner string, hours double")
    assert [(r.open_count, r.hours) for r in alloc.owner_workload(cases, cap).collect()] == [(1, 8.0)]
