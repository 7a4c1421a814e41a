"""Tables stored for filters: what comes back, and how little is read for it."""

import datetime as dt

import pytest
from oracle_util import SF_SMALL
from pyspark.sql import functions as F

from strata.operators.position import drill_down
from strata.plans.q_full_position import DRILL_DAY, stored_position
from strata.sources.layout import read_layout, write_layout
from strata.sources.tables import Tables


def scanned(df):
    """Files and rows read by a plan without exchanges."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    return int(leaf.metrics().apply("numFiles").value()), int(leaf.metrics().apply("numOutputRows").value())


@pytest.fixture(scope="module")
def table(spark):
    flag = F.when(F.col("id") % 3 == 0, F.lit(True)).when(F.col("id") % 3 == 1, F.lit(False))
    return spark.range(0, 30_000).select("id", flag.alias("flag"), F.concat(F.lit("c"), (F.col("id") % 40).cast("string")).alias("who"),
                                         F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 365).cast("int")).alias("day"))


def test_rows_types_and_order_of_columns_come_back(spark, table):
    path = write_layout(table, ["flag"], ["who", "day"], ranges=8)
    back = read_layout(spark, path)
    assert back.schema.simpleString() == table.schema.simpleString()
    assert back.exceptAll(table).isEmpty() and table.exceptAll(back).isEmpty()
    assert back.where("flag is null").count() == 10_000


def test_filters_leave_out_folders_files_and_row_groups(spark, table):
    back = read_layout(spark, write_layout(table, ["flag"], ["who", "day"], ranges=12))
    all_files, all_rows = scanned(back)
    files, rows = scanned(back.where(~F.col("flag")))
    assert 0 < files < all_files and rows == 10_000
    one = back.where(~F.col("flag") & (F.col("who") == "c7"))
    assert scanned(one)[1] < 10_000 / 2 and one.count() == table.where("not flag and who = 'c7'").count() > 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(flag" in plan and "EqualTo(who,c7)" in plan


def test_a_join_to_few_partition_values_prunes_at_run_time(spark, table):
    back = read_layout(spark, write_layout(table, ["who"], ["id"], ranges=8))
    few = spark.createDataFrame([(f"c{i}", i) for i in range(40)], "who string, size int").where("size > 37")
    plan = back.join(F.broadcast(few), "who")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_drill_down_reads_fewer_files_and_tells_null_from_false(spark):
    back = read_layout(spark, stored_position(Tables(spark, SF_SMALL)))
    all_files, _ = scanned(back)
    asked = drill_down(back, DRILL_DAY, "NATION_3", "N", "Commercial")
    files, rows = scanned(asked)
    assert files < all_files and rows < back.count()
    flags = {r.export_indicator for r in back.select("export_indicator").distinct().collect()}
    assert flags == {True, False, None}
    schema = "pk long, customer_name string, meter_type string, customer_type string, affecting boolean, export_indicator boolean, run string, start_date date, end_date date"
    D = dt.date
    base = ("n", "N", "Commercial", True, False, "R1", D(2000, 1, 1), None)
    rows = [base, *(base[:i] + (x,) + base[i + 1:] for i, x in ((0, None), (1, "R"), (2, "Domestic"), (3, False), (3, None), (4, True), (4, None), (5, "RF"), (5, None),
                                                                (6, D(2000, 7, 8)), (7, D(2000, 7, 6))))]
    rows += [base[:6] + (DRILL_DAY, DRILL_DAY)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
    assert sorted(r.pk for r in drill_down(df, DRILL_DAY, "n", "N", "Commercial").collect()) == [0, len(rows) - 1]


def test_empty_table(spark, table):
    back = read_layout(spark, write_layout(table.limit(0), ["flag"], ["who"]))
    assert back.columns == table.columns and back.count() == 0
