"""Stored tables: replaced as a whole, created once, in a kept order; what a write that ends half-way leaves behind."""

import os
import threading

import pytest
from oracle_util import SF_SMALL
from pyspark.sql import functions as F

from strata.plans import QUERIES
from strata.session import ensure_checkpoint_dir, materialize, release_tables
from strata.sources.ranked import read_ranked, write_ranked
from strata.sources.versions import Conflict, VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"))


def rows(df):
    return sorted(r.id for r in df.collect())


def test_replace_and_earlier_versions(spark, table):
    assert table.version is None
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.replace(spark.range(3)) == 1
    assert table.replace(spark.range(5).repartition(3)) == 2
    assert rows(table.read()) == [0, 1, 2, 3, 4] and rows(table.read(1)) == [0, 1, 2]
    assert table.replace(table.read().where("id > 2")) == 3  # from its own rows
    assert rows(table.read()) == [3, 4]
    gone = table.vacuum(keep=2)
    assert len(gone) == 1 and rows(table.read()) == [3, 4] and rows(table.read(2)) == [0, 1, 2, 3, 4]
    with pytest.raises(FileNotFoundError):
        table.read(1)


def test_a_write_that_fails_half_way_leaves_the_table_as_it_was(spark, table, tmp_path):
    table.replace(spark.range(4))
    before = table.read()
    # the last task fails after others have written
    bad = spark.range(0, 1000, 1, 8).withColumn("id", F.when(F.col("id") == 999, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        table.replace(bad)
    assert table.version == 1 and rows(table.read()) == rows(before) == [0, 1, 2, 3]
    assert table.replace(spark.range(2)) == 2 and rows(table.read()) == [0, 1]
    assert len(table.vacuum()) >= 1 and rows(table.read()) == [0, 1]


def test_a_writer_killed_before_or_while_it_commits(spark, table, tmp_path):
    table.replace(spark.range(4))
    spark.range(9).write.parquet(str(tmp_path / "t" / "v00000002-abandoned"))  # rows, but no entry
    assert rows(table.read()) == [0, 1, 2, 3]
    (tmp_path / "t" / "_log" / "00000002.json").write_text('{"version": 2, "fol')  # half an entry
    assert table.version == 1 and rows(table.read()) == [0, 1, 2, 3]
    with pytest.raises(Conflict):
        table.replace(spark.range(5))  # its place in the log is taken
    assert rows(table.read()) == [0, 1, 2, 3]


def test_two_writers_of_one_version(spark, table):
    table.replace(spark.range(1))
    gate, seen = threading.Barrier(2), []

    def write(n):
        own = VersionedTable(spark, table.path)
        read = type(own).version.fget
        kind = type("Paused", (VersionedTable,), {"version": property(lambda self: (read(self), gate.wait())[0])})
        try:
            seen.append(kind(spark, table.path).replace(spark.range(n)))
        except Conflict:
            seen.append("conflict")

    threads = [threading.Thread(target=write, args=(n,)) for n in (3, 4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, seen)) == ["2", "conflict"] and table.version == 2


def test_create_once_knows_a_stale_snapshot(spark, table, tmp_path):
    source, built = str(tmp_path / "in"), []

    def build():
        built.append(1)
        return spark.read.parquet(source).select("id")

    spark.range(3).write.parquet(source)
    inputs = lambda: [spark.read.parquet(source)]
    assert rows(table.create_once(build, inputs())) == [0, 1, 2] == rows(table.create_once(build, inputs()))
    assert len(built) == 1 and not table.is_stale(inputs())
    spark.range(10, 12).write.mode("append").parquet(source)
    assert table.is_stale(inputs())
    assert rows(table.create_once(build, inputs())) == [0, 1, 2, 10, 11] and len(built) == 2 and table.version == 2


def test_partitioned_version(spark, table):
    table.replace(spark.range(10).withColumn("k", F.col("id") % 2), partition_by=["k"])
    plan = table.read().where("k = 1")
    assert rows(plan) == [1, 3, 5, 7, 9] and "PartitionFilters: [isnotnull(k" in plan._jdf.queryExecution().executedPlan().toString()


def test_order_is_kept_and_pages_read_few_files(spark, tmp_path):
    df = spark.range(0, 5000, 1, 7).select("id", F.when(F.col("id") % 50 != 0, F.col("id") % 97).alias("v"))
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    path = write_ranked(df, order, str(tmp_path / "r"), ranges=10)
    got = [(r.position, r.id, r.v) for r in read_ranked(spark, path).collect()]
    want = sorted(((i, None if i % 50 == 0 else i % 97) for i in range(5000)), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert got == [(n + 1, *x) for n, x in enumerate(want)]
    page = read_ranked(spark, path, 1001, 1010)
    assert [r.position for r in page.collect()] == list(range(1001, 1011))
    scan = spark.read.parquet(path).where("position between 1001 and 1010")
    scan.collect()
    read = scan._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()
    assert read <= 5000 / 5  # row groups are left out by their positions
    assert read_ranked(spark, write_ranked(df.limit(0), order)).collect() == []


def test_ranked_query_comes_in_order(spark):
    got = QUERIES["q_ranked_performance"](spark, SF_SMALL).collect()
    assert [r.position for r in got] == list(range(1, len(got) + 1)) and len(got) > 3
    errors = [r.rf_volume_error for r in got if r.rf_volume_error is not None]
    assert errors == sorted(errors, reverse=True) and all(r.rf_volume_error is None for r in got[len(errors):])


def test_released_tables_are_gone_and_later_ones_stay(spark):
    release_tables(spark)
    a, b = materialize(spark.range(3)), materialize(spark.range(4))
    paths = [df.inputFiles()[0].removeprefix("file://") for df in (a, b)]
    assert release_tables(spark) == 2 and not any(os.path.exists(p) for p in paths)
    c = materialize(spark.range(5))
    assert c.count() == 5 and release_tables(spark) == 1 and release_tables(spark) == 0


def test_a_scratch_folder_is_made_in_one_jvm_only():
    class Fake:
        class sparkContext:
            master = "local-cluster[2,1,1024]"

            class _jsc:
                sc = staticmethod(lambda: type("C", (), {"getCheckpointDir": staticmethod(lambda: type("N", (), {"isDefined": staticmethod(lambda: False)}))}))

        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir is not set"):
        ensure_checkpoint_dir(Fake)
