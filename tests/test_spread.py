"""Tasks whose rows do not grow with the tables: sized shuffles, broadcast code tables."""

from pyspark.sql import functions as F

from strata.operators import ordered
from strata.operators.history import describe_events
from strata.operators.lookups import checked_lookup
from strata.operators.rows import flatten_hierarchy


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spread_follows_the_size_of_the_tables(spark, tmp_path, monkeypatch):
    spark.range(20_000).withColumn("k", F.col("id") % 977).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert ordered.spread(df, "k") is df
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(ordered, "RANGE_BYTES", 1024)
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    dealt = ordered.spread(df, "k")
    assert dealt.rdd.getNumPartitions() == size // 1024 > session
    assert sorted(dealt.collect()) == sorted(df.collect())


def test_events_are_not_dealt_out_by_code(spark):
    events = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, "A").otherwise("N").alias("code"))
    codes = spark.createDataFrame([("A", "accepted"), ("N", "no"), ("N", "no")], "code string, description string")
    out = describe_events(events, codes, "code", "code", "description", ["N"])
    assert "BroadcastHashJoin" in _plan(out) and "SortMergeJoin" not in _plan(out)
    assert out.groupBy("audit_status").count().orderBy("audit_status").collect() == [("Auditable", 67), ("Non-Auditable", 133)]


def test_hierarchy_is_not_dealt_out_by_code(spark):
    top = spark.range(3).select(F.col("id").alias("a"))
    leaf = spark.range(60).select((F.col("id") % 3).alias("b"), F.when(F.col("id") % 2 == 0, "F").otherwise("X").alias("code"))
    codes = spark.createDataFrame([("F", "fulfilled")], "c string, description string")
    out = flatten_hierarchy(top, [(leaf, top.a == leaf.b)], codes, "code", "c", ["F"], "flag", ["a", "description"])
    assert "hashpartitioning(code" not in _plan(out)
    assert sorted(out.collect()) == [(i, "fulfilled", "Non-Auditable") for i in range(3)]


def test_a_lookup_of_few_keys_is_broadcast(spark):
    df = spark.range(50).withColumn("area", F.col("id") % 2)
    areas = spark.createDataFrame([(0, "x"), (1, "y"), (1, "y")], "area long, handler string").groupBy("area").agg(F.max("handler").alias("handler"))
    out = checked_lookup(df, areas, [("area", "area")], {"handler": "handler"}, few=True)
    assert "BroadcastHashJoin" in _plan(out) and out.where("handler = 'y'").count() == 25
