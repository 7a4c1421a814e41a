
from decimal import Decimal

from pyspark.sql import functions as F
from oracle_util import SF_SMALL

from strata.operators import alloc, groups
from strata.plans import fixtures as fx
from strata.plans import q_alloc, q_groups
from strata.sources.tables import Tables


def test_intervals_are_disjoint_and_contiguous(spark):
    iv = sorted(fx.intervals(Tables(spark, SF_SMALL)).collect(), key=lambda r: (r.max_date, r.run))
    assert iv[0].min_date.isoformat() == "1900-01-01"
    for a, b in zip(iv, iv[1:]):
        assert (b.min_date - a.max_date).days == 1


def test_groups_partition_the_base(spark):
    t = Tables(spark, SF_SMALL)
    base = {r.id for r in q_groups.r2_base(t).collect()}
    got = [r.id for r in q_groups.assigned_groups(t).collect()]
    assert len(got) == len(set(got)) and set(got) == base


def test_quota_sample_respects_quotas(spark):
    t = Tables(spark, SF_SMALL)
    base = q_groups.r2_base(t)
    total = base.agg(F.sum("r2_total_count")).first()[0]
    g1 = q_groups.group1(t, base).groupBy("perf_bucket").agg(F.sum("r2_total_count").alias("s"))
    for r in g1.collect():
        assert Decimal(r.s) <= Decimal(q_groups.QUOTAS[r.perf_bucket]) * total


def test_apportion_assigns_every_item_once_and_fairly(spark):
    t = Tables(spark, SF_SMALL)
    items = alloc.unassigned(fx.cases(t), ["LoneCase", "ChildCase"])
    wl = alloc.owner_workload(fx.cases(t), fx.capacity(spark))
    out = alloc.apportion(items, wl, fx.SEED)
    ids = [r.id for r in out.collect()]
    weighted_teams = {r.adjusted_team for r in wl.filter("hours > 0").collect()}
    expect = {r.id for r in items.collect() if r.adjusted_team in weighted_teams}
    assert len(ids) == len(set(ids)) and set(ids) == expect
    n = {r.adjusted_team: r.c for r in items.groupBy("adjusted_team").agg(F.count("*").alias("c")).collect()}
    shares = alloc.agent_weights(wl).collect()
    got = {(r.assigned_agent, r.adjusted_team): r.c for r in
           out.groupBy("assigned_agent", "adjusted_team").agg(F.count("*").alias("c")).collect()}
    for w in shares:
        assert abs(got.get((w.owner, w.adjusted_team), 0) - w.normalized_weight * n.get(w.adjusted_team, 0)) <= 1


def test_results_do_not_depend_on_partitioning(spark):
    t = Tables(spark, SF_SMALL)
    rem = q_groups.remainder(t)

    def deal(df):
        d = groups.banded_deal(df, "r2_performance", [F.col("r2_performance").desc_nulls_last()],
                               "r2_total_count", [F.col("id").asc()], 9, 9, 2)
        return sorted((r.id, r.grp) for r in d.collect())

    assert deal(rem.repartition(1)) == deal(rem.repartition(17)) == deal(rem.orderBy(F.rand(3)))
    q = q_alloc.q_apportion(spark, SF_SMALL)
    a = sorted((r.id, r.assigned_agent) for r in q.collect())
    items = alloc.unassigned(fx.cases(t), ["LoneCase", "ChildCase"]).repartition(13)
    wl = alloc.owner_workload(fx.cases(t), fx.capacity(spark))
    b = sorted((r.id, r.assigned_agent) for r in alloc.apportion(items, wl, fx.SEED).collect())
    assert a == b


def test_hot_key_is_spread_by_the_binned_join(spark):
    """A key holding a third of all events is spread over many shuffle
    partitions by the (key, time bin) join instead of landing in one task."""
    import datetime as dt

    from strata.operators.intervals import interval_join
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        start = dt.datetime(2020, 1, 1)
        ev = spark.range(30000).select(
            F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500).alias("k"),
            (F.lit(start) + F.make_dt_interval(days=(F.col("id") % 700).cast("int"))).alias("ts"))
        ev = ev.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        per = spark.range(500).select(F.col("id").alias("pk"), F.col("id").alias("rk"),
                                      F.lit(dt.date(2020, 1, 1)).alias("lo"),
                                      F.lit(dt.date(2021, 12, 31)).alias("hi"))
        pairs = interval_join(ev, per, "k", "ts", "lo", "hi", bin_days=30, range_key="rk")
        dist = [r.c for r in pairs.groupBy(F.spark_partition_id().alias("p"))
                .agg(F.count("*").alias("c")).collect()]
        assert sum(dist) == 30000
        assert len(dist) >= 12 and max(dist) < 0.25 * sum(dist)
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
