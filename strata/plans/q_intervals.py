"""Queries over validity periods: intervals, buckets, events in periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.functions.columns import keep_unless_excluded, later_of
from strata.operators.intervals import bucket_by_interval
from strata.operators.rows import latest_per_key, preferred_row
from strata.operators.sweep import facts_in_period, sweep_periods
from strata.plans import fixtures as fx
from strata.plans.oracle_fixtures import AS_OF, with_ctes
from strata.plans.registry import register
from strata.sources.tables import Tables

# Exclusion rule parameters used by the reading queries: code 'R' readings
# whose note mentions 'f' are dropped (and so are code 'R' readings with no
# note, by three-valued logic).
EXCLUDED_CODE = "R"
KEYWORDS = ("f",)
EXCLUSION_SQL = "coalesce(r.code <> 'R' OR NOT contains(lower(r.note), 'f'), FALSE)"
#: readings that the rule keeps
_KEPT_SQL = f"kept AS (SELECT * FROM reads r WHERE {EXCLUSION_SQL})"


def keep_reading(prefix: str = ""):
    return keep_unless_excluded(f"{prefix}code", f"{prefix}note", EXCLUDED_CODE, KEYWORDS)


def until():
    """The last day of a period; an open one lasts to the reference date."""
    return F.coalesce("end_date", F.lit(fx.AS_OF))


@register("q_interval_bucket", with_ctes(["reads", "intervals"], """
SELECT i.run, COUNT(*) AS n_customers,
       CAST(SUM(CAST(c.c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total_value
FROM customer c
LEFT JOIN (SELECT id, MAX(CAST(ts AS DATE)) AS last_read FROM reads GROUP BY id) l
       ON l.id = c.c_custkey
LEFT JOIN intervals i ON l.last_read BETWEEN i.min_date AND i.max_date
GROUP BY i.run"""))
def q_interval_bucket(spark, sf):
    """Customers bucketed by the run interval of their latest reading."""
    t = Tables(spark, sf)
    last = fx.reads(t).groupBy("id").agg(F.max(F.to_date("ts")).alias("last_read"))
    cust = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    b = bucket_by_interval(cust.join(last, "id", "left"), "last_read", fx.intervals(t), "run")
    return b.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total_value"))


@register("q_contiguous_intervals", with_ctes(["intervals"], "SELECT * FROM intervals"))
def q_contiguous_intervals(spark, sf):
    return fx.intervals(Tables(spark, sf))


@register("q_latest_per_key", """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice,
         ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn
  FROM orders) x WHERE rn = 1""")
def q_latest_per_key(spark, sf):
    o = Tables(spark, sf).orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return latest_per_key(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])


# Periods of open orders ('O') are treated as open-ended (no end yet).
@register("q_preferred_row", with_ctes(["periods"], """
SELECT id, top[4] AS pk, top[3] AS start_date, if(top[1], NULL, top[2]) AS end_date
FROM (SELECT id, max(row(still_open, if(still_open, DATE '9999-12-31', end_date), start_date, pk)) AS top
      FROM (SELECT *, status = 'O' OR end_date IS NULL AS still_open FROM periods) GROUP BY id)"""))
def q_preferred_row(spark, sf):
    p = fx.periods(Tables(spark, sf)).select(
        "id", "pk", "start_date",
        F.when(F.col("status") == "O", F.lit(None)).otherwise(F.col("end_date")).alias("end_date"))
    return preferred_row(p, ["id"], "start_date", "end_date", [F.col("pk").desc()])


# Earliest period per customer among those not in status 'P' (the
# "cancelled" flag of this fixture).
@register("q_earliest_active", with_ctes(["periods"], """
SELECT id, low[2] AS pk, low[1] AS start_date
FROM (SELECT id, min(row(start_date, pk)) FILTER (status != 'P') AS low FROM periods GROUP BY id) WHERE low IS NOT NULL"""))
def q_earliest_active(spark, sf):
    p = fx.periods(Tables(spark, sf)).filter(F.col("status") != "P").select("id", "pk", "start_date")
    return latest_per_key(p, ["id"], [F.col("start_date").asc(), F.col("pk").asc()])


@register("q_period_counts", with_ctes(["periods", "reads"], f"""
SELECT pk, id, start_date, end_date, read_count, read_count_all
FROM periods p, LATERAL (
  SELECT count(*) AS read_count, count(k.code || k.note) AS read_count_all
  FROM kept k WHERE k.id = p.id AND k.ts >= p.start_date AND k.ts <= if(p.end_date IS NULL, {AS_OF}, p.end_date))""", extra=[_KEPT_SQL]))
def q_period_counts(spark, sf):
    t = Tables(spark, sf)
    per = fx.periods(t).select("pk", "id", "start_date", "end_date")
    return facts_in_period(per, fx.reads(t), "pk", "id", F.col("start_date"), until(), "ts", {"n": "read_count", "n_whole": "read_count_all"},
                           whole=["code", "note"], event_filter=keep_reading())


@register("q_count_since_checkpoint", with_ctes(["periods", "reads", "checkpoints"], f"""
SELECT pk, id, start_date, end_date, cp_date,
       (SELECT count(*) FROM kept k WHERE k.id = p.id AND k.ts >= greatest(cp_date, start_date) AND k.ts <= if(end_date IS NULL, {AS_OF}, end_date)) AS read_count_since
FROM periods p LEFT JOIN checkpoints USING (id)""", extra=[_KEPT_SQL]))
def q_count_since_checkpoint(spark, sf):
    t = Tables(spark, sf)
    per = fx.periods(t).select("pk", "id", "start_date", "end_date")
    per = per.join(fx.checkpoints(t), "id", "left")
    return facts_in_period(per, fx.reads(t), "pk", "id", later_of("cp_date", "start_date"), until(), "ts", {"n": "read_count_since"}, event_filter=keep_reading())


@register("q_period_latest", with_ctes(["periods", "reads"], f"""
SELECT pk, last.ts, last.l_orderkey, last.l_linenumber, last.code, last.note
FROM (SELECT p.pk, arg_max(k, row(k.ts, k.l_orderkey, k.l_linenumber, k.code, coalesce(k.note, ''))) AS last
      FROM kept k JOIN periods p ON p.id = k.id AND p.start_date <= k.ts AND if(p.end_date IS NULL, {AS_OF}, p.end_date) >= k.ts GROUP BY p.pk)""", extra=[_KEPT_SQL]))
def q_period_latest(spark, sf):
    t = Tables(spark, sf)
    per = fx.periods(t).select("pk", "id", "start_date", "end_date")
    found = sweep_periods(per, fx.reads(t).filter(keep_reading()), "pk", "id", F.col("start_date"), until(), "ts", order=["l_orderkey", "l_linenumber", "code", "note"])
    return found.where("n > 0").select("pk", "latest.*")


@register("q_exclusion_rule", with_ctes(["reads"], f"""
SELECT code, note, COUNT(*) AS n_reads FROM reads r WHERE {EXCLUSION_SQL} GROUP BY code, note"""))
def q_exclusion_rule(spark, sf):
    r = fx.reads(Tables(spark, sf))
    return r.filter(keep_reading()).groupBy("code", "note").agg(F.count(F.lit(1)).alias("n_reads"))
