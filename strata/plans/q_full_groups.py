"""Queries: performance, calendar, members and groups over all periods of the complete
position table, from the base filters on (affecting, customer type, known not to export, open end)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import first_match
from strata.operators.groups import (assign_calendar, assign_groups, banded_deal, expand_members, performance_bucket,
                                     quota_sample, weighted_calendar)
from strata.operators.lookups import checked_lookup
from strata.operators.ordered import with_ntile
from strata.operators.perf import multi_run_performance, one_pass_performance, settlement_dates, settlement_day, valid_on
from strata.operators.rows import anti_join_null_safe, not_in
from strata.plans import fixtures as fx
from strata.plans.oracle_fixtures import with_ctes
from strata.plans.q_full_position import BASE_CTES, BASE_FIXTURES, full_base
from strata.plans.q_groups import (BUCKET_SQL, CAL_END, CAL_START, CAL_STEP, LARGE_SHARE, QUOTA_SQL, QUOTAS, R2_COLS, WEEK_WEIGHTS,
                                   _CALENDAR_SQL, _deal_sql)
from strata.plans.q_perf import R2_ERRORS, SD_EQUAL, SD_NEXT, THRESHOLDS, _in
from strata.plans.q_period_perf import _period_multi_run_ctes
from strata.plans.q_rows import DECISION_DAYS, DECISION_SQL
from strata.plans.registry import register
from strata.session import materialize
from strata.sources.tables import Tables

# Customer types of the domestic base.
DOMESTIC_TYPES = ("Unknown", "Domestic", "Micro Business")
_R2 = ", ".join(R2_COLS)


def commercial(t: Tables) -> DataFrame:
    """Open, affecting periods of commercial customers that are known not to export."""
    base = full_base(t).where(F.col("affecting") & (F.col("customer_type") == "Commercial") & ~F.col("export_indicator") & F.col("end_date").isNull())
    return base.withColumnRenamed("customer_name", "name")


def domestic(t: Tables) -> DataFrame:
    """Affecting periods of domestic customers that are known not to export, whether open or not."""
    return full_base(t).where(F.col("affecting") & F.col("customer_type").isin(*DOMESTIC_TYPES) & ~F.col("export_indicator"))


def r2_day(t: Tables):
    return settlement_day(settlement_dates(fx.runs(t), fx.AS_OF, rule="next"), "R2")


def full_group_performance(t: Tables) -> DataFrame:
    return one_pass_performance(commercial(t), ["name", "meter_type"], "volume", "run", R2_ERRORS, r2_day(t), "start_date", "end_date", prefix="r2_")


_COMMERCIAL_SQL = [*BASE_CTES, SD_NEXT, f"""sided AS (
  SELECT * EXCLUDE (customer_name), customer_name AS name,
         CASE WHEN run IN {_in(R2_ERRORS)} THEN 'error'
              WHEN (SELECT max(settlement_date) FROM settle WHERE settle_run = 'R2') >= start_date AND run IS NOT NULL THEN 'settled' END AS side
  FROM full_base WHERE affecting AND customer_type = 'Commercial' AND export_indicator IS FALSE AND end_date IS NULL),
halves AS (
  SELECT coalesce(name, 'unknown') AS name, coalesce(meter_type, 'unknown') AS meter_type, side, sum(volume::DECIMAL(38,2)) AS v, count(volume) AS n
  FROM sided WHERE side IS NOT NULL GROUP BY ALL),
sums AS (
  SELECT name, meter_type, coalesce(sum(v) FILTER (side = 'settled'), 0) AS good, coalesce(sum(n) FILTER (side = 'settled'), 0)::BIGINT AS n_good,
         coalesce(sum(v) FILTER (side = 'error'), 0) AS bad, coalesce(sum(n) FILTER (side = 'error'), 0)::BIGINT AS n_bad
  FROM halves GROUP BY ALL),
group_perf AS (
  SELECT name, meter_type, good::DOUBLE AS r2_volume_settled, n_good AS r2_count_settled, bad::DOUBLE AS r2_volume_error, n_bad AS r2_count_error,
         (good + bad)::DOUBLE AS r2_total_volume, n_good + n_bad AS r2_total_count,
         if(good + bad = 0, 0, round(good::DOUBLE / (good + bad)::DOUBLE, 4)) AS r2_performance
  FROM sums)"""]


def _commercial_sql(body: str, *more: str) -> str:
    return with_ctes([*BASE_FIXTURES, "runs", "contracts"], body, extra=[*_COMMERCIAL_SQL, *more])


@register("q_full_group_performance", _commercial_sql("SELECT * FROM group_perf"))
def q_full_group_performance(spark, sf):
    """Per (customer name, meter type) of the open commercial base: R2 settled vs error volume, count and share, in one pass."""
    return full_group_performance(Tables(spark, sf))


def full_calendar(t: Tables) -> DataFrame:
    calendar = weighted_calendar(t.spark, CAL_START, CAL_END, CAL_STEP, WEEK_WEIGHTS)
    groups = t.memo("full_group_performance", lambda: materialize(full_group_performance(t)))
    return assign_calendar(groups, calendar, "r2_total_count", "r2_performance", ["name", "meter_type"], LARGE_SHARE)


@register("q_full_calendar_assign", _commercial_sql("SELECT * FROM cal_assign", _CALENDAR_SQL))
def q_full_calendar_assign(spark, sf):
    """The groups of the open commercial base, dealt to weeks."""
    return full_calendar(Tables(spark, sf))


def full_members(t: Tables) -> DataFrame:
    base = t.memo("commercial", lambda: materialize(commercial(t)))
    in_error = F.col("run").isin(*R2_ERRORS)
    members = (base.withColumn("member_status", F.when(in_error, "error").when(~in_error & valid_on("start_date", "end_date", r2_day(t)), "settled"))
               .where("member_status is not null"))
    d = F.col("contract_end")
    lo, hi, lo2, hi2, safe = (F.to_date(F.lit(x)) for x in DECISION_DAYS)
    decision = first_match([(d.isNull(), "manual"), (d < lo, "exclude"), (d.between(lo, hi), "defer"), (d.between(lo2, hi2), "caution"), (d >= safe, "safe")], "unknown")
    rows = expand_members(members, full_calendar(t), ["name", "meter_type"], fx.contracts(t), "id", "contract_end", decision)
    rows = checked_lookup(rows, fx.details(t), [("pk", "pk")], {"distributor": "distributor"}, name="period details")
    return rows.select("pk", "id", "name", "meter_type", "member_status", "week_start", "contract_end", "decision", "distributor", F.col("volume").alias("annual_volume"))


@register("q_full_expand_members", _commercial_sql(f"""
SELECT m.pk, m.id, m.name, m.meter_type, side AS member_status,
       (SELECT min(week_start) FROM cal_assign g WHERE g.name = coalesce(m.name, 'unknown') AND g.meter_type = coalesce(m.meter_type, 'unknown')) AS week_start,
       contract_end, {DECISION_SQL} AS decision,
       'Brand#' || (m.pk % 25 + 1) AS distributor, volume AS annual_volume
FROM sided m LEFT JOIN contracts c ON c.id = m.id WHERE side IS NOT NULL""", _CALENDAR_SQL))
def q_full_expand_members(spark, sf):
    """Every period of the open commercial base with its side, its group's week, the contract's end and the decision."""
    return full_members(Tables(spark, sf))


def full_multi_run(t: Tables) -> DataFrame:
    settle = settlement_dates(fx.runs(t), fx.AS_OF, rule="equal")
    return multi_run_performance(domestic(t), "id", "meter_type", "volume", "run", "start_date", "end_date", THRESHOLDS, settle)


_DOMESTIC_SQL = [*BASE_CTES, f"domestic AS (SELECT * FROM full_base WHERE affecting AND customer_type IN {DOMESTIC_TYPES} AND NOT export_indicator)",
                 *_period_multi_run_ctes("domestic", "meter_type", "by_cutoff")]
assert SD_EQUAL in _DOMESTIC_SQL


@register("q_full_multi_run", with_ctes([*BASE_FIXTURES, "runs"], "SELECT * FROM multi_run", extra=_DOMESTIC_SQL))
def q_full_multi_run(spark, sf):
    """Per id of the domestic base, over all its periods: settled/error volume, count and share for five nested cut-offs."""
    return full_multi_run(Tables(spark, sf))


def full_r2_base(t: Tables) -> DataFrame:
    """Ids with R2 metrics that are not twice the user of an event (NOT IN), stored once for the steps below."""
    def build():
        rows = full_multi_run(t).where(F.col("r2_total_count").isNotNull()).select("id", "meter_type", *R2_COLS)
        return materialize(not_in(rows, "id", t.events.select((F.col("user_id") * 2).alias("key")), "key"))
    return t.memo("full_r2_base", build)


def full_sample(t: Tables) -> DataFrame:
    rows = full_r2_base(t).withColumn("quality", performance_bucket("r2_performance"))
    taken = quota_sample(rows, "quality", [F.col("id").desc()], "r2_total_count", QUOTAS).withColumn("grp", F.lit(1).cast("long"))
    return taken.withColumnsRenamed({"rn": "place", "cum_count": "running_count"})


def full_rest(t: Tables) -> DataFrame:
    return anti_join_null_safe(full_r2_base(t), full_sample(t), ["id", "meter_type"])


def full_groups(t: Tables) -> DataFrame:
    groups = assign_groups(full_r2_base(t), ["id", "meter_type"], performance_bucket("r2_performance"), [F.col("id").desc()], "r2_total_count", QUOTAS,
                           [F.col("r2_performance").desc_nulls_last()], [F.col("id").asc()], bands=9, groups=9, first_group=2, cols=["id", "meter_type", *R2_COLS])
    registered = fx.periods(t).select("pk", "id", "start_date").join(fx.details(t).select("pk", "distributor"), "pk")
    return checked_lookup(groups, registered, [("id", "id")], {"distributor": "distributor"}, rule="last", order=["start_date", "pk"], name="registrations")


_STEPS_SQL = ["""taken AS (SELECT list(DISTINCT user_id * 2) AS ids FROM events),
base AS (
  SELECT id, meter_type, %s FROM multi_run, taken WHERE r2_total_count > 0 AND NOT coalesce(list_contains(ids, id), FALSE))""" % _R2, f"""bucketed AS (
  SELECT *, {BUCKET_SQL} AS quality FROM base),
counted AS (
  SELECT *, (SELECT count(*) FROM bucketed y WHERE y.quality = x.quality AND y.id >= x.id) AS place,
         (SELECT sum(y.r2_total_count)::BIGINT FROM bucketed y WHERE y.quality = x.quality AND y.id >= x.id) AS running_count
  FROM bucketed x),
sampled AS (
  SELECT *, 1::BIGINT AS grp FROM counted WHERE running_count <= ({QUOTA_SQL})[quality] * (SELECT sum(r2_total_count) FROM base))""",
              "rest AS (SELECT * FROM base ANTI JOIN sampled USING (id))", _deal_sql("rest", "r2_performance DESC NULLS LAST", "r2_total_count", 9, 9, 2),
              f"""grouped AS (
  SELECT g.*, 'Brand#' || ((SELECT arg_max(p.pk, row(p.start_date, p.pk)) FROM periods p WHERE p.id = g.id) % 25 + 1) AS distributor
  FROM (SELECT id, meter_type, {_R2}, grp FROM dealt UNION ALL SELECT id, meter_type, {_R2}, grp FROM sampled) g)"""]


def _steps_sql(body: str, upto: int) -> str:
    return with_ctes([*BASE_FIXTURES, "runs"], body, extra=[*_DOMESTIC_SQL, *_STEPS_SQL[:upto]])


@register("q_full_quota_sample", _steps_sql(f"SELECT id, meter_type, {_R2}, quality, place, running_count, grp FROM sampled", 2))
def q_full_quota_sample(spark, sf):
    """First group of the domestic base: per quality bucket, ids from the largest down within the bucket's share of all counts."""
    return full_sample(Tables(spark, sf)).select("id", "meter_type", *R2_COLS, "quality", "place", "running_count", "grp")


@register("q_full_remainder", _steps_sql(f"SELECT id, meter_type, {_R2} FROM rest", 3))
def q_full_remainder(spark, sf):
    """The domestic base without the quota sample (null meter types match null)."""
    return full_rest(Tables(spark, sf))


@register("q_full_ntile_bands", _steps_sql("SELECT id, performance_band AS tile FROM tiled", 4))
def q_full_ntile_bands(spark, sf):
    """NTILE(9) of the remainder by performance, without one task that holds it."""
    order = [F.col("r2_performance").desc_nulls_last(), F.col("id").asc()]
    return with_ntile(full_rest(Tables(spark, sf)).select("id", "r2_performance"), order, 9, out="tile").select("id", "tile")


@register("q_full_banded_deal", _steps_sql("SELECT id, meter_type, performance_band AS tile, band_position AS turn, grp FROM dealt", 4))
def q_full_banded_deal(spark, sf):
    """The remainder dealt in turns, up and down the bands, into groups 2 to 10."""
    rest = full_rest(Tables(spark, sf)).select("id", "meter_type", "r2_performance", "r2_total_count")
    dealt = banded_deal(rest, "r2_performance", [F.col("r2_performance").desc_nulls_last()], "r2_total_count", [F.col("id").asc()], bands=9, groups=9, first_group=2)
    return dealt.select("id", "meter_type", F.col("performance_band").alias("tile"), F.col("band_position").alias("turn"), "grp")


@register("q_full_assign_groups", _steps_sql("SELECT * FROM grouped", 5))
def q_full_assign_groups(spark, sf):
    """Sample and dealt remainder of the domestic base, with the distributor of the id's latest registration."""
    return full_groups(Tables(spark, sf))


@register("q_full_group_summary", _steps_sql("""
SELECT grp, count(id) AS member_count, sum(r2_total_count)::BIGINT AS total_count, round(avg(r2_performance), 9) AS avg_performance FROM grouped GROUP BY grp""", 5))
def q_full_group_summary(spark, sf):
    """Members, counts and mean performance per group of the domestic base."""
    return full_groups(Tables(spark, sf)).groupBy("grp").agg(F.count("id").alias("member_count"), F.sum("r2_total_count").alias("total_count"),
                                                             F.round(F.avg("r2_performance"), 9).alias("avg_performance"))
