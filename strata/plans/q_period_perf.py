"""Queries: performance over all periods of the wide position table."""

from __future__ import annotations

from strata.operators.perf import (multi_run_performance, one_pass_performance,
                                   settlement_dates, settlement_day)
from strata.plans import fixtures as fx
from strata.plans.oracle_fixtures import with_ctes
from strata.plans.q_perf import R2_ERRORS, SD_EQUAL, SD_NEXT, THRESHOLDS, _in
from strata.plans.q_position import _POSITION_CTES, _POSITION_FIXTURES, classed_frame
from strata.plans.registry import register
from strata.sources.tables import Tables


def period_multi_run(t: Tables):
    settle = settlement_dates(fx.runs(t), fx.AS_OF, rule="equal")
    return multi_run_performance(classed_frame(t), "id", "segment", "volume", "run",
                                 "start_date", "end_date", THRESHOLDS, settle)


def _period_multi_run_ctes(source: str = "position_table", second: str = "segment", stage: str = "placed") -> list[str]:
    """Per id sums over its periods; a period outside both sides of a cut-off counts nowhere there."""
    order = [errs[-1] for _, errs in THRESHOLDS]
    sides, cols = [], []
    for k, (p, errs) in enumerate(THRESHOLDS, 1):
        day = f"(SELECT max(settlement_date) FROM settle WHERE settle_run = '{errs[-1]}')"
        sides.append(f"CASE WHEN level <= {k} THEN 'error' WHEN level > {k} AND {day} BETWEEN start_date AND coalesce(end_date, DATE '9999-12-31') "
                     f"THEN 'settled' END AS {p}_side")
        good, bad, either = (f"FILTER ({p}_side {x})" for x in ("= 'settled'", "= 'error'", "IS NOT NULL"))
        some = f"count(*) {either} > 0"
        for name, x in (("volume_settled", f"coalesce(sum(v) {good}, 0)"), ("count_settled", f"count(*) {good}"),
                        ("volume_error", f"coalesce(sum(v) {bad}, 0)"), ("count_error", f"count(*) {bad}"),
                        ("total_volume", f"sum(v) {either}"), ("total_count", f"count(*) {either}"),
                        ("performance", f"coalesce(coalesce(sum(v) {good}, 0) / nullif(sum(v) {either}, 0), 0)")):
            cols.append(f"if({some}, {x}, NULL) AS {p}_{name}")
    listed, placed = ",\n  ".join(cols), ",\n  ".join(sides)
    any_in = " OR ".join(f"{p}_side IS NOT NULL" for p, _ in THRESHOLDS)
    return [SD_EQUAL, f"""leveled AS (
  SELECT id, {second}, start_date, end_date, coalesce(volume, 0) AS v, list_position({order}, run) AS lv,
         CASE WHEN run IS NOT NULL THEN coalesce(lv, {len(order) + 1}) END AS level FROM {source}),
{stage} AS (
  SELECT *, {placed} FROM leveled),
multi_run AS (
  SELECT id, max({second}) AS {second},
  {listed}
  FROM {stage} WHERE {any_in} GROUP BY id)"""]


@register("q_period_multi_run", with_ctes(["runs", *_POSITION_FIXTURES], "SELECT * FROM multi_run",
                                          extra=_POSITION_CTES + _period_multi_run_ctes()))
def q_period_multi_run(spark, sf):
    """Per id, summed over all its valid periods: settled/error volume, count,
    totals and share for five nested run cut-offs."""
    return period_multi_run(Tables(spark, sf))


@register("q_period_group_performance", with_ctes(["runs", *_POSITION_FIXTURES], """
SELECT segment, class_code, good::DOUBLE AS r2_volume_settled, n_good AS r2_count_settled, bad::DOUBLE AS r2_volume_error,
       n_bad AS r2_count_error, (good + bad)::DOUBLE AS r2_total_volume, n_good + n_bad AS r2_total_count,
       CASE WHEN good + bad = 0 THEN 0 ELSE round(good::DOUBLE / (good + bad)::DOUBLE, 4) END AS r2_performance
FROM sums""", extra=[*_POSITION_CTES, SD_NEXT, f"""sided AS (
  SELECT *, CASE WHEN run IN {_in(R2_ERRORS)} THEN 'error'
                 WHEN (SELECT max(settlement_date) FROM settle WHERE settle_run = 'R2')
                      BETWEEN start_date AND coalesce(end_date, DATE '9999-12-31') AND run IS NOT NULL THEN 'settled' END AS side
  FROM position_table),
sums AS (
  SELECT coalesce(segment, 'unknown') AS segment, coalesce(class_code, 'unknown') AS class_code,
         coalesce(sum(volume::DECIMAL(38,2)) FILTER (side = 'settled'), 0) AS good, count(volume) FILTER (side = 'settled') AS n_good,
         coalesce(sum(volume::DECIMAL(38,2)) FILTER (side = 'error'), 0) AS bad, count(volume) FILTER (side = 'error') AS n_bad
  FROM sided WHERE side IS NOT NULL GROUP BY ALL)"""]))
def q_period_group_performance(spark, sf):
    """Per (segment, class), over all valid periods: R2 settled vs error volume/count and share."""
    t = Tables(spark, sf)
    day = settlement_day(settlement_dates(fx.runs(t), fx.AS_OF, rule="next"), "R2")
    return one_pass_performance(classed_frame(t), ["segment", "class_code"], "volume", "run", R2_ERRORS, day,
                                "start_date", "end_date", prefix="r2_")
