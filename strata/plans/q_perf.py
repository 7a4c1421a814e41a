"""Queries: settled-versus-error performance per group and per id."""

from __future__ import annotations

from strata.operators.perf import (multi_run_performance, one_pass_performance,
                                   settlement_dates, settlement_day)
from strata.plans import fixtures as fx
from strata.plans.oracle_fixtures import AS_OF, with_ctes
from strata.plans.registry import register
from strata.sources.tables import Tables

R2_ERRORS = ["RF", "R3", "R2"]
# Nested cut-offs: each one's error set adds the next more recent run.
THRESHOLDS = [("rf", ["RF"]), ("r3", ["RF", "R3"]), ("r2", ["RF", "R3", "R2"]),
              ("r1", ["RF", "R3", "R2", "R1"]), ("sf", ["RF", "R3", "R2", "R1", "SF"])]


def _in(xs):
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


# the days of one run day: the first from the cut-off on, or the cut-off itself
SD_NEXT = f"""settle AS (
  SELECT run AS settle_run, max(date) AS settlement_date FROM runs
  GROUP BY run, run_day HAVING run_day > {AS_OF}
  QUALIFY run_day = min(run_day) OVER ())"""
SD_EQUAL = f"""settle AS (
  SELECT run AS settle_run, max(date) FILTER (date_diff('day', {AS_OF}, run_day) = 1) AS settlement_date
  FROM runs GROUP BY run)"""


def group_performance_frame(t: Tables):
    return t.memo("group_performance", lambda: _group_performance(t))


def _group_performance(t: Tables):
    pos = fx.position(t)
    day = settlement_day(settlement_dates(fx.runs(t), fx.AS_OF, rule="next"), "R2")
    return one_pass_performance(pos, ["name", "meter_type"], "value", "run", R2_ERRORS, day,
                                "start_date", "end_date", prefix="r2_")


# one pass: every row is on the error side, the settled side or neither
GROUP_PERFORMANCE_CTES = [SD_NEXT, f"""sided AS (
  SELECT *, CASE WHEN run IN {_in(R2_ERRORS)} THEN 'error'
                 WHEN (SELECT max(settlement_date) FROM settle WHERE settle_run = 'R2')
                      BETWEEN start_date AND coalesce(end_date, DATE '9999-12-31') AND run IS NOT NULL THEN 'settled' END AS side
  FROM position),
sums AS (
  SELECT coalesce(name, 'unknown') AS name, coalesce(meter_type, 'unknown') AS meter_type,
         coalesce(sum(value::DECIMAL(38,2)) FILTER (side = 'settled'), 0) AS good, count(value) FILTER (side = 'settled') AS n_good,
         coalesce(sum(value::DECIMAL(38,2)) FILTER (side = 'error'), 0) AS bad, count(value) FILTER (side = 'error') AS n_bad
  FROM sided WHERE side IS NOT NULL GROUP BY ALL),
group_perf AS (
  SELECT name, meter_type, good::DOUBLE AS r2_volume_settled, n_good AS r2_count_settled, bad::DOUBLE AS r2_volume_error,
         n_bad AS r2_count_error, (good + bad)::DOUBLE AS r2_total_volume, n_good + n_bad AS r2_total_count,
         CASE WHEN good + bad = 0 THEN 0 ELSE round(good::DOUBLE / (good + bad)::DOUBLE, 4) END AS r2_performance
  FROM sums)"""]


@register("q_group_performance", with_ctes(["runs", "position"], "SELECT * FROM group_perf",
                                           extra=GROUP_PERFORMANCE_CTES))
def q_group_performance(spark, sf):
    """Per (name, meter type): R2 settled vs error volume/count and share."""
    return group_performance_frame(Tables(spark, sf))


def multi_run_frame(t: Tables):
    return t.memo("multi_run", lambda: _multi_run(t))


def _multi_run(t: Tables):
    settle = settlement_dates(fx.runs(t), fx.AS_OF, rule="equal")
    return multi_run_performance(fx.position(t), "id", "meter_type", "value", "run",
                                 "start_date", "end_date", THRESHOLDS, settle)


def multi_run_ctes() -> list[str]:
    """One scan: a row's run has a level; it is in error from the cut-off of that level on."""
    order = [errs[-1] for _, errs in THRESHOLDS]
    cols, seen = [], []
    for k, (p, errs) in enumerate(THRESHOLDS, 1):
        day = f"(SELECT max(settlement_date) FROM settle WHERE settle_run = '{errs[-1]}')"
        bad = f"coalesce(level <= {k}, FALSE)"
        good = f"(run IS NOT NULL AND NOT {bad} AND coalesce({day} BETWEEN start_date AND coalesce(end_date, DATE '9999-12-31'), FALSE))"
        v = "coalesce(value, 0)"
        seen.append(f"{bad} OR {good}")
        for name, x in (("volume_settled", f"if({good}, {v}, 0)"), ("count_settled", f"{good}::BIGINT"),
                        ("volume_error", f"if({bad}, {v}, 0)"), ("count_error", f"{bad}::BIGINT"),
                        ("total_volume", v), ("total_count", "1::BIGINT"),
                        ("performance", f"coalesce(if({good}, {v}, 0) / nullif({v}, 0), 0)")):
            cols.append(f"if({bad} OR {good}, {x}, NULL) AS {p}_{name}")
    listed = ",\n  ".join(cols)
    return [SD_EQUAL, f"""leveled AS (SELECT *, list_position({order}, run) AS level FROM position),
multi_run AS (
  SELECT id, meter_type,
  {listed}
  FROM leveled WHERE {" OR ".join(seen)})"""]


@register("q_multi_run_performance", with_ctes(["runs", "position"], "SELECT * FROM multi_run",
                                               extra=multi_run_ctes()))
def q_multi_run_performance(spark, sf):
    """Per id: settled/error volume, count, totals and share for five nested
    run cut-offs (run day rule 'equal'), NULL-safe on the second key."""
    return multi_run_frame(Tables(spark, sf))


@register("q_master_keys", with_ctes(["runs", "position"], "SELECT DISTINCT id, meter_type FROM multi_run",
                                     extra=multi_run_ctes()))
def q_master_keys(spark, sf):
    """Distinct (id, meter type) present at any cut-off (UNION of five sets)."""
    return multi_run_frame(Tables(spark, sf)).select("id", "meter_type").distinct()

