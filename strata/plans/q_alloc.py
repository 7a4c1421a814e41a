"""Queries: workload, unassigned lists, weights, apportionment, inheritance."""

from __future__ import annotations

from strata.operators.alloc import (agent_weights, apportion, inherit_from_child,
                                    owner_workload, unassigned)
from strata.plans import fixtures as fx
from strata.plans.oracle_fixtures import with_ctes
from strata.plans.registry import register
from strata.sources.tables import Tables

_ADJ = "CASE WHEN UPPER(subject) LIKE '%COMPLEX%' THEN 'Complex Cases' ELSE team END"
_WORKLOAD = f"""workload AS (
  SELECT cases.owner, {_ADJ} AS adjusted_team, count(*)::INTEGER AS open_count, coalesce(any_value(hours), 0)::DOUBLE AS hours
  FROM cases LEFT JOIN capacity ON capacity.owner = cases.owner
  WHERE status != 'Closed' AND kind != 'ParentCase' AND cases.owner IS NOT NULL GROUP BY ALL)"""
# whole units of 1e-9; an owner's cumulative units are those of the names up to it
_WEIGHTS = """shares AS (
  SELECT *, floor(hours / (open_count + 5) * 1000000000 + 0.5)::BIGINT AS units FROM workload WHERE hours > 0),
shared AS (
  SELECT a.*, (SELECT sum(units) FROM shares b WHERE b.adjusted_team = a.adjusted_team)::BIGINT AS team_units,
         (SELECT sum(units) FROM shares b WHERE b.adjusted_team = a.adjusted_team AND b.owner <= a.owner)::BIGINT AS upto
  FROM shares a)"""


def _unassigned_sql(kinds: str) -> str:
    return f"""items AS (
  SELECT 'No Agent Assigned' AS altered_agent, {_ADJ} AS adjusted_team, * FROM cases
  WHERE owner IS NULL AND status = 'Open' AND {_ADJ} NOT IN ('Complex Cases') AND kind IN {kinds})"""


def _workload(t):
    return owner_workload(fx.cases(t), fx.capacity(t.spark))


@register("q_workload", with_ctes(["cases", "capacity"], "SELECT * FROM workload",
                                  extra=[_WORKLOAD]))
def q_workload(spark, sf):
    """Open owned items per (owner, adjusted team) with the owner's hours."""
    return _workload(Tables(spark, sf))


@register("q_unassigned", with_ctes(["cases"], "SELECT * FROM items",
                                    extra=[_unassigned_sql("('LoneCase', 'ChildCase')")]))
def q_unassigned(spark, sf):
    return unassigned(fx.cases(Tables(spark, sf)), ["LoneCase", "ChildCase"])


@register("q_unassigned_parents", with_ctes(["cases"], "SELECT * FROM items",
                                            extra=[_unassigned_sql("('ParentCase')")]))
def q_unassigned_parents(spark, sf):
    return unassigned(fx.cases(Tables(spark, sf)), ["ParentCase"])


@register("q_weight_share", with_ctes(["cases", "capacity"], """
SELECT owner, adjusted_team, open_count, hours, units / 1000000000::DOUBLE AS weight,
       units / team_units::DOUBLE AS normalized_weight, upto / team_units::DOUBLE AS cum_weight
FROM shared""", extra=[_WORKLOAD, _WEIGHTS]))
def q_weight_share(spark, sf):
    """Owner weights hours / (open + 5), normalised per team, cumulative."""
    w = agent_weights(_workload(Tables(spark, sf)))
    return w.select("owner", "adjusted_team", "open_count", "hours", "weight", "normalized_weight", "cum_weight")


# the k-th of n items goes to the first owner whose cumulative share reaches k / n
_APPORTION_SQL = with_ctes(["cases", "capacity"], """
SELECT i.*, x.case_rn, s.owner AS assigned_agent, s.open_count, s.hours
FROM (SELECT n.*, (SELECT min(owner) FROM shared s WHERE s.adjusted_team = n.adjusted_team
                   AND s.upto::HUGEINT * n.of_team >= n.case_rn::HUGEINT * s.team_units) AS agent FROM numbered n) x
JOIN items i USING (id) LEFT JOIN shared s ON s.owner = x.agent AND s.adjusted_team = x.adjusted_team""", extra=[
        _WORKLOAD, _WEIGHTS, _unassigned_sql("('LoneCase', 'ChildCase')"),
        f"""numbered AS (
  SELECT id, adjusted_team, count(*) OVER (PARTITION BY adjusted_team) AS of_team,
         rank() OVER (PARTITION BY adjusted_team ORDER BY md5('{fx.SEED}|' || id), id) AS case_rn
  FROM items)"""])


def _apportion(spark, sf, mode):
    t = Tables(spark, sf)
    items = unassigned(fx.cases(t), ["LoneCase", "ChildCase"])
    return apportion(items, _workload(t), fx.SEED, mode=mode)


@register("q_apportion", _APPORTION_SQL)
def q_apportion(spark, sf):
    """Unassigned items dealt to owners by weight; every item exactly once."""
    return _apportion(spark, sf, "exact")


@register("q_apportion_floor", _APPORTION_SQL)
def q_apportion_floor(spark, sf):
    """Same with both band edges computed by floor; exact sums make them meet."""
    return _apportion(spark, sf, "floor")


@register("q_inherit_child", with_ctes(["cases"], f"""
SELECT p.*, pick AS assigned_agent
FROM (SELECT parent_id, team, arg_min(owner, row(md5('{fx.SEED}|' || id), id)) AS pick
      FROM cases WHERE owner IS NOT NULL AND kind = 'ChildCase' AND status = 'Open' GROUP BY ALL) k
JOIN cases p ON p.id = k.parent_id AND p.team = k.team
WHERE p.owner IS NULL AND p.kind = 'ParentCase' AND p.status = 'Open'"""))
def q_inherit_child(spark, sf):
    """Unassigned parents take the owner of one seeded-random assigned child."""
    return inherit_from_child(fx.cases(Tables(spark, sf)), fx.SEED)
