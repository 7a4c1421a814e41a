"""Plan-level checks with ``explain``: the scale properties the README claims."""

import contextlib
import io

import pytest
from oracle_util import SF_SMALL
from pyspark.sql import functions as F

from strata.operators.lookups import LookupReport
from strata.operators.sweep import sweep_periods
from strata.plans import QUERIES
from strata.plans import fixtures as fx
from strata.plans.q_full_position import full_base
from strata.sources.tables import Tables


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_and_no_unbounded_nested_loop(spark, name):
    p = plan_of(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p, name


def test_top1_is_reduced_before_the_shuffle(spark):
    p = plan_of(QUERIES["q_latest_per_key"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_filters_and_columns_reach_the_scan(spark):
    p = plan_of(QUERIES["q_unpivot"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(l_shipdate" in p
    scan = [line for line in p.splitlines() if "ReadSchema: struct<l_orderkey" in line][0]
    assert "l_returnflag" not in scan and "l_linestatus" not in scan


def test_exclusion_rule_runs_on_the_lineitem_side_below_the_join(spark):
    # not a parquet-level filter (lower/contains/CASE), but a Filter on the
    # lineitem scan's own columns, before the join to orders
    p = plan_of(QUERIES["q_exclusion_rule"](spark, SF_SMALL))
    lines = p.splitlines()
    idx = [i for i, line in enumerate(lines) if line.startswith("Condition") and "l_returnflag" in line]
    assert idx
    inputs = lines[idx[0] - 1]
    assert inputs.startswith("Input") and "o_" not in inputs


@pytest.fixture
def unstored(monkeypatch):
    """Stored tables stay part of the plan, so that it can be seen as a whole."""
    from strata.operators import ordered
    monkeypatch.setattr(ordered, "materialize", lambda df: df)


def test_neighbour_rows_take_one_exchange(spark, unstored):
    p = fx.periods(Tables(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    rows, heads = p.split("BroadcastExchange")
    assert rows.count("Exchange") == 1 and "Exchange rangepartitioning(id" in rows
    assert "hashpartitioning" not in p and "SortMergeJoin" not in p


def test_events_meet_no_period_in_the_sweep(spark, unstored):
    per = spark.range(5).selectExpr("id AS pk", "id AS k", "DATE '2020-01-01' AS lo", "DATE '2120-01-01' AS hi")
    ev = spark.range(50).selectExpr("id % 5 AS k", "TIMESTAMP_NTZ '2020-01-02 00:00:00' AS ts")
    p = plan_of(sweep_periods(per, ev, "pk", "k", F.col("lo"), F.col("hi"), "ts"))
    assert "SortMergeJoin" not in p and "ShuffledHashJoin" not in p and "sequence(" not in p
    assert p.count("BroadcastHashJoin LeftOuter") >= 1  # one inherited row per range, nothing else is joined


def test_base_filters_reach_the_periods_below_the_lookups(spark):
    """Only what a filter needs is looked up before it: the lookups of a period run on the filtered periods."""
    t = Tables(spark, SF_SMALL)
    plan = full_base(t).where(F.col("end_date").isNull())._jdf.queryExecution().optimizedPlan().toString()
    first_join = plan.splitlines().index(next(line for line in plan.splitlines() if "Join LeftOuter" in line))
    assert not any("Filter isnull(end_date" in line for line in plan.splitlines()[:first_join])
    assert "isnull(end_date" in plan or "IsNull(end_date" in plan


def test_lookup_reports_of_the_position_table(spark):
    reports = {k: LookupReport(k) for k in ("details", "exports", "meters", "handlers", "customers")}
    full_base(Tables(spark, SF_SMALL), reports).write.format("noop").mode("overwrite").save()
    got = {k: r.counts for k, r in reports.items()}
    assert got["details"]["repeated_keys"] == got["handlers"]["repeated_keys"] == got["customers"]["repeated_keys"] == 0
    assert got["exports"]["extra_rows"] > 0 and got["meters"]["extra_rows"] > 0 and got["details"]["keys"] > 1000
