"""Performance over all periods: an id with several periods is summed, none is dropped."""

from pyspark.sql import functions as F

from oracle_util import SF_SMALL, compare, duck
from strata.plans import ORACLE, QUERIES
from strata.plans.q_perf import R2_ERRORS
from strata.plans.q_position import position_frame
from strata.sources.tables import Tables


def test_all_periods_reach_the_performance_tables(spark):
    pos = position_frame(Tables(spark, SF_SMALL))
    want = pos.where(F.col("run").isin(*R2_ERRORS)).count()
    assert want > pos.select("id").distinct().count() // 2
    per_id = QUERIES["q_period_multi_run"](spark, SF_SMALL)
    assert per_id.agg(F.sum("r2_count_error")).first()[0] == want
    assert per_id.where("r2_total_count > 1").count() > 0 and per_id.count() == per_id.select("id").distinct().count()


def test_parity(spark):
    con = duck(SF_SMALL)
    for name in ("q_period_multi_run", "q_period_group_performance"):
        cols, rows, diff = compare(spark, con, QUERIES[name], ORACLE[name], SF_SMALL)
        assert cols and rows, (name, list(diff[0].elements())[:2], list(diff[1].elements())[:2])
