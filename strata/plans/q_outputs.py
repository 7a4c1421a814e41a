"""Queries whose result is a stored table: in an order that is kept, or created once and replaced when its input changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strata.operators.alloc import unassigned
from strata.plans import fixtures as fx
from strata.plans.oracle_fixtures import with_ctes
from strata.plans.q_alloc import _unassigned_sql
from strata.plans.q_full_groups import _DOMESTIC_SQL, full_multi_run
from strata.plans.q_full_position import BASE_FIXTURES
from strata.plans.registry import register
from strata.session import ensure_checkpoint_dir
from strata.sources.ranked import read_ranked, write_ranked
from strata.sources.tables import Tables
from strata.sources.versions import VersionedTable


@register("q_ranked_performance", with_ctes([*BASE_FIXTURES, "runs"], """
SELECT row_number() OVER (ORDER BY rf_volume_error DESC NULLS LAST, id) AS position, id, meter_type, rf_volume_error, rf_volume_settled, rf_performance
FROM multi_run""", extra=_DOMESTIC_SQL))
def q_ranked_performance(spark, sf):
    """The per-id performance table from the largest final-run error down; rows come in that order, which is stored with them."""
    rows = full_multi_run(Tables(spark, sf)).select("id", "meter_type", "rf_volume_error", "rf_volume_settled", "rf_performance")
    path = write_ranked(rows, [F.col("rf_volume_error").desc_nulls_last(), F.col("id").asc()])
    return read_ranked(spark, path).select("position", *rows.columns)


@register("q_unassigned_snapshot", with_ctes(["cases"], "SELECT * FROM items", extra=[_unassigned_sql("('LoneCase', 'ChildCase')")]))
def q_unassigned_snapshot(spark, sf):
    """The unassigned items as a table created once: a second call with the same input reads it, a changed input replaces it."""
    t = Tables(spark, sf)
    table = VersionedTable(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/unassigned-{uuid.uuid4().hex}")
    for _ in range(2):
        rows = table.create_once(lambda: unassigned(fx.cases(t), ["LoneCase", "ChildCase"]), inputs=[t.orders])
    return rows
