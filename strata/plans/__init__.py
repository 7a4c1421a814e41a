"""Registered queries (one per operator of the survey) and their oracles."""

from strata.plans import (q_alloc, q_analysis, q_full_groups, q_full_position, q_groups, q_intervals,  # noqa: F401
                          q_outputs, q_perf, q_period_perf, q_position, q_rows, q_series, q_text)
from strata.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
