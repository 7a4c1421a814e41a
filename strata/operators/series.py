"""Reading series: recent-activity semi join, seasonal windows, unpivot."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recently_active(readings: DataFrame, id_col: str, ts: str, as_of: dt.date, days: int,
                    active_filter: Column | None = None) -> DataFrame:
    """Readings of ids with at least one (optionally filtered) reading in the
    ``days`` before ``as_of``: a left semi join with the recent ids, which are
    reduced to one row per id before the shuffle."""
    recent = readings.filter(F.col(ts) >= F.date_sub(F.lit(as_of), days))
    if active_filter is not None:
        recent = recent.filter(active_filter)
    recent = recent.select(F.col(id_col).alias("__rid")).distinct()
    return readings.join(recent, F.col(id_col) == F.col("__rid"), "left_semi")


def seasonal_window(readings: DataFrame, ts: str, as_of: dt.date, lookback_months: int = 12,
                    months: Sequence[int] = (1, 4, 7, 10), max_day: int = 7) -> DataFrame:
    """Readings in the last ``lookback_months`` that fall in the first
    ``max_day`` days of the given months."""
    c = F.col(ts)
    return readings.filter((c >= F.add_months(F.lit(as_of), -lookback_months))
                           & F.month(c).isin(*months) & (F.dayofmonth(c) <= max_day))


def seasonal_sample(readings: DataFrame, id_col: str, ts: str, as_of: dt.date,
                    recent_days: int = 7, active_filter: Column | None = None,
                    lookback_months: int = 12, months: Sequence[int] = (1, 4, 7, 10),
                    max_day: int = 7) -> DataFrame:
    """Seasonal sample of the readings of recently active ids."""
    active = recently_active(readings, id_col, ts, as_of, recent_days, active_filter)
    return seasonal_window(active, ts, as_of, lookback_months, months, max_day)


def unpivot_periods(df: DataFrame, ids: Sequence[str], period_cols: Sequence[str],
                    period: str = "period", value: str = "value",
                    value_type: str = "double") -> DataFrame:
    """Wide per-period columns to long rows (id..., period number 1..n, value).

    A generator (``inline`` of an array of structs): one pass, no shuffle, and
    the period number is the column's 1-based position, not its name.
    """
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias(period),
                              F.col(c).cast(value_type).alias(value))
                     for i, c in enumerate(period_cols, start=1)])
    return df.select(*ids, F.inline(rows))
