"""Validity periods, interval buckets and event-in-period joins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import all_not_null, day_number, later_of

FLOOR_DATE = dt.date(1900, 1, 1)
#: ways in which every (key, bin) of an interval join is split
DEFAULT_SALT = 4


def contiguous_intervals(runs: DataFrame, as_of: dt.date, label: str = "run",
                         date: str = "date", run_date: str = "run_day",
                         floor_date: dt.date = FLOOR_DATE) -> DataFrame:
    """One interval per label: ``[previous label's max + 1 day, own max]``.

    Only rows whose run date is on or before ``as_of + 1`` count. The label with
    the smallest maximum starts at ``floor_date``; two labels with the same
    maximum give the later one (by label) an empty interval. Also returns
    ``run_date`` = latest run date - 1.

    The window runs over one row per label (a closed set of run types), so the
    single partition it needs is tiny; the scan and aggregate are distributed.
    """
    agg = (runs.filter(F.col(run_date) <= F.date_add(F.lit(as_of), 1))
           .groupBy(label)
           .agg(F.max(date).alias("max_date"),
                F.date_sub(F.max(run_date), 1).alias("run_date")))
    w = Window.orderBy("max_date", label)
    lower = F.coalesce(F.date_add(F.lag("max_date").over(w), 1), F.lit(floor_date))
    return agg.select(label, lower.alias("min_date"), "max_date", "run_date")


def interval_join(points: DataFrame, ranges: DataFrame, key: str | None, ts: str,
                  lo: str, hi: str, bin_days: int = 30, range_key: str | None = None,
                  whole_end_day: bool = False, salt: int = DEFAULT_SALT, how: str = "inner", clamp: bool = True) -> DataFrame:
    """Join: ``points.key = ranges.key AND points.ts BETWEEN lo AND hi``.

    ``lo``/``hi`` are dates (inclusive; a timestamp after midnight on ``hi`` is
    outside, as with SQL BETWEEN). Instead of pairing every point with every
    range of the same key and filtering, both sides get a time bin of
    ``bin_days`` days: a point gets the bin of its day, a range one row per bin
    it covers. The equi join on (key, bin, salt) then compares a point only with
    the ranges overlapping its bin. Each (point, range) pair meets in exactly
    one bin, the point's own, so no pair is produced twice.

    Bins of a range are clamped to the days that occur among the points (one
    aggregate over the time column), so an open range that ends in the year
    9999 has no more rows than the data has months. ``clamp=False`` saves that
    aggregate where ranges are few.

    (key, bin) is split ``salt`` ways: a point gets a hash of its columns mod
    ``salt``, a range row is repeated for every salt value. A key whose points
    crowd into one bin spreads over ``salt`` tasks in any session; adaptive
    execution can split further.

    ``key=None`` joins on time alone. ``how="left"`` keeps points without a
    range. ``whole_end_day=True`` counts every timestamp on the ``hi`` day
    (compares with the start of the next day) instead of SQL BETWEEN's midnight
    cut. ``ranges`` must not carry a column named like a ``points`` column
    except the key; the range key is dropped from the output.
    """
    p = (points.withColumn("__bin", F.floor(day_number(ts) / bin_days))
         .withColumn("__salt", F.pmod(F.xxhash64(*points.columns), F.lit(salt))))
    r = ranges if key is None else ranges.withColumnRenamed(range_key or key, "__rkey")
    lo_bin, hi_bin = (F.floor(day_number(c) / bin_days) for c in (lo, hi))
    if clamp:
        first = points.agg(F.coalesce(F.floor(day_number(F.min(ts)) / bin_days), F.lit(1))).scalar()
        last = points.agg(F.coalesce(F.floor(day_number(F.max(ts)) / bin_days), F.lit(0))).scalar()
        r = r.withColumns({"__from": first, "__to": last})
        lo_bin, hi_bin = F.greatest(lo_bin, F.col("__from")), F.least(hi_bin, F.col("__to"))
    bins = F.when((F.col(lo) <= F.col(hi)) & (lo_bin <= hi_bin), F.sequence(lo_bin, hi_bin)).otherwise(
        F.array().cast("array<bigint>"))
    r = (r.withColumn("__rbin", F.explode(bins)).drop("__from", "__to")
         .withColumn("__rsalt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long")))))
    upper = (p[ts] < F.date_add(r[hi], 1)) if whole_end_day else (p[ts] <= r[hi])
    cond = (p["__bin"] == r["__rbin"]) & (p["__salt"] == r["__rsalt"]) & (p[ts] >= r[lo]) & upper
    if key is not None:
        cond = (p[key] == r["__rkey"]) & cond
    return p.join(r, cond, how).drop("__bin", "__rbin", "__rkey", "__salt", "__rsalt")


def bucket_by_interval(df: DataFrame, date: str, intervals: DataFrame, label: str = "run",
                       lo: str = "min_date", hi: str = "max_date", out: str | None = None,
                       bin_days: int = 30, salt: int = DEFAULT_SALT) -> DataFrame:
    """Label each row with the interval containing ``date`` (NULL if none).

    One binned equi-join whatever the number of intervals (a small table: an
    interval has a row per bin, 100,000 up to the year 9999); the planner
    broadcasts the bins when it measures them small. Overlapping intervals
    repeat the row, as a range join does.
    """
    out = out or label
    small = intervals.select(F.col(label).alias("__lab"), F.col(lo).alias("__lo"),
                             F.col(hi).alias("__hi"))
    res = interval_join(df, small, None, date, "__lo", "__hi", bin_days=bin_days, salt=salt, how="left", clamp=False)
    return res.drop("__lo", "__hi").withColumnRenamed("__lab", out)


def _period_bounds(periods: DataFrame, start: str, end: str, as_of: dt.date) -> DataFrame:
    return periods.withColumn("__hi", F.coalesce(F.col(end), F.lit(as_of)))


def count_events_in_period(periods: DataFrame, events: DataFrame, pk: str, key: str,
                           start: str, end: str, ts: str, as_of: dt.date,
                           event_filter: Column | None = None,
                           all_columns: Sequence[str] | None = None,
                           out: str = "event_count", out_all: str | None = None,
                           lower: Column | None = None, bin_days: int = 30,
                           whole_end_day: bool = False, salt: int = DEFAULT_SALT) -> DataFrame:
    """Per period: events of the same key with ``lower <= ts <= coalesce(end, as_of)``.

    Zero-preserving: every period is returned, with 0 when nothing matched.
    ``lower`` defaults to the period start. ``event_filter`` is applied to the
    events first (like a condition on the event side inside a LEFT JOIN's ON).
    ``out`` counts matched events (``COUNT(event.key)``); with ``out_all`` set,
    also counts matched events whose ``all_columns`` are all non-null
    (``COUNT(event.*)`` semantics).

    Plan: inner binned join, partial aggregate per period, then one left join
    of the periods to per-period counts (unique key on the right, so the big
    side of the join never fans out and AQE may split it freely).
    """
    ev = events if event_filter is None else events.filter(event_filter)
    ev_cols = [key, ts, *(c for c in (all_columns or []) if c not in (key, ts))]
    ev = ev.select(*ev_cols).withColumnRenamed(key, "__ekey")
    lo = lower if lower is not None else F.col(start)
    rng = (_period_bounds(periods, start, end, as_of)
           .select(F.col(pk).alias("__pk"), F.col(key).alias("__pkey"),
                   lo.alias("__lo"), "__hi"))
    pairs = interval_join(ev, rng, "__ekey", ts, "__lo", "__hi", bin_days, range_key="__pkey",
                          whole_end_day=whole_end_day, salt=salt)
    aggs = [F.count(F.col("__ekey")).alias(out)]
    if out_all:
        aggs.append(F.count(F.when(all_not_null(["__ekey", ts, *(all_columns or [])]), 1))
                    .alias(out_all))
    counts = pairs.groupBy("__pk").agg(*aggs)
    res = periods.join(counts.withColumnRenamed("__pk", pk), pk, "left")
    res = res.withColumn(out, F.coalesce(F.col(out), F.lit(0)).cast("long"))
    if out_all:
        res = res.withColumn(out_all, F.coalesce(F.col(out_all), F.lit(0)).cast("long"))
    return res


def count_since_checkpoint(periods: DataFrame, checkpoints: DataFrame, events: DataFrame,
                           pk: str, key: str, start: str, end: str, ts: str, cp: str,
                           as_of: dt.date, event_filter: Column | None = None,
                           out: str = "count_since_checkpoint",
                           bin_days: int = 30, salt: int = DEFAULT_SALT) -> DataFrame:
    """Like :func:`count_events_in_period` but counting from the later of the
    key's checkpoint date and the period start (a NULL checkpoint means the
    start). Of several checkpoints of a key the latest counts."""
    p = periods.join(checkpoints.groupBy(key).agg(F.max(cp).alias(cp)), key, "left")
    return count_events_in_period(p, events, pk, key, start, end, ts, as_of, event_filter,
                                  out=out, lower=later_of(cp, start), bin_days=bin_days,
                                  salt=salt)


def latest_event_in_period(periods: DataFrame, events: DataFrame, pk: str, key: str,
                           start: str, end: str, ts: str, order: Sequence[str],
                           payload: Sequence[str], as_of: dt.date,
                           event_filter: Column | None = None, bin_days: int = 30,
                           salt: int = DEFAULT_SALT) -> DataFrame:
    """Per period with at least one event: the event with the greatest
    (ts, *order) inside the period, returning ``payload`` columns.

    Computed as ``max(struct(ts, *order, *payload))`` per period: an aggregate,
    so each map task pre-reduces a hot period to one row before the shuffle.
    Put every column that can differ between tied events into ``order`` or
    ``payload`` so ties cannot change the output.
    """
    ev = events if event_filter is None else events.filter(event_filter)
    fields = list(dict.fromkeys([ts, *order, *payload]))
    ev = ev.select(F.col(key).alias("__ekey"), *fields)
    rng = (_period_bounds(periods, start, end, as_of)
           .select(F.col(pk).alias("__pk"), F.col(key).alias("__pkey"),
                   F.col(start).alias("__lo"), "__hi"))
    pairs = interval_join(ev, rng, "__ekey", ts, "__lo", "__hi", bin_days, range_key="__pkey",
                          salt=salt)
    best = pairs.groupBy("__pk").agg(F.max(F.struct(*fields)).alias("__best"))
    return best.select(F.col("__pk").alias(pk), *[F.col(f"__best.{f}").alias(f) for f in fields])


def summarize_events_in_period(periods: DataFrame, events: DataFrame, pk: str, key: str,
                               start: str, end: str, ts: str, as_of: dt.date,
                               since: Column, order: Sequence[str],
                               event_filter: Column | None = None,
                               out_count: str = "count_since_start",
                               out_since: str = "count_since_checkpoint",
                               out_latest: str = "latest", bin_days: int = 30,
                               attach: bool = True, salt: int = DEFAULT_SALT) -> DataFrame:
    """One pass for three per-period facts over the same (event, period) pairs:

    * ``out_count``: events in ``[start, coalesce(end, as_of)]``;
    * ``out_since``: those of them on or after ``since`` (a later lower bound);
    * ``out_latest``: struct of the greatest (ts, *order) event.

    Equivalent to :func:`count_events_in_period`, :func:`count_since_checkpoint`
    and :func:`latest_event_in_period` run separately, for one binned join and
    one partial aggregate instead of three. Zero-preserving for the counts.
    With ``attach=False`` only periods with events are returned (pk + facts),
    for a caller that joins them to a wider period frame itself.
    """
    ev = events if event_filter is None else events.filter(event_filter)
    fields = list(dict.fromkeys([ts, *order]))
    ev = ev.select(F.col(key).alias("__ekey"), *fields)
    rng = (_period_bounds(periods, start, end, as_of)
           .select(F.col(pk).alias("__pk"), F.col(key).alias("__pkey"),
                   F.col(start).alias("__lo"), "__hi", since.alias("__since")))
    pairs = interval_join(ev, rng, "__ekey", ts, "__lo", "__hi", bin_days, range_key="__pkey",
                          salt=salt)
    agg = pairs.groupBy("__pk").agg(
        F.count(F.lit(1)).alias(out_count),
        F.count(F.when(F.col(ts) >= F.col("__since"), 1)).alias(out_since),
        F.max(F.struct(*fields)).alias(out_latest)).withColumnRenamed("__pk", pk)
    if not attach:
        return agg
    res = periods.join(agg, pk, "left")
    for c in (out_count, out_since):
        res = res.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return res
