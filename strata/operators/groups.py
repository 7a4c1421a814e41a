"""Quota sampling, banded dealing into groups, calendars and assignment."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.functions.columns import first_match
from strata.operators.rows import anti_join_null_safe
from strata.operators.ordered import with_ntile, with_row_number, with_running_sum


# Quality buckets and the shares they begin at, and the bucket of all others.
BUCKET_EDGES = (("best", "==", 1), ("good", ">", 0.7), ("alright", ">", 0.3))
LOWEST_BUCKET = "poor"


def performance_bucket(perf: str, edges: Sequence[tuple[str, str, float]] = BUCKET_EDGES, default: str = LOWEST_BUCKET) -> Column:
    """Label a share by ordered edges; NULL falls to ``default``."""
    ops = {"==": lambda c, v: c == v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v}
    c = F.col(perf)
    return first_match([(ops[op](c, F.lit(Decimal(str(v)))), name) for name, op, v in edges],
                       default)


def quota_sample(df: DataFrame, bucket: str, order: Sequence[Column], measure: str,
                 quotas: dict[str, str | float]) -> DataFrame:
    """Per bucket, walk rows in ``order`` and keep those whose running total
    of ``measure`` stays within ``quota[bucket] x total`` (total over all rows).

    Once a row overshoots, it and every later row of its bucket are dropped
    (the running total never decreases for non-negative measures). Adds
    ``rn`` (position in bucket) and ``cum_count``. Quotas are exact decimals.
    Buckets are few and large, so the running totals come from the global
    index (no bucket is held by one task); the total is a scalar subquery.
    """
    total = df.agg(F.sum(measure)).scalar()
    run = with_running_sum(df, [bucket], order, measure, out="cum_count")
    run = run.withColumnRenamed("cum_count_rn", "rn")
    quota = first_match([(F.col(bucket) == b, F.lit(Decimal(str(q)))) for b, q in quotas.items()],
                        None)
    return run.filter(F.col("cum_count") <= quota * total)


def banded_deal(df: DataFrame, measure: str, perf_order: Sequence[Column], size: str,
                tiebreak: Sequence[Column], bands: int, groups: int, first_group: int) -> DataFrame:
    """Snake dealing: cut rows into ``bands`` equal tiles by ``perf_order``;
    inside odd tiles order by ``size`` descending, in even tiles ascending; the
    i-th row of a tile goes to group ``(i - 1) mod groups + first_group``.

    Adds ``performance_band``, ``order_key``, ``band_position`` and ``grp``.
    Both the tiling and the positions use the global index: no single task
    holds a whole tile.
    """
    banded = with_ntile(df, [*perf_order, *tiebreak], bands, out="performance_band")
    banded = banded.withColumn("order_key", F.when(F.col("performance_band") % 2 == 1,
                                                   -F.col(size)).otherwise(F.col(size)))
    pos = with_row_number(banded, ["performance_band"], [F.col("order_key").asc(), *tiebreak],
                          out="band_position")
    return pos.withColumn("grp", ((F.col("band_position") - 1) % groups + first_group).cast("long"))


def weighted_calendar(spark: SparkSession, start: dt.date, end: dt.date, step_days: int,
                      weights: Sequence[tuple[int, int]]) -> DataFrame:
    """Week starts from ``start`` to ``end`` every ``step_days`` numbered 1..n,
    joined to (week_number, week_weight); zero-weight weeks are dropped. Adds
    ``slot`` = dense 1-based number of the remaining weeks. Tiny by
    construction (one row per week), so its windows are single-partition."""
    wk = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end),
                                                    F.expr(f"INTERVAL {step_days} DAYS")))
                               .alias("week_start"))
    wk = wk.withColumn("week_number", F.row_number().over(Window.orderBy("week_start")).cast("long"))
    w = spark.createDataFrame([(int(a), int(b)) for a, b in weights], "week_number long, week_weight long")
    info = wk.join(w, "week_number").filter(F.col("week_weight") > 0)
    return info.withColumn("slot", F.row_number().over(Window.orderBy("week_start")).cast("long"))


def assign_calendar(groups: DataFrame, calendar: DataFrame, size: str, perf: str,
                    keys: Sequence[str], share: str | float, slot: str = "dense") -> DataFrame:
    """Large groups (``size`` > share x total) take the heaviest weeks by rank;
    the rest go round-robin over the weeks in order of ``perf`` descending.

    ``slot='dense'`` cycles over the remaining (non-zero) weeks; ``'raw'``
    matches the cycle position to the original week number, which skips
    zero-weight weeks and leaves trailing weeks unused (compat).
    Large groups number at most 1 / share, so their ranking window is small;
    with more large groups than weeks the ranks start over. A group of unknown
    size counts as small. The small groups are numbered with the global index.
    """
    total = groups.agg(F.sum(size)).scalar()
    is_large = F.coalesce(F.col(size) > F.lit(Decimal(str(share))) * total, F.lit(False))
    n_weeks = calendar.agg(F.count(F.lit(1))).scalar()
    tb = [F.col(k).asc() for k in keys]
    large = groups.filter(is_large).withColumn(
        "rn", F.row_number().over(Window.orderBy(F.col(size).desc(), *tb)).cast("long"))
    small = with_row_number(groups.filter(~is_large), [], [F.col(perf).desc(), *tb], out="rn")
    ranks = calendar.withColumn("rn_week", F.row_number().over(
        Window.orderBy(F.col("week_weight").desc(), F.col("week_number"))).cast("long"))
    large = large.withColumn("__turn", ((F.col("rn") - 1) % n_weeks) + 1)
    big = large.join(ranks.select("rn_week", "week_start", "week_number"),
                     F.col("__turn") == F.col("rn_week")).drop("rn_week", "__turn")
    cycle = ((F.col("rn") - 1) % n_weeks) + 1
    target = "slot" if slot == "dense" else "week_number"
    cal = calendar.select(F.col(target).alias("__slot"), "week_start", "week_number")
    # the cycle position is projected first: a scalar subquery inside a join
    # key is not reliably evaluated before the join's exchange
    small = small.withColumn("__cycle", cycle)
    rest = small.join(cal, F.col("__cycle") == F.col("__slot")).drop("__cycle", "__slot")
    return (big.withColumn("size_class", F.lit("large"))
            .unionByName(rest.withColumn("size_class", F.lit("small"))))


def assign_groups(base: DataFrame, keys: Sequence[str], bucket: Column, sample_order: Sequence[Column],
                  measure: str, quotas: dict[str, str | float], perf_order: Sequence[Column],
                  tiebreak: Sequence[Column], bands: int, groups: int, first_group: int,
                  cols: Sequence[str]) -> DataFrame:
    """Group 1 = quota sample per quality bucket; the remainder (NULL-safe
    anti join on ``keys``, so a sampled row is never dealt again) is snake
    dealt into ``groups`` groups from ``first_group``. Returns ``cols`` + grp."""
    b = base.withColumn("perf_bucket", bucket)
    g1 = quota_sample(b, "perf_bucket", sample_order, measure, quotas) \
        .withColumn("grp", F.lit(1).cast("long"))
    rest = anti_join_null_safe(base, g1, list(keys))
    dealt = banded_deal(rest, measure, perf_order, measure, tiebreak, bands, groups, first_group)
    return g1.select(*cols, "grp").unionByName(dealt.select(*cols, "grp"))


def expand_members(members: DataFrame, group_weeks: DataFrame, keys: Sequence[str],
                   contracts: DataFrame, id_col: str, end_col: str,
                   decision: Column, label: str = "unknown") -> DataFrame:
    """Member rows get their group's week (matched on the NULL-labelled group
    keys, so a member with a NULL key still finds its group; of several groups
    with one label the earliest week counts) and their latest contract end,
    then a decision computed by ``decision`` (an expression over ``end_col``).
    Member rows are never multiplied: both right sides are reduced to one row
    per key."""
    g = (group_weeks.groupBy(*[F.coalesce(F.col(k), F.lit(label)).alias(f"__g_{k}") for k in keys])
         .agg(F.min("week_start").alias("week_start")))
    contracts = contracts.groupBy(id_col).agg(F.max(end_col).alias(end_col))
    cond = None
    for k in keys:
        term = F.coalesce(members[k], F.lit(label)) == g[f"__g_{k}"]
        cond = term if cond is None else cond & term
    m = members.join(g, cond, "left").drop(*[f"__g_{k}" for k in keys])
    m = m.join(contracts.select(id_col, end_col), id_col, "left")
    return m.withColumn("decision", decision)
