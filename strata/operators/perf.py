"""Settled-versus-error performance tables across run cut-offs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import safe_ratio


def settlement_dates(runs: DataFrame, as_of: dt.date, rule: str = "next", label: str = "run",
                     date: str = "date", run_date: str = "run_day") -> DataFrame:
    """(run, settlement_date): each run's latest settled day on the chosen run day.

    ``rule='next'``: the first run day on or after ``as_of + 1``;
    ``rule='equal'``: exactly ``as_of + 1`` (empty when that is not a run day).
    One row per run type.
    """
    target = F.date_add(F.lit(as_of), 1)
    if rule == "next":
        first = runs.filter(F.col(run_date) >= target).agg(F.min(run_date)).scalar()
        chosen = runs.filter(F.col(run_date) == first)
    elif rule == "equal":
        chosen = runs.filter(F.col(run_date) == target)
    else:
        raise ValueError(rule)
    return chosen.groupBy(label).agg(F.max(date).alias("settlement_date"))


def valid_on(start: str, end: str, day: Column) -> Column:
    return (F.col(start) <= day) & ((F.col(end) >= day) | F.col(end).isNull())


def settlement_day(settle: DataFrame, run: str) -> Column:
    """Scalar subquery: the settlement day of ``run`` (NULL if it has none)."""
    return settle.filter(F.col("run") == run).agg(F.max("settlement_date")).scalar()


def group_performance(df: DataFrame, keys: Sequence[str], measure: str, run: str,
                      error_runs: Sequence[str], settle_day: Column, start: str, end: str,
                      prefix: str = "", label: str = "unknown", exact_decimal: int = 2,
                      group_on: str = "raw") -> DataFrame:
    """Per group: volume and count settled vs in error, their totals and the
    settled share of volume.

    * error side: rows whose ``run`` is in ``error_runs``;
    * settled side: rows whose ``run`` is not in it and that are valid on
      ``settle_day`` (a scalar, e.g. :func:`settlement_day`; NULL empties the
      settled side). A NULL run is on neither side.
    * groups are formed on the raw keys and then labelled (NULL -> ``label``),
      so a NULL group and a literal ``label`` group stay apart; the two sides
      are matched on the labels (full outer join).
    * ``group_on='label'`` instead groups on the labels (NULL and a literal
      ``label`` merge into one group).
    * volumes are summed exactly as ``decimal(38, exact_decimal)`` and returned
      as double rounded to that scale; performance = settled / (settled +
      error) with 0 for a zero total, rounded to 4 places.
    """
    dec = f"decimal(38,{exact_decimal})"
    m = F.col(measure).cast(dec)
    in_err = F.col(run).isin(*error_runs)
    not_err = ~F.col(run).isin(*error_runs)

    def side(cond, vol, cnt):
        rows = df.filter(cond)
        if group_on == "label":
            rows = rows.select(*[F.coalesce(F.col(k), F.lit(label)).alias(k) for k in keys],
                               measure)
        agg = rows.groupBy(*keys).agg(F.sum(m).alias(vol), F.count(F.col(measure)).alias(cnt))
        return agg.select(*[F.coalesce(F.col(k), F.lit(label)).alias(k) for k in keys], vol, cnt)

    err = side(in_err, "__ve", "__ce")
    sett = side(not_err & valid_on(start, end, settle_day), "__vs", "__cs")
    cond = None
    for k in keys:
        term = err[k] == sett[k]
        cond = term if cond is None else cond & term
    j = sett.join(err, cond, "full_outer")
    vs = F.coalesce(F.col("__vs"), F.lit(0).cast(dec))
    ve = F.coalesce(F.col("__ve"), F.lit(0).cast(dec))
    cs = F.coalesce(F.col("__cs"), F.lit(0))
    ce = F.coalesce(F.col("__ce"), F.lit(0))
    perf = F.round(safe_ratio(vs.cast("double"), (vs + ve).cast("double"), 0.0), 4)
    return j.select(
        *[F.coalesce(sett[k], err[k]).alias(k) for k in keys],
        F.round(vs, exact_decimal).cast("double").alias(f"{prefix}volume_settled"),
        cs.cast("long").alias(f"{prefix}count_settled"),
        F.round(ve, exact_decimal).cast("double").alias(f"{prefix}volume_error"),
        ce.cast("long").alias(f"{prefix}count_error"),
        F.round(vs + ve, exact_decimal).cast("double").alias(f"{prefix}total_volume"),
        (ce + cs).cast("long").alias(f"{prefix}total_count"),
        perf.alias(f"{prefix}performance"))


def one_pass_performance(df: DataFrame, keys: Sequence[str], measure: str, run: str, error_runs: Sequence[str], settle_day: Column,
                         start: str, end: str, prefix: str = "", label: str = "unknown", exact_decimal: int = 2) -> DataFrame:
    """:func:`group_performance` from one scan and one exchange of the rows.

    Every row is on the error side, the settled side or neither; both sides of a
    raw group come from one conditional aggregate, combined in the map tasks.
    That a null key and a literal ``label`` are groups of their own whose sides
    are matched by label is settled on the result, which has one row per raw
    group: under one label at most two values per key (the null and the
    literal), so at most 2^k rows per side meet there.
    """
    dec = f"decimal(38,{exact_decimal})"
    in_error = F.coalesce(F.col(run).isin(*error_runs), F.lit(False))
    settled = F.coalesce(~F.col(run).isin(*error_runs) & valid_on(start, end, settle_day), F.lit(False))
    rows = df.select(*keys, F.col(measure).cast(dec).alias("__m"), in_error.alias("__e"), settled.alias("__s")).where("__e or __s")
    sides = []
    for side, flag in (("e", "__e"), ("s", "__s")):
        sides += [F.sum(F.when(F.col(flag), F.col("__m"))).alias(f"__v{side}"), F.count(F.when(F.col(flag), F.col("__m"))).alias(f"__c{side}"), F.max(flag).alias(f"__has{side}")]
    raw = rows.groupBy(*keys).agg(*sides)
    labels = [F.coalesce(F.col(k), F.lit(label)).alias(k) for k in keys]
    # collect_list leaves out the nulls of a side that a raw group does not have
    halves = [F.collect_list(F.when(F.col(f"__has{x}"), F.struct(F.col(f"__v{x}").alias("v"), F.col(f"__c{x}").alias("c")))).alias(f"__{x}") for x in ("s", "e")]
    met = raw.select(*labels, *[c for c in raw.columns if c not in keys]).groupBy(*keys).agg(*halves)
    met = met.select(*keys, F.explode_outer("__s").alias("__s"), "__e").select(*keys, "__s", F.explode_outer("__e").alias("__e"))
    zero = F.lit(0).cast(dec)
    vs, ve = (F.coalesce(F.col(f"__{x}.v"), zero) for x in ("s", "e"))
    cs, ce = (F.coalesce(F.col(f"__{x}.c"), F.lit(0)).cast("long") for x in ("s", "e"))
    perf = F.round(safe_ratio(vs.cast("double"), (vs + ve).cast("double"), 0.0), 4)
    values = {"volume_settled": F.round(vs, exact_decimal).cast("double"), "count_settled": cs, "volume_error": F.round(ve, exact_decimal).cast("double"),
              "count_error": ce, "total_volume": F.round(vs + ve, exact_decimal).cast("double"), "total_count": ce + cs, "performance": perf}
    return met.select(*keys, *[values[m].alias(f"{prefix}{m}") for m in METRICS])


METRICS = ("volume_settled", "count_settled", "volume_error", "count_error", "total_volume",
           "total_count", "performance")


def multi_run_performance(df: DataFrame, id_col: str, second_key: str, measure: str, run: str,
                          start: str, end: str, thresholds: Sequence[tuple[str, Sequence[str]]],
                          settle: DataFrame, null_safe: bool = True) -> DataFrame:
    """Wide performance per id for several nested cut-offs, in one aggregate.

    ``thresholds`` = [(prefix, error_runs), ...]; the settlement day of cut-off
    ``prefix`` is looked up in ``settle`` (run, settlement_date) under the run
    named by the last entry of its ``error_runs``. For each cut-off a row is in
    error (run in the set), settled (run not in the set and valid on that day)
    or neither. Per id the volumes and counts of either side are summed, so an
    id with an error period and a settled period is one row with both; with
    neither at a cut-off, its metrics there are NULL. Ids in neither set for
    every cut-off are dropped. Volumes are not rounded. The second key of an
    id is its largest.

    The equivalent SQL joins five per-cut-off tables back on (id, second key);
    here conditional sums are combined before one shuffle on the id, and the
    run days (one row per run type) enter as literals. ``null_safe=False`` reproduces the
    plain-equality join back: a NULL second key never matches, so such ids keep
    their keys but get NULL metrics everywhere.
    """
    # one row per run type, read once: as subqueries, the days would be planned anew in every expression that uses them
    days = {r["run"]: r["settlement_date"] for r in settle.groupBy("run").agg(F.max("settlement_date").alias("settlement_date")).collect()}
    volume = F.coalesce(F.col(measure), F.lit(0.0))
    sums, any_in = [], None
    for prefix, errs in thresholds:
        day = F.lit(days.get(errs[-1])).cast("date")
        err = F.coalesce(F.col(run).isin(*errs), F.lit(False))
        sett = F.coalesce(~F.col(run).isin(*errs) & valid_on(start, end, day), F.lit(False))
        member = err | sett
        counted = member if null_safe else member & F.col(second_key).isNotNull()
        for name, side in (("s", sett), ("e", err)):
            sums += [F.sum(F.when(counted, F.when(side, volume).otherwise(F.lit(0.0)))).alias(f"__{prefix}_v{name}"),
                     F.sum(F.when(counted, F.when(side, 1).otherwise(0))).cast("long").alias(f"__{prefix}_c{name}")]
        any_in = member if any_in is None else (any_in | member)
    by_id = df.filter(any_in).groupBy(id_col).agg(F.max(second_key).alias(second_key), *sums)
    cols = [F.col(id_col), F.col(second_key)]
    for prefix, _ in thresholds:
        vs, ve, cs, ce = (F.col(f"__{prefix}_{x}") for x in ("vs", "ve", "cs", "ce"))
        vals = {"volume_settled": vs, "count_settled": cs, "volume_error": ve, "count_error": ce,
                "total_volume": vs + ve, "total_count": ce + cs,
                "performance": F.when(cs.isNotNull(), safe_ratio(vs, vs + ve, 0.0))}
        cols += [vals[m].alias(f"{prefix}_{m}") for m in METRICS]
    return by_id.select(*cols)
