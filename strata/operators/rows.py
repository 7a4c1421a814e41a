"""Row selection, lookups and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import col


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   rn: str | None = None) -> DataFrame:
    """First row per key under ``order`` (``ROW_NUMBER() ... = 1``).

    ``order`` should end with a unique column so the pick is deterministic.
    Spark plans ``row_number() = 1`` with a partial WindowGroupLimit before
    the shuffle: every map task keeps one row per key, so a hot key is reduced
    map-side like an aggregate.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1)
    return out.withColumnRenamed("__rn", rn) if rn else out.drop("__rn")


def preferred_row(df: DataFrame, keys: Sequence[str], start: str, end: str,
                  tiebreak: Sequence[Column], open_end_sentinel: str = "9999-12-31",
                  missing_start_sentinel: str = "1900-01-01") -> DataFrame:
    """One row per key: open-ended rows first, then the latest end (NULL as
    ``open_end_sentinel``), then the latest start (NULL as
    ``missing_start_sentinel``), then ``tiebreak``."""
    active = F.when(F.col(end).isNull(), 1).otherwise(0)
    end_key = F.coalesce(F.col(end), F.to_date(F.lit(open_end_sentinel)))
    start_key = F.coalesce(F.col(start), F.to_date(F.lit(missing_start_sentinel)))
    return latest_per_key(df, keys, [active.desc(), end_key.desc(), start_key.desc(), *tiebreak])


def join_chain(base: DataFrame, steps: Sequence[tuple[DataFrame, Column | str | list]],
               how: str = "inner") -> DataFrame:
    """Successive joins ``base ⋈ s1 ⋈ s2 ...``; each step is (frame, condition)."""
    out = base
    for frame, cond in steps:
        out = out.join(frame, cond, how)
    return out


def flatten_hierarchy(base: DataFrame, steps: Sequence[tuple[DataFrame, Column]],
                      lookup: DataFrame, code: str, lookup_code: str,
                      flagged_codes: Sequence[str], flag_col: str, select: Sequence[Column | str],
                      flag_values: tuple[str, str] = ("Non-Auditable", "Auditable"),
                      flag_source: str | None = None) -> DataFrame:
    """Inner join chain down a message hierarchy, a code-description lookup
    (inner: unknown codes drop out; broadcast, as a shuffle on the code would put
    all rows into as many tasks as there are codes), an audit flag and DISTINCT.

    ``flag_source`` names the column tested against ``flagged_codes``
    (default: ``code``). ``select`` lists the output columns besides the flag.
    """
    flat = join_chain(base, steps)
    flat = flat.join(F.broadcast(lookup), flat[code] == lookup[lookup_code])
    src = F.col(flag_source or code)
    flag = F.when(src.isin(*flagged_codes), F.lit(flag_values[0])).otherwise(F.lit(flag_values[1]))
    return flat.select(*select, flag.alias(flag_col)).distinct()


def fallback_lookup(df: DataFrame, primary: DataFrame, primary_on: Sequence[str],
                    primary_value: str, secondary: DataFrame,
                    secondary_on: Sequence[tuple[Column, str]], secondary_value: str,
                    out: str, source: str | None = None) -> DataFrame:
    """Value from ``primary`` where the row has one, else from ``secondary``.

    The secondary join carries the term "primary missed" in its condition, so
    it is only consulted for rows without a primary match (and rows that have
    one are never fanned out by it). ``secondary_on`` pairs an expression on
    ``df`` (e.g. a ``try_cast``) with a ``secondary`` column.
    """
    p = primary.select(*[F.col(k).alias(f"__p_{k}") for k in primary_on],
                       F.col(primary_value).alias("__pval"), F.lit(True).alias("__phit"))
    cond = None
    for k in primary_on:
        term = df[k] == p[f"__p_{k}"]
        cond = term if cond is None else cond & term
    res = df.join(p, cond, "left")
    s_cols = [c for _, c in secondary_on]
    s = secondary.select(*[F.col(c).alias(f"__s_{c}") for c in s_cols],
                         F.col(secondary_value).alias("__sval"))
    cond = F.col("__phit").isNull()
    for expr, c in secondary_on:
        cond = cond & (expr == s[f"__s_{c}"])
    res = res.join(s, cond, "left")
    res = res.withColumn(out, F.when(F.col("__phit").isNull(), F.col("__sval"))
                         .otherwise(F.col("__pval")))
    if source:
        res = res.withColumn(source, F.when(F.col("__phit").isNotNull(), "primary")
                             .when(F.col("__sval").isNotNull(), "secondary"))
    drop = [f"__p_{k}" for k in primary_on] + [f"__s_{c}" for c in s_cols]
    return res.drop("__pval", "__phit", "__sval", *drop)


def not_in(df: DataFrame, key: str | Column, values: DataFrame, value_col: str) -> DataFrame:
    """Rows of ``df`` with ``key NOT IN (SELECT value_col FROM values)``.

    SQL's null-aware semantics, kept exactly: with an empty list every row
    passes; otherwise a NULL key never passes, and a NULL in the list makes
    every row fail. Built as a hash anti join plus one global
    (count, null count) row, instead of the null-aware broadcast nested-loop
    join Spark falls back to when the list is too large to broadcast. The two
    counts are one scalar subquery; the list is made distinct before it is
    shuffled to the join, and rows with a null key do not go through it.
    """
    k = col(key)
    vals = values.select(F.col(value_col).alias("__v"))
    seen = vals.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("__v").isNull(), 1)).alias("nulls"))).scalar()
    kept = df.filter(k.isNotNull()).join(vals.filter(F.col("__v").isNotNull()).distinct(), k == F.col("__v"), "left_anti")
    kept = kept.filter(seen["nulls"] == 0)
    return kept.unionByName(df.filter(k.isNull() & (seen["n"] == 0)))


def anti_join_null_safe(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` with no row in ``other`` equal on ``keys`` (NULL = NULL)."""
    o = other.select(*[F.col(k).alias(f"__o_{k}") for k in keys])
    cond = None
    for k in keys:
        term = df[k].eqNullSafe(o[f"__o_{k}"])
        cond = term if cond is None else cond & term
    return df.join(o, cond, "left_anti")
