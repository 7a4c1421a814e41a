"""Column-level building blocks (all JVM-side ``pyspark.sql.functions``)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(rules: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Ordered decision cascade: the first rule whose condition is TRUE wins.

    A rule whose condition is NULL falls through to the next one (SQL CASE
    semantics); ``default`` applies when no rule is TRUE.
    """
    if not rules:
        return F.lit(default)
    expr = None
    for cond, value in rules:
        v = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    d = default if isinstance(default, Column) else F.lit(default)
    return expr.otherwise(d)


def concat_parts(cols: Iterable[str | Column], sep: str = ", ") -> Column:
    """Join text parts with ``sep``; blank or null parts are skipped."""
    parts = [F.nullif(F.trim(col(c)), F.lit("")) for c in cols]
    return F.trim(F.concat_ws(sep, *parts))


def keep_unless_excluded(code: str | Column, text: str | Column, excluded_code: str,
                         keywords: Sequence[str]) -> Column:
    """``NOT (code = excluded_code AND (lower(text) LIKE '%kw%' OR ...))``.

    Three-valued on purpose: a row with the excluded code and a NULL text gives
    NULL, so a filter or join condition drops it.
    """
    low = F.lower(col(text))
    any_kw = None
    for kw in keywords:
        term = low.contains(kw.lower())
        any_kw = term if any_kw is None else (any_kw | term)
    return ~((col(code) == F.lit(excluded_code)) & any_kw)


def seeded_order_key(seed: int | str, *keys: str | Column) -> Column:
    """Reproducible stand-in for ``ORDER BY RANDOM()``: md5 of seed and key.

    Independent of partition layout (unlike ``rand(seed)``), so reruns, retries
    and any engine computing md5 give the same order.
    """
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def safe_ratio(num: Column, den: Column, default: object = None) -> Column:
    """``num / NULLIF(den, 0)``, optionally coalesced to ``default``."""
    r = num / F.nullif(den, F.lit(0))
    return r if default is None else F.coalesce(r, F.lit(default))


def all_not_null(cols: Iterable[str | Column]) -> Column:
    expr = None
    for c in cols:
        term = col(c).isNotNull()
        expr = term if expr is None else (expr & term)
    return expr


def later_of(a: str | Column, b: str | Column) -> Column:
    """``CASE WHEN a IS NULL OR a < b THEN b ELSE a END`` (b wins ties and nulls)."""
    a, b = col(a), col(b)
    return F.when(a.isNull() | (a < b), b).otherwise(a)


def ntz(value) -> Column:
    """A ``timestamp_ntz`` literal (no session time zone involved), from a
    ``datetime``/``date`` or an ISO string."""
    return F.lit(str(value)).cast("timestamp_ntz")


def day_number(c: str | Column) -> Column:
    """Days since 1970-01-01 of a date or timestamp (its calendar day)."""
    return F.datediff(col(c).cast("date"), F.lit("1970-01-01").cast("date"))
