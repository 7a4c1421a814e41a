"""Ordered operators that never put one whole group into one task.

Spark's window functions put every row of one ``PARTITION BY`` group into one
task, and an unpartitioned window puts the whole table into one task. Where the
groups are few and large (4 quality buckets, 9 bands, 5 teams) or absent
(``NTILE`` over a whole table), these helpers compute the same numbers in one
way at every size:

1. ``repartitionByRange`` on the full (total) order, group columns first. The
   number of ranges follows the estimated size of the input, so a range stays
   about as large at any scale; a hot group is cut into many ranges. Rows are
   sorted within a range and numbered with ``monotonically_increasing_id``
   (partition id in the high bits, position in the low bits).
2. This is written once to the checkpoint folder: range bounds come from a
   random sample and would move if they were recomputed.
3. One aggregate per (range, group) gives counts and sums; a window over these
   few rows gives what each group has in *its own* earlier ranges. Joined back
   on (range, group), it turns the position inside a range into the position in
   the group. Nothing is subtracted across groups, so a large value in one
   group cannot blur another.

Every order passed here must be total (end with a unique key); the callers
append one, so results never depend on partition layout.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.session import materialize

_LOCAL_BITS = 33
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1
#: stored bytes per task: some hundred thousand rows, which sort in a few hundred MB
RANGE_BYTES = 8 << 20
#: tables of up to so many such parts are left to the session's partitions
FEW_RANGES = 8
_BEFORE = (Window.unboundedPreceding, -1)


def _num_ranges(df: DataFrame, num_partitions: int | None) -> int:
    """At least the session's shuffle partitions; more when the tables read are large (their sizes, not join estimates)."""
    if num_partitions:
        return num_partitions
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, _stored_ranges(df))


def _stored_ranges(df: DataFrame) -> int:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return min(size // RANGE_BYTES, 100_000)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many tasks as its tables' size asks for, before a join or an
    aggregate on them: the session's number of partitions is fixed, and a task's rows would grow
    with the input. Small tables are left as they are. For keys of which none holds much of the table."""
    if _stored_ranges(df) <= FEW_RANGES:
        return df
    return df.repartition(_num_ranges(df, None), *keys)


def _ranged(df: DataFrame, order: Sequence[Column], num_partitions: int | None) -> DataFrame:
    """Range-partitioned, locally sorted, materialized copy with __pid/__loc."""
    ranged = (df.repartitionByRange(_num_ranges(df, num_partitions), *order)
              .sortWithinPartitions(*order)
              .withColumn("__mid", F.monotonically_increasing_id()))
    ranged = materialize(ranged)
    return (ranged
            .withColumn("__pid", F.shiftright(F.col("__mid"), _LOCAL_BITS))
            .withColumn("__loc", F.col("__mid").bitwiseAND(F.lit(_LOCAL_MASK)))
            .drop("__mid"))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                    how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating null = null; right's key copies are dropped."""
    if not keys:
        raise ValueError("no join keys")
    ren = {k: f"__rk_{i}" for i, k in enumerate(keys)}
    r = right.select(*[F.col(c).alias(ren.get(c, c)) for c in right.columns])
    cond = None
    for k in keys:
        term = left[k].eqNullSafe(r[ren[k]])
        cond = term if cond is None else cond & term
    return left.join(r, cond, how).drop(*ren.values())


def _group_first(group: Sequence[str]) -> list[Column]:
    return [F.col(g).asc_nulls_first() for g in group]


def _parts(ranged: DataFrame, group: Sequence[str], *aggs: Column) -> DataFrame:
    """One row per (range, group): rows of the group in its earlier ranges
    (``__earlier``), position of its first row here (``__first``), and ``aggs``."""
    parts = ranged.groupBy("__pid", *group).agg(F.count(F.lit(1)).alias("__cnt"), F.min("__loc").alias("__first"), *aggs)
    earlier = Window.partitionBy(*group).orderBy("__pid").rowsBetween(*_BEFORE)
    return parts.withColumn("__earlier", F.coalesce(F.sum("__cnt").over(earlier), F.lit(0)))


def with_global_index(df: DataFrame, order: Sequence[Column], out: str = "gidx",
                      total: str | None = None,
                      num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of the row in ``order`` (a total order).

    With ``total`` set, also add the table's row count under that name.
    """
    ranged = _ranged(df, order, num_partitions)
    parts = _parts(ranged, [])
    if total:
        parts = parts.withColumn(total, F.sum("__cnt").over(Window.partitionBy()))
    # one row per range: a bounded number, chosen above
    res = ranged.join(F.broadcast(parts.drop("__cnt", "__first")), "__pid")
    return res.withColumn(out, (F.col("__earlier") + F.col("__loc")).cast("long")).drop("__pid", "__loc", "__earlier")


def with_row_number(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                    out: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY group ORDER BY order)``, 1-based, long.

    ``order`` must make the order total within each group.
    """
    if not group:
        idx = with_global_index(df, order, "__gidx", num_partitions=num_partitions)
        return idx.withColumn(out, F.col("__gidx") + 1).drop("__gidx")
    ranged = _ranged(df, [*_group_first(group), *order], num_partitions)
    res = _null_safe_join(ranged, _parts(ranged, group), ["__pid", *group])
    return (res.withColumn(out, F.col("__earlier") + F.col("__loc") - F.col("__first") + 1)
            .drop("__pid", "__loc", "__cnt", "__first", "__earlier"))


def with_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column],
              rank_by: Sequence[str], tiebreak: Sequence[Column], out: str = "rank",
              num_partitions: int | None = None) -> DataFrame:
    """``RANK() OVER (PARTITION BY group ORDER BY order)`` with gaps, long.

    ``order`` sorts on the columns ``rank_by`` (rows equal on them tie);
    ``tiebreak`` only makes the index total and does not affect the rank. The
    start of a tie is found per range and carried over by a minimum over the
    ranges of the tie, so rows join on (range, group, tie) and a tie that holds
    most of a group stays spread over its ranges.
    """
    ranged = _ranged(df, [*_group_first(group), *order, *tiebreak], num_partitions)
    keys = [*group, *rank_by]
    ties = ranged.groupBy("__pid", *keys).agg(F.min("__loc").alias("__tie"))
    ties = _null_safe_join(ties, _parts(ranged, group), ["__pid", *group])
    start = F.col("__earlier") + F.col("__tie") - F.col("__first") + 1
    ties = ties.select("__pid", *keys, F.min(start).over(Window.partitionBy(*keys)).cast("long").alias(out))
    return _null_safe_join(ranged, ties, ["__pid", *keys]).drop("__pid", "__loc")


def with_ntile(df: DataFrame, order: Sequence[Column], k: int, out: str = "ntile",
               num_partitions: int | None = None) -> DataFrame:
    """``NTILE(k) OVER (ORDER BY order)`` over the whole table, long.

    From position i of n rows: q, r = n div k, n mod k; the first r tiles get
    q+1 rows, so tile = i div (q+1) + 1 while i < r(q+1), else
    r + (i - r(q+1)) div q + 1.
    """
    idx = with_global_index(df, order, "__gidx", total="__n", num_partitions=num_partitions)
    i, n = F.col("__gidx"), F.col("__n")
    q = F.floor(n / k).cast("long")
    r = n - q * k
    big = r * (q + 1)
    tile = (F.when(i < big, F.floor(i / (q + 1)) + 1)
            .otherwise(r + F.floor((i - big) / F.nullif(q, F.lit(0))) + 1))
    return idx.withColumn(out, tile.cast("long")).drop("__gidx", "__n")


def with_running_sum(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                     measure: str, out: str, num_partitions: int | None = None) -> DataFrame:
    """``SUM(measure) OVER (PARTITION BY group ORDER BY order ROWS UNBOUNDED
    PRECEDING)`` with a total order; also adds ``<out>_rn`` (row number in group).

    Sum of the group's earlier ranges plus the prefix inside the range (a
    window over one range of one group). NULL measures are skipped as in SQL,
    and the type is that of ``SUM(measure)``.
    """
    ranged = _ranged(df, [*_group_first(group), *order], num_partitions)
    kind = ranged.agg(F.sum(measure)).schema[0].dataType
    inside = Window.partitionBy("__pid", *group).orderBy("__loc").rowsBetween(Window.unboundedPreceding, 0)
    parts = _parts(ranged, group, F.sum(measure).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__pid").rowsBetween(*_BEFORE)
    parts = parts.withColumn("__before", F.sum("__sum").over(earlier).cast(kind)).drop("__sum", "__cnt")
    res = _null_safe_join(ranged.withColumn("__own", F.sum(measure).over(inside)), parts, ["__pid", *group])
    both = (F.col("__before") + F.col("__own")).cast(kind)
    return (res.withColumn(out, F.coalesce(both, "__own", "__before"))
            .withColumn(f"{out}_rn", F.col("__earlier") + F.col("__loc") - F.col("__first") + 1)
            .drop("__pid", "__loc", "__own", "__before", "__first", "__earlier"))


def scan_ranges(df: DataFrame, order: Sequence[Column], step: Callable, schema: str, num_partitions: int | None = None) -> DataFrame:
    """Deal ``df`` out by ranges of ``order``, sort each range, and run ``step`` once over it; stored.

    ``step(part, batches) -> batches`` gets the number of its range and the
    range's rows in order, as Arrow batches, and may keep what it likes between
    them, so long as that is bounded. One exchange, no group in one task. What
    a row needs from beyond its range is for ``step`` to give out as boundary
    rows, of which there is a bounded number per range. The result is written
    once: range bounds come from a random sample and would move if recomputed.
    """
    def run(batches):
        from pyspark import TaskContext
        yield from step(TaskContext.get().partitionId(), batches)

    ranged = df.repartitionByRange(_num_ranges(df, num_partitions), *order).sortWithinPartitions(*order)
    return materialize(ranged.mapInArrow(run, schema))


def _ddl(schema: T.StructType, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), *more])


def with_next_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                       cols: Sequence[str], prefix: str = "next_",
                       num_partitions: int | None = None) -> DataFrame:
    """``LEAD(c) OVER (PARTITION BY group ORDER BY order)`` for each c in cols.

    Rows are dealt out by ranges of (group, order) and each range is passed
    over once: a row's successor is the next row of the range, if its group is
    the same. The last row of a range takes the first row of the next range
    that has any, from a table of one row per range. One exchange, and no group
    in one task, however large it is.
    """
    def step(part, batches):
        held = None  # the row whose successor is not known yet
        first = True
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if not rows.num_rows:
                continue
            rows = rows if held is None else pa.concat_tables([held, rows])
            yield from _with_next(rows.slice(0, rows.num_rows - 1), rows.slice(1), group, cols, prefix, part, first, False).to_batches()
            first = first and rows.num_rows == 1
            held = rows.slice(rows.num_rows - 1)
        if held is not None:
            yield from _with_next(held, held.slice(0, 0), group, cols, prefix, part, first, True).to_batches()

    leads = [f"`{prefix}{c}` {df.schema[c].dataType.simpleString()}" for c in cols]
    rows = scan_ranges(df, [*_group_first(group), *order], step, _ddl(df.schema, *leads, "__part int", "__first boolean", "__last boolean"), num_partitions)
    heads = rows.where("__first").select("__part", *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], *[F.col(c).alias(f"__c{i}") for i, c in enumerate(cols)])
    # one row per range: a bounded number
    heads = heads.withColumn("__after", F.lag("__part").over(Window.orderBy("__part"))).drop("__part")
    cond = F.col("__last") & (F.col("__part") == F.col("__after"))
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = rows.join(F.broadcast(heads), cond, "left")
    out = out.withColumns({f"{prefix}{c}": F.when(F.col("__last"), F.col(f"__c{i}")).otherwise(F.col(f"{prefix}{c}")) for i, c in enumerate(cols)})
    return out.select(*df.columns, *[f"{prefix}{c}" for c in cols])


def _with_next(rows: pa.Table, after: pa.Table, group: Sequence[str], cols: Sequence[str], prefix: str, part: int, first: bool, last: bool) -> pa.Table:
    """``rows`` with the values of the rows one place later, null where the group changes or none follows."""
    n = rows.num_rows
    same = np.ones(n, bool) if after.num_rows else np.zeros(n, bool)
    if after.num_rows:
        for g in group:
            same &= _same(rows.column(g), after.column(g))
    place = pa.array(np.arange(n), mask=~same)
    for c in cols:
        rows = rows.append_column(f"{prefix}{c}", after.column(c).take(place))
    head = np.zeros(n, bool)
    head[:1] = first
    return (rows.append_column("__part", pa.array(np.full(n, part, np.int32))).append_column("__first", pa.array(head))
            .append_column("__last", pa.array(np.full(n, last))))


def _same(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """Row by row whether the values are equal, null like null."""
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False).astype(bool)
