"""Event history stored once for many joins to validity periods.

The history is written bucketed by (key, time bin): the buckets are the
partitions a join on (key, bin) needs, so none of the joins that use it has to
shuffle or sort the events again. Only the periods, one row per bin they cover,
are exchanged. The first and last bin are taken down while the table is
written, and periods are clamped to them: one without an end costs no more rows
than the history has bins.

A (key, bin) with very many events (a measured count, not a guess) is split by
a hash of the event into slices of bounded size; a period that covers it meets
every slice.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strata.functions.columns import day_number
from strata.session import ensure_checkpoint_dir, materialize, note_table

#: at most so many (key, bin) cells can be hot, since each holds that share of all events
MAX_HOT_CELLS = 1 << 16
_CELL = ["__key", "__bin", "__slice"]


def describe_events(events: DataFrame, codes: DataFrame, code: str, lookup_code: str, description: str, flagged: Sequence[str],
                    flag: str = "audit_status", values: tuple[str, str] = ("Non-Auditable", "Auditable")) -> DataFrame:
    """Distinct events with the description of their code (an unknown code drops
    the event) and a flag that tells the ``flagged`` codes from the others.
    The code table is broadcast: a shuffle on the code would put all events
    into as many tasks as there are codes."""
    named = codes.select(F.col(lookup_code).alias("__code"), F.col(description).alias("description")).distinct()
    out = events.join(F.broadcast(named), events[code] == F.col("__code")).drop("__code")
    return out.withColumn(flag, F.when(F.col(code).isin(*flagged), values[0]).otherwise(values[1])).distinct()


class EventHistory:
    """Events in a table bucketed by (key, bin of the day, slice of a hot cell)."""

    def __init__(self, spark, name: str, columns: list[str], key: str, ts: str, bin_days: int, hot: DataFrame, span: tuple[int, int]):
        self.spark, self.name, self.columns = spark, name, columns
        self.key, self.ts, self.bin_days, self.hot, self.span = key, ts, bin_days, hot, span

    @classmethod
    def store(cls, events: DataFrame, key: str, ts: str, bin_days: int = 30, buckets: int | None = None, cell_rows: int = 1_000_000) -> EventHistory:
        """Write ``events`` (rows without key or time match no period and are left out).

        ``cell_rows``: events of a (key, bin) from which it is split. The table
        is an external one in the shared checkpoint folder.
        """
        spark = events.sparkSession
        columns = events.columns
        placed = (events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull())
                  .withColumn("__key", F.col(key)).withColumn("__bin", F.floor(day_number(ts) / bin_days)))
        seen = Observation(f"span_{uuid.uuid4().hex[:8]}")
        cells = placed.groupBy("__key", "__bin").agg(F.count(F.lit(1)).alias("n")).observe(
            seen, F.min("__bin").alias("first"), F.max("__bin").alias("last"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("cells"))
        cells = materialize(cells.where(F.col("n") > cell_rows))
        found = seen.get
        n = int(found["n"] or 0)
        limit = max(cell_rows, n // MAX_HOT_CELLS)
        hot = cells.where(F.col("n") > limit).select(F.col("__key").alias("__hkey"), F.col("__bin").alias("__hbin"), F.ceil(F.col("n") / limit).alias("__slices"))
        rows = placed.join(F.broadcast(hot), (F.col("__key") == F.col("__hkey")) & (F.col("__bin") == F.col("__hbin")), "left")
        rows = rows.withColumn("__slice", F.pmod(F.xxhash64(*columns), F.coalesce("__slices", F.lit(1))).cast("long")).drop("__hkey", "__hbin", "__slices")
        buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n // cell_rows, 100_000))
        name = f"history_{uuid.uuid4().hex}"
        path = note_table(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}")
        # dealt out as the buckets are, so that each bucket is one sorted file
        (rows.repartition(buckets, *_CELL).write.format("parquet").option("path", path)
         .bucketBy(buckets, *_CELL).sortBy(*_CELL, ts).saveAsTable(name))
        span = (int(found["first"]), int(found["last"])) if n else (1, 0)
        return cls(spark, name, columns, key, ts, bin_days, hot, span)

    def drop(self) -> None:
        """Forget the table (its files go with ``release_tables``)."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    @property
    def events(self) -> DataFrame:
        return self.spark.table(self.name)

    def pairs(self, periods: DataFrame, key: str, lo: Column, hi: Column, event_filter: Column | None = None) -> DataFrame:
        """Every (event, period) with equal keys and ``lo <= ts <= hi`` (dates, inclusive; midnight of ``hi`` is the last
        instant). ``periods`` shares no column name with the events; the period's key is dropped."""
        first, last = self.span
        ranges = periods.withColumns({"__pkey": F.col(key), "__lo": lo, "__hi": hi})
        a = F.greatest(F.floor(day_number("__lo") / self.bin_days), F.lit(first))
        b = F.least(F.floor(day_number("__hi") / self.bin_days), F.lit(last))
        covered = F.when((F.col("__lo") <= F.col("__hi")) & (a <= b), F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
        ranges = ranges.withColumn("__pbin", F.explode(covered)).drop(key)
        ranges = ranges.join(F.broadcast(self.hot), (F.col("__pkey") == F.col("__hkey")) & (F.col("__pbin") == F.col("__hbin")), "left")
        ranges = ranges.withColumn("__pslice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("__slices", F.lit(1)).cast("long") - 1)))
        events = self.events if event_filter is None else self.events.filter(event_filter)
        cond = ((F.col("__key") == F.col("__pkey")) & (F.col("__bin") == F.col("__pbin")) & (F.col("__slice") == F.col("__pslice"))
                & (F.col(self.ts) >= F.col("__lo")) & (F.col(self.ts) <= F.col("__hi")))
        own = {"__pkey", "__pbin", "__pslice", "__hkey", "__hbin", "__slices", *_CELL}
        # periods are exploded to bins, which the planner's size estimate does not see: no broadcast on that estimate
        return events.join(ranges.hint("shuffle_merge"), cond).drop(*own, "__lo", "__hi")

    def facts(self, periods: DataFrame, pk: str, key: str, start: str, end: str, as_of: dt.date, since: Column, order: Sequence[str],
              event_filter: Column | None = None) -> DataFrame:
        """``pk, events_since_start, events_since_checkpoint, latest`` of the periods that hold an event.

        ``since`` (an expression over ``periods``, on or after the start) bounds the
        second count from below; ``latest`` is a struct of the time and ``order``,
        greatest first. An open period ends on ``as_of``.
        """
        asked = periods.select(F.col(pk).alias("__pk"), F.col(key).alias("__id"), F.col(start).alias("__start"), F.col(end).alias("__end"), since.alias("__since"))
        found = self.pairs(asked, "__id", F.col("__start"), F.coalesce("__end", F.lit(as_of)), event_filter)
        fields = list(dict.fromkeys([self.ts, *order]))
        return found.groupBy(F.col("__pk").alias(pk)).agg(
            F.count(F.lit(1)).alias("events_since_start"), F.count(F.when(F.col(self.ts) >= F.col("__since"), 1)).alias("events_since_checkpoint"),
            F.max(F.struct(*fields)).alias("latest"))
