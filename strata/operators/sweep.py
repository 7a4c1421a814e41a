"""Events in periods by one sorted sweep.

Events and the two ends of every period are one table, dealt out by ranges of
(key, time) and passed over once in order. At each end of a period the sweep
knows how many events of the key came before and which was the last; a period's
count is the difference of its two ends, its latest event the last one before
its end, if the count is not 0. A period costs two rows, whatever its length,
and meets no event: there is no join of events to periods, no copy of a period
per time bin, and a key that holds much of the table is just many ranges. What
a range inherits of its first key comes from one row per earlier range.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import all_not_null
from strata.operators.ordered import scan_ranges

_OPEN, _SINCE, _EVENT, _CLOSE, _HEAD, _TAIL = range(6)


def _step(part, batches):
    """Ends of periods with the events of their key so far; at the last, what the range's first and last key come to."""
    kept = None  # key, events, complete events and last event of the run that is open
    head = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, kind = batch.column("key"), batch.column("kind").to_numpy()
        place = np.arange(n)
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        goes_on = kept is not None and key[0].equals(kept[0])
        start = np.maximum.accumulate(np.where(new, place, 0))
        event = kind == _EVENT
        counts = []
        for hit, before in ((event, 1), (event & batch.column("whole").to_numpy(zero_copy_only=False), 2)):
            run = np.concatenate([[0], np.cumsum(hit)])
            own = run[1:] - run[start]
            counts.append(own + np.where(start == 0, kept[before], 0) if goes_on else own)
        # the last event of the key: in this batch, or the one kept (place 0 of the payload with it in front)
        last = np.maximum.accumulate(np.where(event, place, -1))
        here = last >= start
        carried = (start == 0) & goes_on
        payload = pa.concat_arrays([batch.column("payload").slice(0, 0) if kept is None else kept[3], batch.column("payload")])
        shift = len(payload) - n
        at = pa.array(np.where(here, last + shift, 0), mask=~(here | (carried & bool(shift))))
        if head is None:
            head = key[0]
            yield _rows(part, key[:1], [None], [_HEAD], [0], [0], batch.column("payload").slice(0, 1).take(pa.array([None], pa.int64())), [True])
        ends = np.flatnonzero(~event)
        first = pc.equal(key, head).to_numpy(zero_copy_only=False)
        yield _rows(part, key.take(pa.array(ends)), batch.column("pk").take(pa.array(ends)), kind[ends], counts[0][ends], counts[1][ends],
                    payload.take(at.take(pa.array(ends))), first[ends])
        final = payload.take(at.slice(n - 1))
        kept = (key[n - 1], int(counts[0][-1]), int(counts[1][-1]), final)
        tail = (key.slice(n - 1), final)
    if kept is not None:
        yield _rows(part, tail[0], [None], [_TAIL], [kept[1]], [kept[2]], tail[1], [False])


def _rows(part, key, pk, kind, n, n_whole, payload, first) -> pa.RecordBatch:
    size = len(key)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, part, np.int32)), key, pk if isinstance(pk, pa.Array) else pa.array(pk, pa.int64()), pa.array(np.asarray(kind, np.int32)),
         pa.array(np.asarray(n, np.int64)), pa.array(np.asarray(n_whole, np.int64)), payload, pa.array(np.asarray(first, bool))],
        ["part", "key", "pk", "kind", "n", "n_whole", "payload", "first"])


def sweep_periods(periods: DataFrame, events: DataFrame, pk: str, key: str, lower: Column, upper: Column, ts: str, order: Sequence[str] = (),
                  whole: Sequence[str] = (), since: Column | None = None, num_partitions: int | None = None) -> DataFrame:
    """``pk, n, n_whole, n_since, latest`` for every period with ``lower <= upper``, and no other row.

    Events have the period's ``key`` and ``lower <= ts <= upper`` (dates; the
    upper day ends at its first instant, as BETWEEN has it). ``n`` counts them,
    ``n_whole`` the ones whose ``whole`` columns are all known, ``n_since`` those
    on or after ``since`` (a day of the period's own, not before ``lower``; null or
    none: ``lower``), which costs a period a third row. ``latest`` is a struct of
    the greatest (``ts``, ``*order``), null where n is 0. ``pk`` is a
    unique whole number. Events without key or time and periods without key or
    bounds match nothing.
    """
    fields = list(dict.fromkeys([ts, *order]))
    kind = events.schema[ts].dataType
    ev = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("key"), F.col(ts).alias("t"), F.lit(_EVENT).alias("kind"), F.lit(None).cast("long").alias("pk"),
        (all_not_null(whole) if whole else F.lit(True)).alias("whole"), F.struct(*fields).alias("payload"))
    asked = periods.select(F.col(key).alias("key"), F.col(pk).cast("long").alias("pk"), lower.alias("lo"), upper.alias("hi"),
                           (lower if since is None else F.coalesce(since, lower)).alias("mid"))
    asked = asked.filter(F.col("key").isNotNull() & (F.col("lo") <= F.col("hi")))
    at = {_OPEN: "lo", _CLOSE: "hi"} | ({} if since is None else {_SINCE: "mid"})
    ends = F.array(*[F.struct(F.col(c).cast(kind).alias("t"), F.lit(k).alias("kind")) for k, c in at.items()])
    none = F.lit(None).cast(ev.schema["payload"].dataType)
    marks = asked.select("key", F.inline(ends), "pk").select("key", "t", "kind", "pk", F.lit(True).alias("whole"), none.alias("payload"))
    kinds = {f: t.simpleString() for f, t in ((c, ev.schema[c].dataType) for c in ("key", "payload"))}
    schema = f"part int, key {kinds['key']}, pk long, kind int, n long, n_whole long, payload {kinds['payload']}, first boolean"
    rows = scan_ranges(ev.unionByName(marks), [F.col("key"), F.col("t"), F.col("kind"), F.col("payload")], _step, schema, num_partitions)
    # two rows per range; a range inherits what earlier ranges end with, if that is its first key
    before = Window.partitionBy("key").orderBy("part", "kind").rowsBetween(Window.unboundedPreceding, -1)
    edges = rows.where(F.col("kind") >= _HEAD).select(
        "part", "kind", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("n", "n_whole")],
        F.last("payload", ignorenulls=True).over(before).alias("payload0"))
    edges = edges.where(F.col("kind") == _HEAD).drop("kind").withColumnRenamed("part", "part0")
    found = rows.where(F.col("kind") < _HEAD).join(F.broadcast(edges), F.col("first") & (F.col("part") == F.col("part0")), "left")
    more = lambda c: F.col(c) + F.coalesce(F.col(f"{c}0"), F.lit(0))
    closes, opens = F.col("kind") == _CLOSE, F.col("kind") == _OPEN
    counts = {c: F.sum(F.when(closes, more(c)).when(opens, -more(c))) for c in ("n", "n_whole")}
    counts["n_since"] = counts["n"] if since is None else F.greatest(F.sum(F.when(closes, more("n")).when(F.col("kind") == _SINCE, -more("n"))), F.lit(0))
    found = found.groupBy("pk").agg(*[v.alias(c) for c, v in counts.items()], F.max(F.when(closes, F.coalesce("payload", "payload0"))).alias("latest"))
    return found.select(F.col("pk").alias(pk), "n", "n_whole", "n_since", F.when(F.col("n") > 0, F.col("latest")).alias("latest"))


def facts_in_period(periods: DataFrame, events: DataFrame, pk: str, key: str, lower: Column, upper: Column, ts: str, counts: dict[str, str],
                    order: Sequence[str] = (), whole: Sequence[str] = (), event_filter: Column | None = None) -> DataFrame:
    """``periods`` with the columns of :func:`sweep_periods` under new names (``counts``: ``n`` or ``n_whole`` to a name).
    Every period comes back, with 0 where nothing matched; ``event_filter`` is applied to the events first."""
    ev = events if event_filter is None else events.filter(event_filter)
    found = sweep_periods(periods, ev, pk, key, lower, upper, ts, order, whole)
    out = periods.join(found.select(F.col(pk).alias("__pk"), *[F.col(c).alias(f"__{c}") for c in counts]), F.col(pk) == F.col("__pk"), "left")
    out = out.withColumns({name: F.coalesce(F.col(f"__{c}"), F.lit(0)).cast("long") for c, name in counts.items()})
    return out.drop("__pk", *[f"__{c}" for c in counts])
