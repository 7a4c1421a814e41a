"""How a set of document filters interact, whatever their order.

Every filter keeps, for each part of the corpus and each range of row keys, the
sorted list of the rows that fail it (a posting list). What a filter removes
after others is its list less the union of theirs; so all orders of the
filters need only the sizes of these differences for every set of filters that
may come before. Lists are merged range by range: a cursor in each list gallops
(doubling steps, then a binary search) to the end of the next id range, and
unions and differences are taken of the short slices in between. Ranges are
disjoint, so sizes add up over ranges, tasks and machines; no list of a whole
part is ever in one place.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm import bytescan
from strata.llm.shared import Scratch

#: The filters in the order of their bits, and the marks of filter D.
FILTERS = "ABCDE"
MARKS = b"#$%&*|"
#: consecutive rows of one task of the scan that share a posting list
BLOCK_BITS = 17


def gallop(ids: np.ndarray, at: int, bound: int) -> int:
    """The first position from ``at`` on whose id is above ``bound``: doubling steps, then a binary search."""
    step, hi = 1, at
    while hi < len(ids) and ids[hi] <= bound:
        at, hi, step = hi + 1, hi + step, step * 2
    hi = min(hi, len(ids))
    return at + int(np.searchsorted(ids[at:hi], bound, "right"))


def id_ranges(lists: Sequence[np.ndarray], size: int = 4096) -> Iterator[list[np.ndarray]]:
    """Slices of all sorted lists over the same id range, range by range; a slice has at most ``size`` ids."""
    at = [0] * len(lists)
    while True:
        ends = [int(x[min(a + size, len(x)) - 1]) for x, a in zip(lists, at, strict=True) if a < len(x)]
        if not ends:
            return
        to = [gallop(x, a, min(ends)) for x, a in zip(lists, at, strict=True)]
        yield [x[a:b] for x, a, b in zip(lists, at, to, strict=True)]
        at = to


def _held(ids: np.ndarray, within: np.ndarray) -> np.ndarray:
    """For each of the sorted ids whether the sorted list ``within`` has it."""
    if not len(within):
        return np.zeros(len(ids), bool)
    i = np.searchsorted(within, ids)
    return within[np.minimum(i, len(within) - 1)] == ids


def interaction_sizes(fails: Sequence[np.ndarray], marks: Sequence[np.ndarray], size: int = 4096) -> np.ndarray:
    """``[f, s]`` -> ids in list f and in no list of the set s (a bit mask), the size of the
    union of s and f, and how many of the former are in each list of ``marks``.

    Lists are sorted and without repeats. Entries whose s holds f stay 0.
    """
    k = len(fails)
    out = np.zeros((k, 1 << k, 2 + len(marks)), np.int64)
    for part in id_ranges([*fails, *marks], size):
        lists, flags = part[:k], part[k:]
        union = [lists[0][:0]]
        for s in range(1, 1 << k):
            low = (s & -s).bit_length() - 1
            rest, own = union[s & (s - 1)], lists[low]
            new = own[~_held(own, rest)]
            union.append(np.sort(np.concatenate([rest, new]), kind="stable") if len(new) else rest)
        for f in range(k):
            for s in range(1 << k):
                if s >> f & 1:
                    continue
                left = lists[f][~_held(lists[f], union[s])]
                out[f, s, 0] += len(left)
                out[f, s, 1] += len(union[s | 1 << f])
                for m, flag in enumerate(flags):
                    out[f, s, 2 + m] += int(_held(left, flag).sum())
    return out


def _counts(hit: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])
    return run[off[1:]] - run[off[:-1]]


def _text_fails(min_words: int, distinct_pct: int, upper_pct: int):
    upper = np.zeros(256, bool)
    upper[ord("A"):ord("Z") + 1] = True
    mark = np.zeros(256, bool)
    mark[list(MARKS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytescan.slices(batch, "text"):
                raw, off = bytescan.buffer_of(part.column("text"))
                s, e, at = bytescan.words(raw, off)
                n_words = np.diff(at)
                doc = np.repeat(np.arange(part.num_rows), n_words)
                own = bytescan.runs(np.stack([bytescan.span_hashes(raw, s, e), doc.astype(np.uint64)], 1).ravel(), 2)[::2] if len(s) else np.zeros(0, np.uint64)
                first = np.unique(own, return_index=True)[1]
                distinct = np.bincount(doc[first], minlength=part.num_rows)
                points = _counts((raw & 0xC0) != 0x80, off)
                fails = ((n_words < min_words) * 1 + (100 * distinct < distinct_pct * n_words) * 2
                         + (100 * _counts(upper[raw], off) > upper_pct * points) * 4 + (_counts(mark[raw], off) > 0) * 8)
                data = raw.tobytes()
                digest = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in itertools.pairwise(off.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array(fails.astype(np.int32)), pa.array(digest, pa.binary())],
                                                 ["doc_id", "part", "fails", "digest"])
    return run


_SIZES = "part string, f int, before int, removed long, together long, good long, toxic long"


def _block_sizes(table: pa.Table) -> pa.Table:
    """Posting lists of one part and id range, and the sizes of all their differences."""
    order = np.argsort(table.column("key").to_numpy())
    key, fails, good, toxic = (table.column(c).to_numpy()[order] for c in ("key", "fails", "good", "toxic"))
    lists = [key[(fails >> f & 1) == 1] for f in range(len(FILTERS))]
    sizes = interaction_sizes(lists, [key[good], key[toxic]])
    f, s = np.nonzero(sizes[:, :, 1])
    found = sizes[f, s]
    cols = [f.astype(np.int32), s.astype(np.int32), *(found[:, i] for i in range(4))]
    return pa.table([pa.array([table.column("part")[0].as_py()] * len(f), pa.string()), *map(pa.array, cols)],
                    names=["part", "f", "before", "removed", "together", "good", "toxic"])


def _prefix_mask(order: Column, step: Column) -> Column:
    head = F.substring(order, F.lit(1), step - 1)
    bits = [F.when(F.contains(head, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)]
    return reduce(Column.__add__, bits)


def filter_interactions(docs: DataFrame, labels: DataFrame, min_words: int = 200, distinct_pct: int = 50, upper_pct: int = 3) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``: one row per part, order of the five filters and step.

    Reads ``doc_id, text, lang`` and ``doc_id, quality, toxic``; other columns are ignored.
    A text fails A with fewer than ``min_words`` words, B when its distinct words are under
    ``distinct_pct`` % of them, C when letters A-Z are over ``upper_pct`` % of its code points,
    D when it holds one of ``# $ % & * |``, E when a row with a smaller id has the same text.

    * A null text is an empty one; a null lang is part ''. A null id is neither smaller than
      another nor has a smaller one, so it never fails E and has no label.
    * Every row counts, rows that repeat an id too; equal ids do not fail E by each other.
    * A document is good (toxic) if any of its label rows says 1.
    * An empty table has no parts and gives no rows.

    Words are compared by 64-bit hash within a text, whole texts by a 128-bit digest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "audit")
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    scanned = texts.mapInArrow(_text_fails(min_words, distinct_pct, upper_pct), f"doc_id {kind}, part string, fails int, digest binary")
    rows = scratch.table(scanned.withColumn("key", F.monotonically_increasing_id()), "rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    first = scratch.table(first, "first")
    copied = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    failing = (rows.join(first, "digest", "left").withColumn("fails", F.col("fails") + F.when(copied, 16).otherwise(0))
               .where("fails > 0").select("doc_id", "part", "key", "fails"))
    flags = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                                         F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = (failing.join(flags.where("doc_id is not null and (good or toxic)"), "doc_id", "left")
              .select("part", "key", F.shiftright("key", BLOCK_BITS).alias("block"), "fails",
                      F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))
    blocks = marked.groupBy("part", "block").applyInArrow(_block_sizes, _SIZES)
    sizes = scratch.table(blocks.groupBy("part", "f", "before").agg(*[F.sum(c).alias(c) for c in ("removed", "together", "good", "toxic")]), "sizes")
    k = len(FILTERS)
    # orders in which exactly a set of n filters comes before one
    weight = F.element_at(F.array(*[F.lit(math.factorial(n) * math.factorial(k - 1 - n)) for n in range(k)]), F.bit_count("before") + 1)
    others = F.element_at(F.array(*[F.lit((1 << k) - 1 - (1 << f)) for f in range(k)]), F.col("f") + 1)
    alone = sizes.groupBy("part", "f").agg(F.sum(F.col("removed") * weight).alias("shapley"), F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("n_fails"),
                                           F.max(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    grid = (rows.groupBy("part").agg(F.count(F.lit(1)).alias("total")).select("part", "total", F.explode(orders).alias("filter_order"))
            .select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")))
    grid = grid.withColumns({"f": F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1, "before": _prefix_mask(F.col("filter_order"), F.col("step"))})
    out = grid.join(sizes, ["part", "f", "before"], "left").join(alone, ["part", "f"], "left")
    of = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("part", "filter_order", "step", (F.col("total") - of("together")).alias("kept"), of("removed").alias("removed"),
                      (of("n_fails") - of("removed")).alias("redundant"), of("unique_fails").alias("unique_fails"), of("good").alias("good_lost"),
                      of("toxic").alias("toxic_lost"), of("shapley").alias("shapley"))
