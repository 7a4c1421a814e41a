"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has an expected number of copies (target words over
the source's words). Its prefix sum within the source, shifted by one random
offset, crosses an integer boundary once for each copy that is emitted. The
order within a source goes by size class and then by a hash of the id, so the
copies are stratified by size and the words taken come near the target.

Prefix sums are exact (integers in units of 2^-20 copies) and taken on three
levels: inside a bucket of about sqrt(n) ids, over the buckets of a size
class, over the classes of a source. No level puts a source in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.shared import Scratch

UNIT = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, sid, source_size, target`` per source from ``source, size`` rows.

    Sources in code point order (null last) take the weights in turn and share
    ``share`` times all words by weight; no target exceeds ``most`` times the
    words of its source, and what is above goes to the others by weight. That
    is a level L with target = min(cap, L * weight): sources in the order of
    cap / weight are capped as long as their share of the rest exceeds the cap.
    One row per source is all that is sorted as a whole.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*(F.lit(float(w)) for w in weights))
    by = by.withColumn("sid", F.row_number().over(order).cast("long"))
    by = by.withColumn("w", F.element_at(turn, ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rise = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    by = (by.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
          .withColumn("capped", F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
          .withColumn("rest", F.sum("w").over(rise.rowsBetween(0, Window.unboundedFollowing)))
          .withColumn("level", (F.col("total") * F.lit(float(share)) - F.col("capped")) / F.col("rest")))
    by = by.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(-(F.col("cap") / F.col("w")), -F.col("sid"), "level")))
                       .over(Window.partitionBy())["level"])
    # where even the caps do not add up to the share, every source is at its cap
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap"))
    return by.select("source", "sid", "source_size", target.alias("target"))


def systematic_copies(rows: DataFrame, group: str, expected: str, order: list, bucket: str, seed: str,
                      n: int, scratch: Scratch) -> DataFrame:
    """``rows`` with ``copies``: boundaries crossed by each row's ``expected``
    copies (long, in units of 2^-20) on the running sum of its group.

    ``order`` is a coarse class (long) and a string in hexadecimal digits that
    starts evenly distributed; ``bucket`` names the latter. ``n`` is the number of rows.
    """
    buckets = max(1, math.isqrt(max(n, 1)))
    cls = order[0]
    sub = F.floor(F.conv(F.substring(bucket, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long")
    rows = rows.withColumn("_sub", sub)
    inner = Window.partitionBy(group, cls, "_sub").orderBy(*order[1:])
    rows = rows.withColumn("_in", F.sum(expected).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    subs = rows.groupBy(group, cls, "_sub").agg(F.sum(expected).alias("_e"))
    before = Window.unboundedPreceding, -1
    zero = F.lit(0).cast("long")
    subs = subs.withColumn("_off1", F.coalesce(F.sum("_e").over(Window.partitionBy(group, cls).orderBy("_sub").rowsBetween(*before)), zero))
    classes = subs.groupBy(group, cls).agg(F.sum("_e").alias("_c"))
    classes = classes.select(group, cls, F.coalesce(F.sum("_c").over(Window.partitionBy(group).orderBy(cls).rowsBetween(*before)), zero).alias("_off2"))
    offsets = subs.join(classes, [group, cls]).select(group, cls, "_sub", (F.col("_off1") + F.col("_off2")).alias("_off"))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))), 1, 5), 16, 10).cast("long")
    end = F.col("_off") + F.col("_in") + start
    return (rows.join(offsets, [group, cls, "_sub"])
            .withColumn("copies", F.shiftright(end, 20) - F.shiftright(end - F.col(expected), 20))
            .drop("_sub", "_in", "_off"))


def mix_sources(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0,
                seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``, one row per row of ``docs``.

    Reads ``doc_id, text, source``. A null text has size 0, a null source is a
    source of its own that comes last. ``copies`` is 0, 1 or 2 with the default
    cap. Documents of a source without words get no copy. Equal rows are kept
    and share their copies in either order; a null id sorts as the empty text.
    Reruns and other partitionings give the same rows. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.table(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    n = sizes.count()
    plan = scratch.table(source_targets(sizes, weights, share, most), "plan")
    digits = F.col("size").cast("string")
    rows = (sizes.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source"))
            .select("d.*", "p.sid", "p.source_size", "p.target")
            .withColumn("_e", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT + 0.5)).otherwise(0).cast("long"))
            .withColumn("_class", (F.length(digits) * 10 + F.substring(digits, 1, 1).cast("int")).cast("long"))
            .withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))))
    out = systematic_copies(rows, "sid", "_e", ["_class", "_key", "size", "doc_id"], "_key", seed, n, scratch)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` (``mix_sources`` of the same rows) says.

    A null id is an id here. Rows of one id, source and size take the copies of
    just these rows of ``mixed``: all get the same number or one more, the first
    ones by a hash of their values. Rows are written once with a key of their
    own, so that the text meets its copies one to one however often an id recurs.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("at"))
    rows = Scratch(docs.sparkSession, "emit").table(rows, "rows")
    values = [f"row.`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
    key = F.struct(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), n_words(F.col("row.text")).alias("size"))
    plan = (mixed.groupBy(F.struct("doc_id", "source", "size").alias("key"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("total")).where("total > 0"))
    # nulls in a struct equal each other
    known = rows.select("at", key.alias("key"), F.xxhash64(*values).alias("order")).join(plan, "key")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("order", "at"))
    several = known.where("n > 1").withColumn("nth", nth).select("at", F.expr("total div n + if(nth <= total % n, 1, 0)").alias("copies"))
    copies = known.where("n = 1").select("at", F.col("total").alias("copies")).unionAll(several).where("copies > 0")
    return rows.join(copies, "at").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
