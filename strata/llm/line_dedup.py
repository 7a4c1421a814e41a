"""Line dedup by a fixed-depth template tree, in DataFrame functions only.

A line is cut into tokens; tokens with a digit become ``<*>``. The tree has
three levels: the number of tokens, the leading tokens, and at the leaf the
template. A short line is its own template. The tokens after the leading ones
of a longer line form three fields, and each of the line's three templates
generalises one field to a wildcard, so lines that differ in one field (names,
titles, a changed phrase) share a template. A template found in
``min_docs`` documents recurs. Its lines are dropped but for the first one in
the order of document and position.

Only 64-bit keys of templates with document and position are shuffled;
documents per template are counted from distinct pairs, so a line that a third
of all documents share is combined before the shuffle, and the join back is a
plain equi-join whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import Scratch

BLANKS = r"[\x20\x09-\x0D]+"
DIGIT_WORD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
WILD = "<*>"


def template_keys(docs: DataFrame, depth: int = 2, min_fields: int = 8, min_tokens: int = 3) -> DataFrame:
    """``key, doc_id, pos, h`` for every line with at least ``min_tokens`` tokens of a
    document with an id; ``h`` tells the texts of one id apart."""
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    masked = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", DIGIT_WORD, WILD)).otherwise(F.col("line"))
    # one blank at either end, so that the first and last pieces of the split are empty and carry no token
    tok = lines.select("doc_id", "h", "pos", F.split(F.concat(F.lit(" "), masked, F.lit(" ")), BLANKS).alias("t"))
    tok = tok.withColumn("n", F.size("t") - 2).where(F.col("n") >= min_tokens)
    rest = F.col("n") - depth
    a, b = F.floor(rest / 3).cast("int"), F.floor(rest * 2 / 3).cast("int")
    field = [F.xxhash64(F.slice("t", F.lit(2), F.lit(depth))),
             F.xxhash64(F.slice("t", F.lit(2 + depth), a)),
             F.xxhash64(F.slice("t", F.lit(2 + depth) + a, b - a)),
             F.xxhash64(F.slice("t", F.lit(2 + depth) + b, rest - b))]
    tok = tok.withColumns({f"f{i}": f for i, f in enumerate(field)})
    whole = F.array(F.xxhash64("n", F.lit(0), "t"))
    open_one = F.array(F.xxhash64("n", F.lit(1), "f0", "f2", "f3"), F.xxhash64("n", F.lit(2), "f0", "f1", "f3"),
                       F.xxhash64("n", F.lit(3), "f0", "f1", "f2"))
    return tok.select(F.explode(F.when(F.col("n") < min_fields, whole).otherwise(open_one)).alias("key"), "doc_id", "pos", "h")


def recurring_lines(docs: DataFrame, scratch: Scratch, min_docs: int = 2, **tree) -> DataFrame:
    """``doc_id, h, dropped`` (sorted positions) for the texts that lose lines."""
    keys = scratch.table(template_keys(docs, **tree), "keys")
    pairs = keys.groupBy("key", "doc_id").agg(F.min(F.struct("pos", "h")).alias("at"))
    found = (pairs.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "at.pos", "at.h")).alias("first"))
             .where(F.col("n") >= min_docs).select("key", "first"))
    hits = keys.join(found, "key").where("doc_id <> first.doc_id or pos <> first.pos or h <> first.h")
    return hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 2, depth: int = 2, min_fields: int = 8, min_tokens: int = 3) -> DataFrame:
    """``docs`` with ``text`` without recurring lines, and ``n_lines``,
    ``n_dropped`` (long); other columns are kept as they are, but for those
    two names, which are replaced.

    Lines end at ``\\n``; a null text has 0 lines and stays null, an empty text
    has one (empty) line. Lines of fewer than ``min_tokens`` tokens are kept.
    Rows with a null id are kept whole and do not count. Rows of one id count
    as one document; each loses its own lines, equal rows the same. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lost = recurring_lines(docs.select("doc_id", "text"), scratch, min_docs, depth=depth, min_fields=min_fields, min_tokens=min_tokens)
    # the row travels as one struct, so that no name of its can clash
    out = docs.select(F.struct(*cols).alias("row")).join(lost.withColumnRenamed("doc_id", "id"), (F.col("row.doc_id") == F.col("id")) & (F.xxhash64("row.text") == F.col("h")), "left")
    text = F.col("row.text")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    new = F.when(F.col("dropped").isNull(), text).otherwise(kept)
    return out.select(*(new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in cols),
                      F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long").alias("n_lines"),
                      F.when(text.isNull(), 0).otherwise(F.coalesce(F.size("dropped"), F.lit(0))).cast("long").alias("n_dropped"))
