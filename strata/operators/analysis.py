"""Per-row analysis by a model of one's own, in batches, whose failures are rows.

The analyzer is any ``text -> dict | str`` built by a factory; a reply is what a
hosted model would send: JSON text, perhaps in a code fence, cut off, or not
JSON at all. Replies are parsed by Spark, and what became of each row is a
column, so that no row and no reply is lost and a bad one does not end the job.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.text import clean_text

#: where a Python worker keeps what it has built, for all tasks it runs: a function that travels by value has no module to keep it in
_KEEPER = "strata_worker_state"
#: the words of a text, in lower case
WORD = r"[^ \t\r\n.,]+"


def once_per_worker(name: str, build: Callable[[], object]) -> object:
    """What ``build`` returned the first time this Python process asked for ``name``."""
    kept = sys.modules.setdefault(_KEEPER, types.ModuleType(_KEEPER)).__dict__
    if name not in kept:
        kept[name] = build()
    return kept[name]


def reply_in_batches(df: DataFrame, text: str, keep: Sequence[str], factory: Callable[[], Callable[[str], object]], name: str,
                     reply: str = "reply", failed: str = "failed") -> DataFrame:
    """``keep`` columns, ``text``, ``reply`` and ``failed`` per row: what the analyzer says to each text.

    ``factory`` runs once per Python worker and ``name``, not once per task or
    batch (name models that differ differently). A null or empty text is not
    asked about (null reply). An exception is a reply ``Error: ...`` with
    ``failed``; the other rows of the batch are not touched by it.
    """
    def run(batches):
        analyze = once_per_worker(name, factory)
        for batch in batches:
            replies, bad_ones = [], []
            for t in batch.column("text").to_pylist():
                bad = False
                try:
                    said = analyze(t) if t else None
                    said = said if said is None or isinstance(said, str) else json.dumps(said)
                except Exception as e:  # noqa: BLE001 - a failure is a row
                    said, bad = f"Error: {e}", True
                replies.append(said)
                bad_ones.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(replies, pa.string()), pa.array(bad_ones, pa.bool_())],
                                             ["row", "text", "reply", "failed"])

    inner = ", ".join(f"c{i}: {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    asked = df.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]).alias("row"), F.col(text).alias("text"))
    out = asked.mapInArrow(run, f"row struct<{inner}>, text string, reply string, failed boolean")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(keep)], F.col("text").alias(text), F.col("reply").alias(reply), F.col("failed").alias(failed))


def parse_replies(replies: DataFrame, keep: Sequence[str], schema: T.StructType, reply: str = "reply", failed: str = "failed") -> DataFrame:
    """``keep``, the fields of ``schema``, ``status`` and ``raw_output`` of each row of :func:`reply_in_batches`.

    ``status``: ``ok``; ``fenced`` (JSON in a code fence, parsed all the same);
    ``malformed`` (no JSON object; fields are null); ``error``; ``empty``. Where
    there are no fields, ``raw_output`` has the reply.
    """
    said, fence = F.col(reply), r"^\s*```[A-Za-z]*\s*|\s*```\s*$"
    x = replies.withColumn("__body", F.regexp_replace(said, fence, ""))
    x = x.withColumn("__ok", F.json_object_keys("__body").isNotNull() & ~F.col(failed))
    x = x.withColumn("__a", F.when(F.col("__ok"), F.from_json("__body", schema)))
    status = (F.when(said.isNull(), "empty").when(F.col(failed), "error").when(F.coalesce(~F.col("__ok"), F.lit(True)), "malformed")
              .when(said.rlike(r"^\s*```"), "fenced").otherwise("ok"))
    return x.select(*keep, *[F.col(f"__a.{f.name}").alias(f.name) for f in schema.fields], status.alias("status"),
                    F.when(F.coalesce(~F.col("__ok"), F.lit(True)), said).alias("raw_output"))


def fit_word_votes(texts: DataFrame, text: str, label: str, size: int = 1000) -> DataFrame:
    """``word, vote`` (1 or -1) of the ``size`` words that tell label 0 from label 1 best.

    A word's weight is p * N1 - n * N0 for the p texts of N0 with label 0 and the
    n of N1 with label 1 that hold it (the difference of its two shares, in
    whole numbers); the largest in size count, ties by word. ``size`` is the
    model's size, whatever the corpus has. Texts without a label are left out.
    """
    rows = texts.where(F.col(label).isin(0, 1)).select(F.col(label).cast("long").alias("y"), F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)).alias("words"))
    totals = rows.agg(F.struct(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1"))).scalar()
    counts = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum(1 - F.col("y")).alias("p"), F.sum("y").alias("n"))
    weight = F.col("p") * totals["n1"] - F.col("n") * totals["n0"]
    ranked = counts.withColumn("weight", weight).where("weight <> 0").orderBy(F.abs("weight").desc(), "word").limit(size)
    return ranked.select("word", F.signum("weight").cast("int").alias("vote"))


def word_vote_analyzer(votes: dict[str, int], longest_reply: int = 1500) -> Callable[[str], str]:
    """An analyzer from fitted votes, with the habits of a chat model: replies to
    several sentences come in a code fence, and a text above ``longest_reply``
    characters uses up the room before the reply is complete."""
    find = re.compile(WORD).findall

    def analyze(text: str) -> str:
        words = find(text.lower())
        known = [w for w in words if w in votes]
        if not known:
            raise ValueError("no known word")
        total = sum(votes[w] for w in known)
        reply = json.dumps({"sentiment": "positive" if total > 0 else "negative" if total < 0 else "neutral", "issue": min(known),
                            "evidence": len(known), "urgent": "!" in text, "summary": text.split(".")[0].strip(" ")}, ensure_ascii=False)
        if len(text) > longest_reply:
            return reply[:len(reply) // 2]
        return f"```json\n{reply}\n```" if text.count(".") >= 3 else reply
    return analyze


def analyze_texts(df: DataFrame, text: str, keep: Sequence[str], factory: Callable[[], Callable[[str], object]], name: str, schema: T.StructType) -> DataFrame:
    """Clean, ask in batches, parse: ``keep``, fields, ``status`` and ``raw_output`` per row."""
    cleaned = df.select(*keep, clean_text(text).alias("__text"))
    return parse_replies(reply_in_batches(cleaned, "__text", keep, factory, name, "__reply", "__failed"), keep, schema, "__reply", "__failed")
