"""Batch text enrichment: clean, analyse, parse the analysis JSON, flatten.

The analysis step is pluggable. The built-in analyzer is a set of keyword and
pattern rules written with Spark's own functions (JVM-side, no Python in the
hot path) and emitted as JSON text, so the parse/flatten half of the pipeline
is the same for any analyzer. A caller-supplied analyzer (e.g. a local model)
runs through an Arrow-batched pandas UDF: one Python call per batch, the
analyzer built once per worker, and any failure kept as data in
``raw_output`` instead of failing the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANALYSIS_SCHEMA = T.StructType([
    T.StructField("sentiment", T.StringType()),
    T.StructField("issue", T.StringType()),
    T.StructField("reference_numbers", T.StringType()),
    T.StructField("urgent", T.BooleanType()),
    T.StructField("summary", T.StringType()),
    T.StructField("raw_output", T.StringType()),
])

# Fixed values of the built-in rule analyzer.
POSITIVE = "thank|great|good|happy|excellent|love|pleased"
NEGATIVE = "bad|angry|complain|problem|error|fail|wrong|poor|unhappy"
URGENT = "urgent|asap|immediately|emergency"
ISSUES = [("billing", "bill|invoice|charge"), ("payment", "pay|refund"),
          ("meter", "meter|reading"), ("account", "account|login|password")]
REFERENCE = "[A-Z]{2,}[0-9]{3,}|[0-9]{6,}"
# up to three sentences, or a text without any end mark
SUMMARY = "^(?:[^.!?]*[.!?]){1,3}|^[^.!?]+"


def clean_text(c: str | Column) -> Column:
    """Line breaks (\\n, \\r) to spaces."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_replace(col, "\n", " "), "\r", " ")


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"(?i)({pattern})"), 0))


def rule_analysis(text: Column) -> Column:
    """JSON text with sentiment, issue, reference_numbers (array), urgent and
    summary, computed over the whole text; ``{"raw_output":null}`` for an
    empty or missing text."""
    pos, neg = _count(text, POSITIVE), _count(text, NEGATIVE)
    sentiment = (F.when(pos > neg, "positive").when(neg > pos, "negative").otherwise("neutral"))
    issue = F.lit("general")
    for name, pat in reversed(ISSUES):
        issue = F.when(text.rlike(f"(?i)({pat})"), F.lit(name)).otherwise(issue)
    refs = F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), 1)
    summary = F.trim(F.regexp_extract(text, SUMMARY, 0))
    analysed = F.to_json(F.struct(sentiment.alias("sentiment"), issue.alias("issue"),
                                  refs.alias("reference_numbers"),
                                  text.rlike(f"(?i)({URGENT})").alias("urgent"),
                                  summary.alias("summary")))
    return F.when(text.isNull() | (text == ""), F.lit('{"raw_output":null}')).otherwise(analysed)


# Analyzers built in this Python worker, by name. Module state survives from
# task to task in a reused worker, unlike state captured in the UDF closure
# (which is unpickled again for every task).
_ANALYZERS: dict[str, Callable[[str], object]] = {}


def python_analyzer(factory: Callable[[], Callable[[str], object]], name: str = "default"):
    """Wrap ``factory() -> analyze(text) -> dict | str`` as a pandas UDF
    returning JSON text. The analyzer is built once per Python worker and
    ``name`` (use distinct names for distinct analyzers)."""
    import pandas as pd

    def run(texts):
        fn = _ANALYZERS.get(name)
        if fn is None:
            fn = _ANALYZERS[name] = factory()
        out = []
        for t in texts:
            if t is None or t == "":
                out.append(json.dumps({"raw_output": None}))
                continue
            try:
                r = fn(t)
                out.append(r if isinstance(r, str) else json.dumps(r))
            except Exception as e:  # noqa: BLE001 - failures become data
                out.append(json.dumps({"raw_output": f"Error: {e}"}))
        return pd.Series(out)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}  # Series -> Series UDF
    return F.pandas_udf(run, T.StringType())


def enrich_text(df: DataFrame, text: str, keep: list[str], analyzer=None,
                schema: T.StructType = ANALYSIS_SCHEMA) -> DataFrame:
    """clean -> analyse -> ``from_json`` -> flatten.

    ``analyzer``: None for the built-in rules, or a UDF from
    :func:`python_analyzer`. Adds the schema's fields plus ``parse_ok``
    (false when the analysis text was not a JSON object, in which case the
    raw text is kept in ``raw_output`` instead of being lost).
    """
    cleaned = clean_text(text)
    raw = rule_analysis(cleaned) if analyzer is None else analyzer(cleaned)
    x = df.select(*keep, raw.alias("__json"))
    x = x.withColumn("__a", F.from_json("__json", schema))
    ok = F.json_object_keys(F.col("__json")).isNotNull()  # NULL unless a JSON object
    fields = [F.col(f"__a.{f.name}").alias(f.name) for f in schema.fields if f.name != "raw_output"]
    raw_out = F.when(ok, F.col("__a.raw_output")).otherwise(F.col("__json")).alias("raw_output")
    return x.select(*keep, *fields, raw_out, ok.alias("parse_ok"))
