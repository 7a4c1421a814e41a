"""Queries: JSON extraction and the text enrichment pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata.operators.text import (ISSUES, NEGATIVE, POSITIVE, REFERENCE, SUMMARY, URGENT,
                                   enrich_text)
from strata.plans import fixtures as fx
from strata.plans.oracle_fixtures import with_ctes
from strata.plans.registry import register
from strata.sources.tables import Tables


@register("q_json_extract", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       json_valid(props) AND json_type(props) = 'OBJECT' AS parse_ok
FROM events""")
def q_json_extract(spark, sf):
    """Typed field out of a JSON text column (``from_json`` with a schema)."""
    ev = Tables(spark, sf).events.select("event_id", "props")
    parsed = F.from_json("props", "k bigint")
    return ev.select("event_id", parsed.getField("k").alias("k"),
                     F.json_object_keys("props").isNotNull().alias("parse_ok"))


_ISSUE_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(t, '(?i)({pat})') THEN '{name}'" for name, pat in ISSUES) + \
    " ELSE 'general' END"


@register("q_text_enrich", with_ctes(["messages"], f"""
SELECT id, turn,
       CASE WHEN e THEN NULL WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative'
            ELSE 'neutral' END AS sentiment,
       CASE WHEN e THEN NULL ELSE {_ISSUE_SQL} END AS issue,
       CASE WHEN e THEN NULL ELSE to_json(regexp_extract_all(t, '({REFERENCE})', 1))::VARCHAR END
         AS reference_numbers,
       CASE WHEN e THEN NULL ELSE regexp_matches(t, '(?i)({URGENT})') END AS urgent,
       CASE WHEN e THEN NULL ELSE trim(regexp_extract(t, '{SUMMARY}', 0)) END AS summary,
       CAST(NULL AS VARCHAR) AS raw_output, TRUE AS parse_ok
FROM (SELECT id, turn, t, (t IS NULL OR t = '') AS e,
             len(regexp_extract_all(t, '(?i)({POSITIVE})')) AS pos,
             len(regexp_extract_all(t, '(?i)({NEGATIVE})')) AS neg
      FROM (SELECT id, turn, replace(replace(text, chr(10), ' '), chr(13), ' ') AS t
            FROM messages) c) x"""))
def q_text_enrich(spark, sf):
    """All turns: clean, analyse (built-in rules), parse JSON, flatten."""
    return enrich_text(fx.messages(Tables(spark, sf)), "text", ["id", "turn"])
