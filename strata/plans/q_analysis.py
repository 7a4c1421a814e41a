"""Query: messages analysed by a fitted model in batches, failures included."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.analysis import WORD, analyze_texts, fit_word_votes, word_vote_analyzer
from strata.plans import fixtures as fx
from strata.plans.oracle_fixtures import with_ctes
from strata.plans.registry import register
from strata.sources.tables import Tables

SCHEMA = T.StructType([T.StructField("sentiment", T.StringType()), T.StructField("issue", T.StringType()), T.StructField("evidence", T.LongType()),
                       T.StructField("urgent", T.BooleanType()), T.StructField("summary", T.StringType())])
#: words of the model, and characters of a text from which its reply is cut off
MODEL_WORDS, LONGEST_REPLY = 300, 1200

_WORDS = f"regexp_extract_all(lower(t), '{WORD}')"


@register("q_analyze_messages", with_ctes(["messages"], f"""
SELECT id, turn, if(bad, NULL, if(total > 0, 'positive', if(total < 0, 'negative', 'neutral'))) AS sentiment, if(bad, NULL, issue) AS issue,
       if(bad, NULL, evidence) AS evidence, if(bad, NULL, contains(t, '!')) AS urgent, if(bad, NULL, trim(string_split(t, '.')[1], ' ')) AS summary,
       CASE WHEN coalesce(t, '') = '' THEN 'empty' WHEN evidence = 0 THEN 'error' WHEN bad THEN 'malformed' WHEN dots >= 3 THEN 'fenced' ELSE 'ok' END AS status,
       if(evidence = 0, 'Error: no known word', NULL) AS error
FROM (
  SELECT *, coalesce(t, '') = '' OR evidence = 0 OR length(t) > {LONGEST_REPLY} AS bad, length(t) - length(replace(t, '.', '')) AS dots,
         list_min(list_filter(words, lambda w: votes[w] IS NOT NULL)) AS issue, coalesce(list_sum(list_transform(words, lambda w: votes[w])), 0) AS total
  FROM (SELECT *, if(coalesce(t, '') = '', NULL, len(list_filter(words, lambda w: votes[w] IS NOT NULL))) AS evidence
        FROM (SELECT id, turn, translate(text, chr(10) || chr(13), '  ') AS t FROM messages) m, LATERAL (SELECT {_WORDS} AS words) w, model))""", extra=[f"""rated AS (
  SELECT toxic, list_distinct({_WORDS}) AS words FROM (SELECT toxic, text AS t FROM documents JOIN labels USING (doc_id) WHERE toxic IN (0, 1))),
shares AS (
  SELECT word, (count_if(toxic = 0) * (SELECT sum(toxic) FROM rated) - count_if(toxic = 1) * (SELECT sum(1 - toxic) FROM rated))::BIGINT AS weight
  FROM (SELECT toxic, unnest(words) AS word FROM rated) GROUP BY word),
model AS (
  SELECT map_from_entries(list(row(word, sign(weight)::INT))) AS votes
  FROM (SELECT * FROM shares WHERE weight <> 0 ORDER BY abs(weight) DESC, word LIMIT {MODEL_WORDS}))"""]))
def q_analyze_messages(spark, sf):
    """All turns analysed by a model fitted on the labelled documents: parsed fields, what became of the reply, and failures as rows."""
    t = Tables(spark, sf)
    rated = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "toxic"), "doc_id")
    # the model: at most MODEL_WORDS words
    votes = {r["word"]: r["vote"] for r in fit_word_votes(rated, "text", "toxic", MODEL_WORDS).collect()}
    out = analyze_texts(fx.messages(t), "text", ["id", "turn"], lambda: word_vote_analyzer(votes, LONGEST_REPLY), f"votes-{uuid.uuid4().hex}", SCHEMA)
    return out.withColumn("error", F.when(F.col("status") == "error", F.col("raw_output"))).drop("raw_output")
