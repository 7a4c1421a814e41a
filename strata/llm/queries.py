"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import (decontam, embedding_dedup, filter_audit, jaccard_join, line_dedup, mixing, ppm, prefix_bpe, quality,
                        token_alignment, token_scan, toxicity, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT v.vec_id, coalesce((SELECT count(*) FROM link WHERE a = v.vec_id), 0)::BIGINT AS n_links,
       least(v.vec_id, coalesce(m, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept, v.label
FROM v LEFT JOIN comp ON comp.a = v.vec_id
"""


@register("op1_embedding_near_dedup", _NEAR_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: links, component and the one kept, at cosine 0.98."""
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.98)


_LINES_SQL = r"""
WITH line AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL
), tok AS (
  SELECT doc_id, pos, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
         lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t FROM line
), cut AS (
  SELECT doc_id, pos, t, len(t) AS n, (len(t) - 2) // 3 AS a, (len(t) - 2) * 2 // 3 AS b FROM tok WHERE len(t) >= 3
), tpl AS (
  SELECT doc_id, pos, [n::VARCHAR] || t AS key FROM cut WHERE n < 8
  UNION ALL
  SELECT doc_id, pos, [n::VARCHAR, 'open', o::VARCHAR] || t[:2 + CASE o WHEN 0 THEN 0 WHEN 1 THEN a ELSE b END]
         || t[3 + CASE o WHEN 0 THEN a WHEN 1 THEN b ELSE n END:] AS key
  FROM cut, (VALUES (0), (1), (2)) w(o) WHERE n >= 8
), known AS (
  SELECT key, min(row(doc_id, pos)) AS head FROM tpl GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), lost AS (
  SELECT DISTINCT doc_id, pos FROM tpl JOIN known USING (key) WHERE row(doc_id, pos) <> head
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS n
  FROM line l ANTI JOIN lost d ON l.doc_id = d.doc_id AND l.pos = d.pos GROUP BY l.doc_id
)
SELECT d.doc_id, len(string_split(d.text, chr(10)))::BIGINT AS n_lines,
       (len(string_split(d.text, chr(10))) - coalesce(k.n, 0))::BIGINT AS n_dropped,
       length(coalesce(k.text, ''))::BIGINT AS kept_chars, md5(coalesce(k.text, '')) AS kept_md5
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


@register("op2_line_dedup", _LINES_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines whose template recurs; a digest of each remaining text."""
    out = line_dedup.drop_recurring_lines(read(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"), F.md5(text).alias("kept_md5"))


@register("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((sid - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap,
         (SELECT sum(size) FROM d)::DOUBLE AS total FROM s
), l AS (
  SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, sid, source_size, coalesce(least(cap, w * (SELECT arg_min(level, row(cap / w, sid)) FROM l WHERE level * w <= cap)), cap) AS target FROM l
), e AS (
  SELECT d.*, t.sid, t.source_size, t.target, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key,
         CASE WHEN source_size > 0 THEN floor(target / source_size * 1048576 + 0.5)::BIGINT ELSE 0 END AS e,
         length(size::VARCHAR) * 10 + substr(size::VARCHAR, 1, 1)::INT AS cls
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, ('0x' || substr(md5('mix:' || sid::VARCHAR), 1, 5))::BIGINT
            + sum(e) OVER (PARTITION BY sid ORDER BY cls, key, size, doc_id ROWS UNBOUNDED PRECEDING) AS hi FROM e
)
SELECT doc_id, source, size, source_size, target, ((hi // 1048576) - ((hi - e) // 1048576))::BIGINT AS copies,
       (((hi // 1048576) - ((hi - e) // 1048576)) * size)::BIGINT AS taken FROM p
"""


@register("op4_source_mix", _MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1 at 150 % of all words."""
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


@register("op5_benchmark_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: whether it holds benchmark items, which, and how closely."""
    out = decontam.find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.col("hits.item_id").alias("item_ids"),
                      F.array_max("hits.cosine").alias("cosine"), F.array_max("hits.lcs").alias("lcs"))


@register("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted from flat token files written for them."""
    return token_scan.document_token_counts(read(spark, sf_dir, "documents"))


@register("op7_ngram_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: 4-word shingles, component and links at a Jaccard similarity of 85 %."""
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"))


#: The rules of the contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_URL_SQL = r"""
WITH r(h, p, verdict) AS (VALUES %s), u AS (
  SELECT page_id, row_number() OVER () AS k,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), best AS (
  SELECT k, arg_max(row(h || p, verdict), length(h) + length(p)) AS b
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k
)
SELECT page_id, host, path, b[1] AS rule, coalesce(b[2], 'allow') AS verdict FROM u LEFT JOIN best USING (k)
""" % ", ".join(str(r) for r in URL_RULES)


@register("op8_url_filter", _URL_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), rules)


@register("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op10_ppm_score")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte model's and the unigram base's log10 probability of every document."""
    return ppm.score_documents(read(spark, sf_dir, "documents"))


_AUDIT_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
                100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'),
                coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE)] AS fails,
         coalesce(l.good, FALSE) AS good, coalesce(l.toxic, FALSE) AS toxic
  FROM t LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL
), f(i) AS (VALUES (1), (2), (3), (4), (5)), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT array_to_string(list_transform(o, lambda x: chr(64 + x)), '') AS filter_order, s.i AS step, o[s.i] AS own, o[:s.i - 1] AS before
  FROM orders, f s
), hit AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS mine,
         len(list_filter(before, lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_failed
  FROM steps, g
), r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT mine AND NOT gone), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mine AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mine AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mine AND n_failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mine AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mine AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM hit GROUP BY ALL
)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""


@register("op11_filter_audit", _AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language, order of five filters and step: what is kept, removed, redundant and lost."""
    return filter_audit.filter_interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op12_prefix_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded: tokens, digests of the ids and of the decoded bytes."""
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    out = prefix_bpe.decode_documents(prefix_bpe.encode_documents(read(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text under two tokenizers: groups, links and how common the linked pairs are."""
    return token_alignment.align_documents(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
