"""URL rules by a sort-merge range join with a stack of nested rules.

A host is written with its labels reversed (``org|example|blog|``). The hosts
that a rule fits, its own and all subdomains, are then one interval of the
sort order, and the intervals of two rules nest or are apart. Rules and URLs
are range-partitioned and sorted together by that key. One sweep over a
partition keeps the stack of rules whose interval is open; a URL looks only at
that stack. Rules that opened before a partition begins are found by an
equi-join on the label prefixes of the partition's first key.

The sort goes on to path and id below the host, so a host that holds a third
of all URLs is spread over many partitions. Only id and URL are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"://([^/?#]*)([^?#]*)"
_SEP = "\u0001"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by a separator; '' for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), _SEP), F.lit(_SEP)))


def _sweep(default: str):
    def best(stack: list, path: str) -> tuple:
        found = None
        for key, size, paths, lengths in stack:
            for n in lengths:  # longest first
                if n <= len(path) and (hit := paths.get(path[:n])) is not None:
                    if found is None or (size + n, size) > found[0]:
                        found = ((size + n, size), hit)
                    break
        return found[1] if found else (None, default)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []
        for batch in batches:
            ids, hosts, paths, rules, verdicts = [], [], [], [], []
            cols = batch.to_pydict()
            for p, key, kind, host, path, verdict, pid in zip(*(cols[c] for c in (
                    "part", "key", "kind", "host", "path", "verdict", "page_id")), strict=True):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, len(host), {}, []))
                    _, _, known, lengths = stack[-1]
                    if path not in known or verdict == "block":
                        known[path] = (host + path, verdict)
                    if len(path) not in lengths:
                        lengths.append(len(path))
                        lengths.sort(reverse=True)
                else:
                    rule, verdict = best(stack, path)
                    ids.append(pid), hosts.append(host), paths.append(path), rules.append(rule), verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("page_id").type), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))],
                ["page_id", "host", "path", "rule", "verdict"])
    return run


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """Judge every URL: ``page_id, host, path, rule, verdict``, one row per row of ``pages``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all
    subdomains if the URL's path starts with the rule's path. The longest
    (characters of host and path; then of host) wins; of equal rules with two
    verdicts, block. A URL no rule fits has a null rule and ``default``. A null
    URL or one without ``://`` has empty host and path and fits nothing. Rules
    with a null field or an empty host are ignored. Repeated rows and null ids
    are kept; other columns of either table are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    u = F.col(url_col)
    urls = (pages.select(F.col(id_col).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
            .select("page_id", "host", "path", host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"),
                    F.lit(None).cast("string").alias("verdict")))
    laws = (rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.col("path").cast("string").alias("path"),
                         F.col("verdict").cast("string").alias("verdict"))
            .where("host <> '' and path is not null and verdict is not null").distinct()
            .select(F.lit(None).cast(pages.schema[id_col].dataType).alias("page_id"), "host", "path",
                    host_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), "verdict"))
    dealt = (urls.unionByName(laws).repartitionByRange("key", "kind", "path", "page_id")
             .withColumn("part", F.spark_partition_id()))
    dealt = scratch.table(dealt, "dealt")  # partition numbers stay as they are from here on
    # rules open at the start of a partition: those on a label prefix of its first key
    first = dealt.groupBy("part").agg(F.min("key").alias("first"))
    labels = F.split("first", _SEP)  # ends with an empty string
    heads = first.select("part", F.explode(F.expr(
        f"transform(sequence(1, greatest(1, size(split(first, '{_SEP}')) - 1)),"
        f" i -> concat(array_join(slice(split(first, '{_SEP}'), 1, i), '{_SEP}'), '{_SEP}'))")).alias("key"))
    carried = heads.join(laws, "key").select(*dealt.columns)
    rows = (dealt.unionByName(carried).repartition("part")
            .sortWithinPartitions("part", "key", "kind", "path", "page_id"))
    schema = f"page_id {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string"
    return rows.mapInArrow(_sweep(default), schema)
