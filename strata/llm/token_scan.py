"""Token counts from flat token files without an index.

A flat file is a row of fixed-width token ids, documents one after the other,
each closed by an end-of-document id. Files are cut into blocks of a fixed
size, which tasks read with ranged reads. A vectorised search finds the end
ids of a block; documents that begin and end in the block are counted there.
A prefix scan over the block summaries of a file (largest end position so far,
number of ends so far) gives each block the document it starts in, so lengths
that cross one or many blocks, and document numbers, are stitched without
reading anything twice.

Files are opened with pyarrow's file systems (local, S3, GCS, HDFS paths), so
blocks of one huge file spread over the cluster.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata.llm import bytescan
from strata.llm.shared import Scratch, remove

#: Fixed value: how the byte-level vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_ID = 50_256


def _open(path: str):
    """File system and path in it; Hadoop writes file:/x for file:///x, and s3a for s3."""
    from pyarrow import fs
    scheme, sep, rest = path.partition(":/")
    if not sep:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:/{rest}")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file (base64 token, blank, id per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Tokenise ``doc_id, text`` into flat files in ``folder`` (one per task) and
    return the rows ``path, number, doc_id`` in file order, lazily.

    A retried task writes another file; the rows name the file of the attempt
    that succeeded, so store them before use. A null text is an empty document.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    dtype = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        coder = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        path, out, number = f"{folder}/{uuid.uuid4().hex}.bin", None, 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    system, place = _open(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(place)
                for text in batch.column("text"):
                    ids = coder.encode_ordinary(text.as_py() or "")
                    ids.append(end_id)
                    out.write(np.array(ids, dtype).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(number, number + n)), batch.column("doc_id")],
                                                 ["path", "number", "doc_id"])
                number += n
        finally:
            if out is not None:
                out.close()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"path string, number long, doc_id {kind}")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length`` of the files in a folder; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path", "length")


def _summaries(width: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = _open(row["path"])
                with system.open_input_file(place) as f:
                    ids = np.frombuffer(f.read_at(row["size"] * width, row["start"] * width), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + row["start"]
                inner = np.diff(ends) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]]), pa.array([row["block"]]), pa.array([len(ends)]), pa.array([int(ends[0]) if len(ends) else None], pa.int64()),
                     pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([row["total"]]), pa.array([inner], pa.list_(pa.int64()))],
                    ["path", "block", "n_ends", "first_end", "last_end", "total", "inner"])
    return run


def scan_token_files(files: DataFrame, end_id: int = END_ID, width: int = 2, block_tokens: int = 1 << 22) -> DataFrame:
    """``path, number, n_tokens, closed`` for every document of ``files`` (``path, length``), in order from 0.

    ``n_tokens`` does not count the end id. Tokens after the last end id are a
    document that is not ``closed``; without such tokens there is none. An
    empty file has no documents. Bytes that do not fill a last token are ignored.
    """
    total = F.floor(F.col("length") / width).cast("long")
    blocks = (files.select("path", total.alias("total")).where("total > 0").distinct()
              .select("path", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / block_tokens).cast("long"))).alias("block")))
    blocks = blocks.withColumn("start", F.col("block") * block_tokens)
    blocks = blocks.withColumn("size", F.least(F.lit(block_tokens).cast("long"), F.col("total") - F.col("start"))).repartition("path", "block")
    found = blocks.mapInArrow(_summaries(width, end_id), "path string, block long, n_ends long, first_end long, last_end long, total long, inner array<long>")
    found = Scratch(files.sparkSession, "blocks").table(found, "blocks")
    order = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("path")
    scan = found.select("path", "block", "n_ends", "last_end", "total").select(
        "path", "block", F.coalesce(F.sum("n_ends").over(order), F.lit(0)).alias("before"),
        F.coalesce(F.max("last_end").over(order), F.lit(-1)).alias("from_end"),
        F.coalesce(F.max("last_end").over(file), F.lit(-1)).alias("file_end"), F.sum("n_ends").over(file).alias("file_ends"),
        F.max("block").over(file).alias("file_block"))
    rows = found.join(scan, ["path", "block"])
    lengths = F.when(F.col("n_ends") > 0, F.concat(F.array(F.col("first_end") - F.col("from_end") - 1), "inner")).otherwise(F.array().cast("array<long>"))
    closed = rows.select("path", F.posexplode(lengths).alias("i", "n_tokens"), "before").select(
        "path", (F.col("before") + F.col("i")).alias("number"), "n_tokens", F.lit(True).alias("closed"))
    rest = F.col("total") - F.col("file_end") - 1
    open_ = rows.where((F.col("block") == F.col("file_block")) & (rest > 0)).select("path", F.col("file_ends").alias("number"), rest.alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(open_)


def document_token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, width: int = 2, block_tokens: int = 1 << 22) -> DataFrame:
    """``doc_id, n_tokens``, one row per row of ``docs``, by way of flat files in the shared folder.

    Reads ``doc_id, text``. A null or empty text has 0 tokens. Null and
    repeated ids are kept. Files are deleted after the scan. An empty table gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    folder = scratch.path("flat")
    rows = scratch.table(write_token_files(docs, folder, vocabulary, end_id, width), "rows")
    used = rows.select("path").distinct()
    if used.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    name = F.substring_index("path", "/", -1)
    # only the files of attempts that succeeded
    files = list_files(spark, folder).withColumn("name", name).join(used.select(name.alias("name")), "name", "left_semi").select("path", "length")
    counts = scratch.table(scan_token_files(files, end_id, width, block_tokens).select(name.alias("name"), "number", "n_tokens"), "counts")
    remove(spark, folder)
    return rows.withColumn("name", name).join(counts, ["name", "number"]).select("doc_id", "n_tokens")
