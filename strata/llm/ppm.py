"""Language-model scoring by prediction by partial matching over byte contexts.

A document is read as its words in lower case, one blank between them and a
line feed at the end. The model is a trie of the contexts of up to ``order``
bytes before each byte of the training documents, with the counts of the bytes
that follow. A byte's probability comes from the longest context that has seen
it. Each context that has not seen it is left by an escape; with T the count
and D the number of different bytes in a context, escape has D / 2T and a byte
seen c times (2c - 1) / 2T. Bytes that a longer context offered are excluded
from T and D of the shorter one (symbol exclusion). As the contexts are
suffixes of each other, the mass to exclude is a constant of each trie node.

Counts are gathered from all training documents: a task sends the distinct
strings of order + 1 bytes with counts, which Spark adds up. Lower orders are
sums of these. The trie is broadcast; if it has more than ``max_entries``
strings it is cut in parts by the two bytes before the symbol, every part is
broadcast by itself, and a document's code length is the sum over the parts.
Nothing is pruned, and the result does not depend on the number of parts.

The unigram base needs the training count of every word. Words with at least
1 / ``heavy`` of all tokens (so at most ``heavy`` words) are broadcast; all
other words of a document go through an equi-join with the table of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import bytescan
from strata.llm.shared import Scratch

_BLANK, _END = 0x20, 0x0A
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: text worked on at a time; the arrays of its contexts take some sixty times as much
SLICE_BYTES = 1 << 20


def token_bytes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, at: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """All documents as words in lower case with blanks between and an end
    mark, each after ``pad`` end marks; and the offsets of the documents, pads included."""
    n = len(at) - 1
    count = np.diff(at)
    text = np.repeat(np.arange(n), count)
    size = e - s + 1
    done = np.concatenate([[0], np.cumsum(size)])
    # an empty document is its end mark
    off = np.concatenate([[0], np.cumsum(done[at[1:]] - done[at[:-1]] + (count == 0) + pad)])
    start = done[:-1] - done[at[:-1]][text] + off[:-1][text] + pad if len(s) else s
    out = np.full(off[-1], _BLANK, np.uint8)
    if len(s):
        src = np.repeat(s - np.cumsum(np.concatenate([[0], (e - s)[:-1]])), e - s) + np.arange((e - s).sum())
        out[src + np.repeat(start - s, e - s)] = bytescan.LOWER[raw[src]]
    for k in range(pad):
        out[off[:-1] + k] = _END
    out[off[1:] - 1] = _END
    return out, off


def context_keys(out: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """For every byte but the pads: it and the ``order`` bytes before it, in one uint64."""
    wide = out.astype(np.uint64)
    key = wide.copy()
    for j in range(1, order + 1):
        key[j:] |= wide[:-j] << np.uint64(8 * j)
    keep = np.ones(len(out), bool)
    for k in range(order):
        keep[off[:-1] + k] = False
    return key[keep]


class Table:
    """Lookup of uint64 keys by open addressing, in numpy."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.slot = np.full(1 << self.bits, -1, np.int32)
        self.keys = keys
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]  # of several claims the last one holds
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if it is absent."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        out = self.slot[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = self.slot[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[out[todo]] != keys[todo])]
        return out


class Trie:
    """Contexts of 0..order bytes, from the strings of the longest order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, low: tuple | None = None):
        """``low`` holds strings of one context byte with counts over all parts of a cut trie."""
        self.order = order
        self.levels = []
        k_keys, k_counts = keys, counts
        for k in range(order, -1, -1):
            if k == min(1, order) and low is not None:
                k_keys, k_counts = low
            mask = np.uint64((1 << (8 * (k + 1))) - 1)
            uniq, inv = np.unique(k_keys & mask, return_inverse=True)
            k_counts = np.bincount(inv, weights=k_counts, minlength=len(uniq)).astype(np.int64)
            k_keys = uniq
            nodes, first = np.unique(uniq >> np.uint64(8), return_index=True)
            total = np.add.reduceat(k_counts, first) if len(first) else np.zeros(0, np.int64)
            distinct = np.diff(np.append(first, len(uniq)))
            self.levels.insert(0, {"keys": k_keys, "counts": k_counts, "nodes": nodes, "first": first,
                                   "total": total, "distinct": distinct})
        for k in range(1, order + 1):
            up, down = self.levels[k - 1], self.levels[k]
            mask = np.uint64((1 << (8 * k)) - 1)
            parent = up["counts"][np.searchsorted(up["keys"], down["keys"] & mask)]
            down["mass"] = np.add.reduceat(parent, down["first"]) if len(down["first"]) else np.zeros(0, np.int64)
        top = self.levels[order]
        where = np.repeat(np.arange(len(top["nodes"])), top["distinct"])
        self.log = np.log10((2 * top["counts"] - 1) / (2 * top["total"][where])) if len(where) else np.zeros(0)
        self.table = Table(top["keys"])

    def log10(self, keys: np.ndarray) -> np.ndarray:
        at = self.table.find(keys)
        out = self.log[at] if len(self.log) else np.zeros(len(keys))
        miss = np.flatnonzero(at < 0)
        if len(miss):
            uniq, inv = np.unique(keys[miss], return_inverse=True)
            out[miss] = self._shorter(uniq)[inv]
        return out

    def _shorter(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        mass, distinct = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        todo = np.ones(len(keys), bool)
        for k in range(self.order, -1, -1):
            lv = self.levels[k]
            ctx = (keys & np.uint64((1 << (8 * (k + 1))) - 1)) >> np.uint64(8)
            node, known = _at(lv["nodes"], ctx)
            entry, seen = _at(lv["keys"], keys & np.uint64((1 << (8 * (k + 1))) - 1))
            total = np.where(known, lv["total"][node] if len(lv["nodes"]) else 0, 0) - mass
            kinds = np.where(known, lv["distinct"][node] if len(lv["nodes"]) else 0, 0) - distinct
            hit = todo & seen
            out[hit] += np.log10((2 * lv["counts"][entry[hit]] - 1) / (2 * total[hit]))
            todo &= ~seen
            leave = todo & known & (total > 0)
            out[leave] += np.log10(kinds[leave] / (2 * total[leave]))
            mass = np.where(known & (k > 0), lv["mass"][node] if k and len(lv["nodes"]) else 0, 0)
            distinct = np.where(known, lv["distinct"][node] if len(lv["nodes"]) else 0, 0)
        out[todo] -= np.log10(np.maximum(1, 256 - distinct[todo]))
        return out


def _plain(x) -> dict:
    return {k: vars(v) if isinstance(v, Table) else v for k, v in vars(x).items()}


def _object(cls, state: dict):
    out = cls.__new__(cls)
    out.__dict__.update(state)
    return out


def _at(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    i = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return i, sorted_keys[i] == keys


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _gather(order: int):
    """Rows ``kind, key, c``: strings (0), words (1) and documents (2) of a task."""
    def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.uint64).view(np.int64)),
                                           pa.array(counts.astype(np.int64))], ["kind", "key", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words, docs = [], [], 0
        for batch in batches:
            for part in bytescan.slices(batch, "text", SLICE_BYTES):
                raw, off = bytescan.buffer_of(part.column("text"))
                s, e, at = bytescan.words(raw, off)
                docs += part.num_rows
                words.append(np.unique(bytescan.span_hashes(bytescan.LOWER[raw], s, e), return_counts=True))
                grams.append(np.unique(context_keys(*token_bytes(raw, s, e, at, order), order), return_counts=True))
                for x in (grams, words):
                    if sum(len(k) for k, _ in x[1:]) > 500_000 + len(x[0][0]) // 2:
                        x[:] = [_merge(x)]
                for kind, x in ((0, grams), (1, words)):  # a task holds a bounded number of keys
                    if x and len(x[0][0]) > 2_000_000:
                        yield rows(kind, *_merge(x))
                        x.clear()
        for kind, x in ((0, grams), (1, words)):
            if x:
                yield rows(kind, *_merge(x))
        if docs:
            yield rows(2, np.zeros(1, np.uint64), np.array([docs]))
    return run


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    got = df.select(*names).toArrow()
    return [got.column(n).to_numpy() for n in names]


def score_documents(docs: DataFrame, order: int = 5, folds: int = 10, held_out: int = 0,
                    max_entries: int = 4_000_000, heavy: int = 1 << 20) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row of ``docs``.

    Reads ``doc_id, text``. Training documents are those whose crc32(doc_id as
    text) mod ``folds`` is not ``held_out``; a null id counts as training. A null
    text is an empty one: one end token. ``base_score`` is the unigram log10
    probability with add-0.1 smoothing, ``score`` the log10 probability of the
    same words under the byte model. Repeated rows each count and are scored
    alike. Without training documents c and N are 0, and the byte model is uniform.
    """
    if not 1 <= order <= 7:
        raise ValueError("order must be 1 to 7, as a context and its byte are held in 64 bits")
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out, F.lit(False))
    texts = docs.select("doc_id", fold.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    gathered = (texts.where("not held_out").select("text").mapInArrow(_gather(order), "kind int, key long, c long")
                .groupBy("kind", "key").agg(F.sum("c").alias("c")))
    counts = scratch.table(gathered, "counts")
    sums = {r.kind: (r.n, r.c) for r in counts.groupBy("kind").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}
    n_grams = sums.get(0, (0, 0))[0]
    n_docs = sums.get(2, (0, 0))[1]
    total = sums.get(1, (0, 0))[1] + n_docs
    distinct = sums.get(1, (0, 0))[0] + (n_docs > 0)
    norm = total + 0.1 * (distinct + 1)
    log_of = lambda c: np.log10((c + 0.1) / norm)
    words = counts.where("kind = 1").select("key", "c")
    limit = max(1, total // heavy)
    heavy_keys, heavy_counts = _columns(words.where(F.col("c") > limit), "key", "c")
    parts = max(1, -(-n_grams // max_entries))
    grams = counts.where("kind = 0").select("key", "c")
    part_of = F.pmod(F.xxhash64(F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFF)), F.lit(parts))
    low = None
    if parts > 1:
        low = _columns(grams.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("c").alias("c")), "key", "c")
        low = (low[0].view(np.uint64), low[1])
    end_log = float(log_of(n_docs))

    def scorer(part: int):
        keys, found = _columns(grams.where(part_of == part) if parts > 1 else grams, "key", "c")
        order_of = np.argsort(keys.view(np.uint64), kind="stable")
        trie = Trie(keys.view(np.uint64)[order_of], found[order_of], order, low)
        known = (Table(heavy_keys.view(np.uint64)), log_of(heavy_counts)) if part == 0 else None
        # the parts of a context are chosen by hash, so a task asks for the part of each pair of bytes it has
        mine = None
        if parts > 1:
            pairs = spark.range(1 << 16).where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
            mine = np.zeros(1 << 16, bool)
            mine[_columns(pairs, "id")[0]] = True
        # arrays alone, so that executors need no class of this package to read them
        shared = spark.sparkContext.broadcast((_plain(trie), known and (_plain(known[0]), known[1]), mine))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie, known, mine = shared.value
            trie = _object(Trie, trie)
            trie.table = _object(Table, trie.table)
            known = known and (_object(Table, known[0]), known[1])
            base_row, n_row = TaskContext.get().partitionId() << 36, 0
            for batch in batches:
                for piece in bytescan.slices(batch, "text", SLICE_BYTES):
                    raw, off = bytescan.buffer_of(piece.column("text"))
                    s, e, at = bytescan.words(raw, off)
                    n = piece.num_rows
                    out, doc_off = token_bytes(raw, s, e, at, order)
                    keys = context_keys(out, doc_off, order)
                    ends = doc_off - order * np.arange(n + 1)
                    logs = np.zeros(len(keys))
                    if mine is None:
                        logs = trie.log10(keys)
                    else:
                        own = mine[((keys >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)]
                        logs[own] = trie.log10(keys[own])
                    score = np.add.reduceat(logs, ends[:-1]) if n else np.zeros(0)
                    base, n_known, tail, tail_off = np.zeros(n), np.zeros(n, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int32)
                    if known is not None:
                        h = bytescan.span_hashes(bytescan.LOWER[raw], s, e)
                        i = known[0].find(h)
                        seen = i >= 0
                        value = np.where(seen, known[1][i] if len(known[1]) else 0.0, 0.0)
                        run_sum, run_n = np.concatenate([[0.0], np.cumsum(value)]), np.concatenate([[0], np.cumsum(seen)])
                        base = run_sum[at[1:]] - run_sum[at[:-1]]
                        n_known = run_n[at[1:]] - run_n[at[:-1]]
                        tail = h[~seen].view(np.int64)
                        tail_off = (at - run_n[at]).astype(np.int32)
                    rid = base_row + n_row + np.arange(n)
                    n_row += n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid), piece.column("doc_id"), piece.column("h"), piece.column("held_out"), pa.array(np.diff(at) + 1),
                         pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score),
                         pa.ListArray.from_arrays(pa.array(tail_off), pa.array(tail))],
                        ["rid", "doc_id", "h", "held_out", "n_tokens", "n_known", "base", "score", "tail"])
        kind = docs.schema["doc_id"].dataType.simpleString()
        return texts.mapInArrow(run, f"rid long, doc_id {kind}, h long, held_out boolean, n_tokens long, n_known long,"
                                     " base double, score double, tail array<long>")

    scored = scratch.table(scorer(0), "scored")
    tail = (scored.select("rid", F.explode("tail").alias("key")).join(words.where(F.col("c") <= limit), "key", "left")
            .select("rid", F.coalesce("c", F.lit(0)).alias("c")))
    sums = tail.groupBy("rid").agg(F.sum(F.log10((F.col("c") + 0.1) / F.lit(float(norm)))).alias("tail_base"),
                                   F.sum((F.col("c") > 0).cast("long")).alias("tail_known"))
    out = scored.select("rid", "doc_id", "h", "held_out", "n_tokens", "n_known", "base", "score").join(sums, "rid", "left")
    # rows of one id and text have one score, by which the parts of a cut trie are added up
    for p in range(1, parts):
        more = scorer(p).groupBy("doc_id", "h").agg(F.max("score").alias("more"))
        more = scratch.table(more.withColumnsRenamed({"doc_id": "_id", "h": "_h"}), "part")
        out = (out.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
               .withColumn("score", F.col("score") + F.col("more")).drop("_id", "_h", "more"))
    return out.select("doc_id", "held_out", "n_tokens",
                      (F.col("n_known") + F.coalesce("tail_known", F.lit(0)) + F.lit(1 if n_docs else 0)).alias("n_known"),
                      F.lit(int(total)).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("tail_base", F.lit(0.0)) + F.lit(end_log)).alias("base_score"), "score")
