"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of ``window`` words, every ``stride`` words, of benchmark
items and documents, as TF-IDF vectors; document frequencies are counted over
all passages of all documents. A randomised SVD of the benchmark passages
gives a latent space: the rows stay distributed, every task adds up its part
of A'(A X) for a thin X, and only sums of the size words x rank are gathered
(twice: range finder, then Rayleigh-Ritz). The cosine of a document passage
and a benchmark passage is taken in that space, with the passage's full TF-IDF
length, so words outside the benchmark count against it. For the same reason
the share of a passage's squared length on benchmark words bounds the squared
cosine from above; passages below the squared threshold are not projected. (A
word that occurs twice counts four times in a squared length; pairs of equal
words within a window's reach are added, so the bound holds for them, too.)

An item's passage of m words lies in a window of ``window`` words, so its cosine
with a verbatim copy is about sqrt(m / window). The threshold of passages under
``full`` words sinks by the same law. Items of at most ``exact`` words are also
looked up as they are, as sequences of words; those of fewer than ``min_words``
in no other way.

Candidates are decided on the words: the longest common subsequence of item
and surrounding text must cover ``strong`` of the item, or ``weak`` of it if
the item's answer (its last words) is found there too (a paraphrase).

The benchmark is a query set: it is taken in blocks of at most ``block`` items
and ``rank`` passages with a model each, so a block's space has a dimension for
every passage and no direction of a short item falls out of it. A pass over the
documents takes at most ``blocks_at_once * block`` items and ``blocks_at_once *
rank`` passages (one item with more is a pass of its own), so what is broadcast
has a fixed bound. Every document is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import bytescan
from strata.llm.ppm import Table, _object, _plain
from strata.llm.shared import Scratch

_U = np.uint64
BUCKET_BITS = 18


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in lower case without marks around them, and the offsets of the texts."""
    low, s, e, text = bytescan.core_words(raw, off)
    return bytescan.span_hashes(low, s, e), np.searchsorted(text, np.arange(len(off)))


def windows(at: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all windows; a text without words has none."""
    n = np.diff(at)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - window) // stride)), 0)
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    s = at[:-1][text] + nth * stride
    return s, np.minimum(s + window, at[1:][text]), text


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - BUCKET_BITS)).astype(np.int64)


def _passage_frequencies(window: int):
    """Rows ``bucket, n``: in how many passages (window after window) words of a bucket occur; bucket -1: passages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for batch in batches:
            for part in bytescan.slices(batch, "text"):
                h, at = word_hashes(*bytescan.buffer_of(part.column("text")))
                n = np.diff(at)
                bucket = _bucket(h)
                place = ((np.arange(len(h)) - np.repeat(at[:-1], n)) % window).astype(np.int32)
                first = np.ones(len(h), bool)  # of its bucket in its passage
                for back in range(1, min(window, len(h))):
                    first[back:] &= (bucket[back:] != bucket[:-back]) | (place[back:] < back)
                total += np.bincount(bucket[first], minlength=1 << BUCKET_BITS)
                passages += int((-(-n // window)).sum())
        hit = np.flatnonzero(total)
        if passages:
            yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(total[hit], passages))], ["bucket", "n"])
    return run


def _gram_product(vocab: dict, idf: np.ndarray, x: dict):
    """Per block A'(A x) of a task's passages (``block, words``), as rows ``block, cells`` in float64 bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            for block, words in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist(), strict=True):
                h = np.array(words, np.int64).view(_U)
                i = np.searchsorted(vocab[block], h)
                w = idf[_bucket(h)]
                y = w @ x[block][i]
                z = total.setdefault(block, np.zeros(x[block].shape))
                np.add.at(z, i, w[:, None] * y)
        for block, z in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([z.tobytes()])], ["block", "cells"])
    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict = {}
    for batch in batches:
        for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
            z = np.frombuffer(cells)
            total[block] = total[block] + z if block in total else z
    for block, z in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([z.tobytes()])], ["block", "cells"])


def randomised_svd(passages: DataFrame, vocab: dict, idf: np.ndarray, rank: int, seed: int = 7) -> dict:
    """Per block the leading right singular vectors (words x rank) of the TF-IDF passages."""
    def product(x):
        rows = (passages.mapInArrow(_gram_product(vocab, idf, x), "block long, cells binary")
                .repartition("block").mapInArrow(_add_up, "block long, cells binary")).toArrow()
        got = dict(zip(rows.column("block").to_pylist(), rows.column("cells").to_pylist(), strict=True))
        return {b: np.frombuffer(got[b]).reshape(v.shape) if b in got else np.zeros(v.shape) for b, v in x.items()}

    rng = np.random.default_rng(seed)
    x = {b: rng.standard_normal((len(v), min(rank, len(v)))) for b, v in vocab.items()}
    q = {b: np.linalg.qr(z)[0] for b, z in product(x).items()}
    out = {}
    for b, z in product(q).items():
        value, vector = np.linalg.eigh(q[b].T @ z)
        keep = value > 1e-9 * max(1e-12, value.max())
        out[b] = (q[b] @ vector[:, keep]).astype(np.float32)
    return out


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for x in b:
        m = where.get(x)
        if m:
            u = v & m
            v = (v + u) | (v - u)
            v &= full
    return len(a) - v.bit_count()


def _decide(h: np.ndarray, lo: int, hi: int, first: int, last: int, words: list[int], answer: int, strong: float, weak: float):
    """LCS share and answer of an item against the words around [first, last) of a text [lo, hi); None if it is no hit."""
    n = len(words)
    near = h[max(lo, first - n):min(hi, last + n)].tolist()
    share = common_subsequence(words, near) / n
    tail = words[-min(answer, n):]
    found = common_subsequence(tail, near) >= 0.8 * len(tail)
    return (share, found) if share >= strong or (share >= weak and found) else None


def _earlier(i: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """For each word with a number (``i`` >= 0) how many of the ``window`` - 1 words before it in its text are the same."""
    out = np.zeros(len(i), np.int16)
    place = (np.arange(len(i)) - np.repeat(at[:-1], np.diff(at))).astype(np.int32)
    for back in range(1, min(window, len(i))):
        out[back:] += (i[back:] == i[:-back]) & (place[back:] >= back)
    out[i < 0] = 0
    return out


def _sequences(h: np.ndarray, at: np.ndarray, short: dict) -> Iterator[tuple[int, dict]]:
    """Text and hit of every short item (hashes by number of words) that stands in a text word for word; the first place of each."""
    for n, (keys, ids) in short.items():
        if len(h) < n or not len(keys):
            continue
        runs = bytescan.runs(h, n)
        found = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
        place = np.flatnonzero(keys[found] == runs)
        text = np.searchsorted(at, place, "right") - 1
        inside = place + n <= at[text + 1]
        place, text, item = place[inside], text[inside], found[place[inside]]
        for k in np.unique(text * len(keys) + item, return_index=True)[1]:
            first = int(place[k] - at[text[k]])
            yield int(text[k]), {"item_id": int(ids[item[k]]), "cosine": 1.0, "lcs": 1.0, "answer": True, "first_word": first, "last_word": first + n}


def _search(shared, window: int, stride: int, answer: int, strong: float, weak: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, table, blocks, item_ids, item_words, short = shared.value
        table = _object(Table, table)
        square = idf * idf
        for batch in batches:
            for part in bytescan.slices(batch, "text"):
                h, at = word_hashes(*bytescan.buffer_of(part.column("text")))
                s, e, text = windows(at, window, stride)
                weight = square[_bucket(h)]
                every = np.concatenate([[0.0], np.cumsum(weight)])
                hits: list[dict] = [{} for _ in range(part.num_rows)]
                known = table.find(h)
                pairs = 2 * weight * _earlier(known, at, window)
                for row, dots, owner, limit in blocks:
                    i = row[known]
                    own = np.concatenate([[0.0], np.cumsum(np.where(i >= 0, weight, 0.0))])
                    mine = own[e] - own[s]
                    rest = np.maximum(every[e] - every[s] - mine, 0.0)
                    twice = np.concatenate([[0.0], np.cumsum(np.where(i >= 0, pairs, 0.0))])
                    mine += twice[e] - twice[s]
                    low = limit.min() if len(limit) else 1.0
                    cand = np.flatnonzero(mine >= low * low * np.maximum(mine + rest, 1e-12))
                    for k in range(0, len(cand), 512):
                        c = cand[k:k + 512]
                        at_word = s[c][:, None] + np.arange(window)
                        there = at_word < e[c][:, None]
                        at_word = np.minimum(at_word, len(h) - 1)
                        code = np.where(there, i[at_word], -1)
                        hw = h[at_word]
                        same = (hw[:, :, None] == hw[:, None, :]) & there[:, None, :]
                        length = np.sqrt((np.where(there, weight[at_word], 0.0) * same.sum(axis=2)).sum(axis=1))
                        cosine = dots[code].sum(axis=1) / np.maximum(length, 1e-9)[:, None]
                        for w, p in zip(*np.nonzero(cosine >= limit[None, :]), strict=True):
                            d, item = int(text[c[w]]), int(owner[p])
                            hits[d].setdefault(item, []).append((int(s[c[w]]), int(e[c[w]]), float(cosine[w, p])))
                rows = []
                for d, by_item in enumerate(hits):
                    found = []
                    for item, where in sorted(by_item.items()):
                        best = None
                        where.sort()
                        n = len(item_words[item])
                        spans = []
                        for a, b, cos in where:  # windows near each other are one place
                            if spans and a <= spans[-1][1] + n:
                                spans[-1] = (spans[-1][0], max(b, spans[-1][1]), max(cos, spans[-1][2]))
                            else:
                                spans.append((a, b, cos))
                        for a, b, cos in spans:
                            got = _decide(h, at[d], at[d + 1], a, b, item_words[item], answer, strong, weak)
                            if got and (best is None or got[0] > best["lcs"]):
                                best = {"item_id": item_ids[item], "cosine": min(1.0, cos), "lcs": got[0], "answer": got[1],
                                        "first_word": a - int(at[d]), "last_word": b - int(at[d])}
                        if best:
                            found.append(best)
                    rows.append(found)
                for d, found in _sequences(h, at, short):
                    if all(x["item_id"] != found["item_id"] for x in rows[d]):
                        rows[d].append(found)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(rows, HITS)], [*names, "hits"])
    return run


HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.bool_()),
                           ("first_word", pa.int64()), ("last_word", pa.int64())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 24, stride: int = 8, rank: int = 256, threshold: float = 0.5,
               strong: float = 0.7, weak: float = 0.5, answer: int = 5, min_words: int = 5, block: int = 200, blocks_at_once: int = 8,
               full: int = 18, exact: int = 12) -> DataFrame:
    """``docs`` with ``hits``: the benchmark items found in each text.

    A hit has item_id, cosine (largest of the passages there), lcs (share of
    the item's words in common order), answer (its last words are there) and
    the word range of the passages. Reads ``text`` and benchmark's ``item_id,
    text``; all columns of ``docs`` are kept, one named ``hits`` is replaced. A
    null or empty text has no hits. Items of at most ``exact`` words are also
    found where they stand word for word (cosine and lcs 1), items of fewer than
    ``min_words`` words only so. Items that are null
    or without words or id are not searched for; of rows with equal id and text
    one is used. Repeated documents get equal hits.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "hits"]
    frequency = (docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_passage_frequencies(window), "bucket long, n long")
                 .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    bucket, n = frequency.column("bucket").to_numpy(), frequency.column("n").to_numpy()
    seen = np.zeros(1 << BUCKET_BITS)
    seen[bucket[bucket >= 0]] = n[bucket >= 0]
    idf = np.log((n[bucket < 0].sum() + 1.0) / (seen + 1.0)) + 1e-3
    items = (benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
             .orderBy("item_id", "text"))
    out, base = None, docs.select(*names)
    # a pass over the documents for every chunk of the benchmark; the first one always runs
    for number, chunk in enumerate(_chunks(items.toLocalIterator(), block * blocks_at_once, rank * blocks_at_once, window, stride)):
        shared = spark.sparkContext.broadcast(_index(spark, chunk, idf, window, stride, rank, block, threshold, full, min_words, exact))
        found = base.mapInArrow(_search(shared, window, stride, answer, strong, weak, names),
                                _fields(base) + ", hits array<struct<item_id:long,cosine:double,lcs:double,answer:boolean,first_word:long,last_word:long>>")
        if number == 0:
            out = found
        else:  # rows of one text have the same hits
            more = (found.where("size(hits) > 0").select(F.xxhash64("text").alias("__leak_hash"), F.length("text").alias("__leak_size"), F.col("hits").alias("__leak_more"))
                    .dropDuplicates(["__leak_hash", "__leak_size"]))
            more = Scratch(spark, "leaks").table(more, "more")
            out = (out.join(more, (F.xxhash64("text") == F.col("__leak_hash")) & (F.length("text") == F.col("__leak_size")), "left")
                   .withColumn("hits", F.concat("hits", F.coalesce("__leak_more", F.array().cast(out.schema["hits"].dataType)))).drop("__leak_hash", "__leak_size", "__leak_more"))
    return out


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _chunks(rows: Iterator, size: int, most: int, window: int, stride: int) -> Iterator[list]:
    """Lists of (item_id, words as hashes) of usable items, at most ``size`` items
    and ``most`` passages (or one item); one empty list if there are none."""
    held, n, any_ = [], 0, False
    for row in rows:
        h, _ = word_hashes(*bytescan.buffer_of(pa.array([row.text])))
        if not len(h):
            continue
        more = len(windows(np.array([0, len(h)]), window, stride)[0])
        if held and (len(held) == size or n + more > most):
            any_ = True
            yield held
            held, n = [], 0
        held.append((row.item_id, h))
        n += more
    if held or not any_:
        yield held


def _blocks(items: list, window: int, stride: int, rank: int, block: int) -> list[list]:
    """The passages (number of the item, words) in blocks of at most ``rank`` passages of ``block`` items."""
    out: list = []
    owners: set = set()
    for number, (_, h) in enumerate(items):
        s, e, _ = windows(np.array([0, len(h)]), window, stride)
        for x, y in zip(s, e, strict=True):
            if not out or len(out[-1]) == rank or len(owners | {number}) > block:
                out.append([])
                owners = set()
            out[-1].append((number, h[x:y]))
            owners.add(number)
    return out


def _index(spark, items: list, idf: np.ndarray, window: int, stride: int, rank: int, block: int, threshold: float, full: int, min_words: int, exact: int) -> tuple:
    """Document frequencies, the table of all words, and per block: the row of a
    known word (-1: none), its share of the dot product with each passage of
    length 1 (the last row, for -1, is zero), the passages' items and the cosine
    from which each is a candidate. Then the items' ids and words, and the short
    ones as sorted hashes by their number of words."""
    short = {}
    for n in range(1, max(exact + 1, min_words)):
        those = sorted((int(bytescan.runs(h, n)[0]), i) for i, h in items if len(h) == n)
        short[n] = (np.array([k for k, _ in those], _U), np.array([i for _, i in those], np.int64))
    items = [(i, h) for i, h in items if len(h) >= min_words]
    passages = dict(enumerate(_blocks(items, window, stride, rank, block)))
    vocab = {b: np.unique(np.concatenate([w for _, w in v])) for b, v in passages.items()}
    words = np.unique(np.concatenate([*vocab.values(), np.empty(0, _U)]))
    blocks = []
    if vocab:
        rows = pa.table({"block": pa.array([b for b, v in passages.items() for _ in v], pa.int64()),
                         "words": pa.array([w.view(np.int64) for v in passages.values() for _, w in v], pa.list_(pa.int64()))})
        vectors = randomised_svd(spark.createDataFrame(rows), vocab, idf, rank)
        for b, v in vocab.items():
            weighted = vectors[b] * idf[_bucket(v)][:, None].astype(np.float32)
            latent = np.stack([weighted[np.searchsorted(v, w)].sum(axis=0) for _, w in passages[b]])
            size = np.sqrt((latent * latent).sum(axis=1, keepdims=True))
            dots = weighted @ (latent / np.maximum(size, 1e-9)).T
            row = np.full(len(words) + 1, -1, np.int32)
            row[np.searchsorted(words, v)] = np.arange(len(v))
            blocks.append((row, np.concatenate([dots, np.zeros((1, dots.shape[1]), np.float32)]), np.array([i for i, _ in passages[b]]),
                           np.array([threshold * min(1.0, (len(w) / full) ** 0.5) for _, w in passages[b]])))
    return idf, _plain(Table(words)), blocks, [i for i, _ in items], [h.tolist() for _, h in items], short
