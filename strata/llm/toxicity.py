"""Toxicity by noisy-channel deobfuscation and a linear score of the restored text.

Words that look disguised (digits or signs among letters, a letter three times
in a row, a run of single letters) are restored first. Each character is a
column of a lattice with what it may stand for: itself, the letter a leet sign
replaces, nothing for a separator or a repetition. The path with the highest
channel times language-model probability is found by Viterbi decoding; the
language model is a byte trigram model counted over all documents.

The score is logistic in the presence of words and word beginnings of the
restored text. Counts of these in labelled documents pick the candidates;
the weights of all candidates are then fitted together, so that words that
only keep company with telling ones get little weight. Training reads at most
``max_train`` labelled documents (a documented bound, chosen by hash of the
id); their ids are small enough to broadcast. Scoring reads every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import bytescan
from strata.llm.ppm import Table, _merge, context_keys, token_bytes
from strata.llm.shared import Scratch

_U = np.uint64
#: Letters that a digit or sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "&": "a", "#": "h"}
SEPARATORS = ".-_*~'`,:;/\\^"
_LEET = {ord(k): [ord(c) for c in v] for k, v in LEET.items()}
_SEPARATORS = set(SEPARATORS.encode())
#: log10 costs of the channel
_SWAP, _SKIP, _TWICE, _SIGN = -0.3, -0.2, -0.3, -1.5

_LETTER = bytescan.LETTER
_EDGE = bytescan.ALNUM.copy()
_EDGE[[ord("@"), ord("$")]] = True
_HEAD = _EDGE.copy()
_HEAD[[ord("!"), ord("|"), ord("(")]] = True
PREFIXES = (4, 5, 6)


def trigram_model(keys: np.ndarray, counts: np.ndarray) -> tuple[dict[int, float], dict[int, float], float]:
    """log10 P(byte | two before) with add-0.1 smoothing: seen trigrams, unseen by context, unseen contexts."""
    ctx, inv = np.unique(keys >> _U(8), return_inverse=True)
    total = np.bincount(inv, weights=counts) + 25.6 if len(ctx) else np.zeros(0)
    seen = np.log10((counts + 0.1) / total[inv]) if len(ctx) else np.zeros(0)
    return (dict(zip(keys.tolist(), seen.tolist(), strict=True)),
            dict(zip(ctx.tolist(), np.log10(0.1 / total).tolist(), strict=True)), math.log10(1 / 256))


def restore(word: bytes, model: tuple) -> bytes:
    """The most likely plain form of a word in lower case."""
    seen, unseen, none = model

    def step(ctx: int, c: int) -> float:
        p = seen.get(ctx << 8 | c)
        return p if p is not None else unseen.get(ctx, none)

    # state: the last two restored bytes, and the byte whose repetition may be skipped
    paths = {(0x2020, -1): (0.0, None)}
    for c in word:
        options = [(c, 0.0 if _LETTER[c] else _SIGN)]
        options += [(x, _SWAP) for x in _LEET.get(c, ())]
        new: dict = {}
        for (ctx, last), (score, tail) in paths.items():
            for x, cost in options:
                s = score + cost + step(ctx, x)
                k = ((ctx << 8 | x) & 0xFFFF, c)
                if k not in new or new[k][0] < s:
                    new[k] = (s, (x, tail))
            if c in _SEPARATORS or c == last:
                s = score + (_SKIP if c in _SEPARATORS else _TWICE)
                k = (ctx, last)
                if k not in new or new[k][0] < s:
                    new[k] = (s, tail)
        paths = new
    score, tail = max(((s + step(ctx, 0x20), t) for (ctx, _), (s, t) in paths.items()), key=lambda v: v[0])
    out = []
    while tail is not None:
        out.append(tail[0])
        tail = tail[1]
    return bytes(reversed(out))


def restored_words(raw: np.ndarray, off: np.ndarray, model: tuple, cache: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends and text numbers of the words to score, without marks
    around them, in lower case, with disguised words in restored form."""
    low, s, e, text = bytescan.core_words(raw, off, _EDGE, _HEAD)

    def inside(flags):
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[e] - total[s]

    letters = inside(_LETTER[low])
    thrice = np.zeros(len(low), bool)
    if len(low) > 2:
        thrice[2:] = (low[2:] == low[1:-1]) & (low[2:] == low[:-2]) & _LETTER[low[2:]]
    total = np.concatenate([[0], np.cumsum(thrice)])
    runs_in = total[e] - total[np.minimum(s + 2, e)]
    odd = ((letters > 0) & (letters < e - s)) | (runs_in > 0)
    forms, owners = [], []
    data = low.tobytes()
    for i in np.flatnonzero(odd):
        word = data[s[i]:e[i]]
        form = cache.get(word)
        if form is None:
            if len(cache) > 200_000:
                cache.clear()
            form = cache[word] = restore(word, model)
        forms.append(form)
        owners.append(text[i])
    # runs of at least three single letters in one text
    one = (e - s == 1) & (letters == 1)
    first = np.flatnonzero(one & ~np.concatenate([[False], one[:-1] & (text[1:] == text[:-1])])) if len(s) else s
    stop = np.flatnonzero(one & ~np.concatenate([one[1:] & (text[1:] == text[:-1]), [False]])) if len(s) else s
    for i, j in zip(first, stop, strict=True):
        if j - i >= 2:
            forms.append(restore(b"".join(data[s[k]:e[k]] for k in range(i, j + 1)), model))
            owners.append(text[i])
    keep = ~odd
    if forms:
        extra = b" ".join(forms) + b" "
        size = np.array([len(f) for f in forms])
        start = len(low) + np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        low = np.concatenate([low, np.frombuffer(extra, np.uint8)])
        s, e = np.concatenate([s[keep], start]), np.concatenate([e[keep], start + size])
        text = np.concatenate([text[keep], np.array(owners, np.int64)])
    return low, s, e, text


def word_features(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings; a beginning longer than the word is the word's own."""
    out = [bytescan._mix(bytescan.span_hashes(low, s, e) + _U(1))]
    for k in PREFIXES:
        out.append(bytescan._mix(bytescan.span_hashes(low, s, np.minimum(e, s + k)) + _U(10 + k)))
    return out


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for batch in batches:
        for part in bytescan.slices(batch, "text"):
            raw, off = bytescan.buffer_of(part.column("text"))
            out, doc_off = token_bytes(raw, *bytescan.words(raw, off), 2)
            out[out == 0x0A] = 0x20
            held.append(np.unique(context_keys(out, doc_off, 2), return_counts=True))
            if len(held) > 15:
                held = [_merge(held)]
    if held:
        keys, counts = _merge(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "c"])


def _fit(docs: list[list[int]], y: np.ndarray, width: int, ridge: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of features, by gradient steps with momentum and a line-free adaptive rate."""
    size = np.array([len(d) for d in docs], np.int64)
    col = np.concatenate([np.asarray(d, np.int64) for d in docs]) if size.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(docs)), size)
    w, b = np.zeros(width), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, weights=w[col], minlength=len(docs))
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.append(np.bincount(col, weights=r[row], minlength=width) + ridge * w, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3,
                   max_train: int = 20_000, max_features: int = 4_000, min_docs: int = 3, ridge: float = 0.1) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``.

    Reads ``doc_id, text`` and ``labels.doc_id, toxic``. Labels of rows whose
    crc32(doc_id as text) mod ``folds`` is ``held_out`` are not used, nor null
    ones, nor ids with two different ones. A null text scores like an empty
    one: the share of toxic training documents without a telling word. A null
    id is not held out and has no label. Equal rows score alike. Without
    usable labels of both kinds every score is the share of toxic ones, or 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    fold = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == held_out, F.lit(False))
    grams = texts.select("text").mapInArrow(_count_trigrams, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")).toArrow()
    # at most 256^3 trigrams of bytes exist; texts have some thousands
    keys, counts = grams.column("key").to_numpy(), grams.column("c").to_numpy()
    order = np.argsort(keys)
    model = spark.sparkContext.broadcast((keys[order], counts[order]))

    known = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.min("toxic").alias("label"), F.max("toxic").alias("_max")).where("label = _max"))
    train = (known.where(~fold(F.col("doc_id"))).select("doc_id", "label")
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))

    def features(batches):
        lm, cache = trigram_model(model.value[0].view(_U), model.value[1]), {}
        for batch in batches:
            for part in bytescan.slices(batch, "text"):
                low, s, e, text = restored_words(*bytescan.buffer_of(part.column("text")), lm, cache)
                h = np.concatenate(word_features(low, s, e))
                t = np.tile(text, 1 + len(PREFIXES))
                pairs = np.lexsort((h, t))
                t, h = t[pairs], h[pairs]
                new = np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])]) if len(t) else np.zeros(0, bool)
                t, h = t[new], h[new]
                at = np.searchsorted(t, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))],
                                                 ["doc_id", "label", "f"])

    kind, label = docs.schema["doc_id"].dataType.simpleString(), labels.schema["toxic"].dataType.simpleString()
    sample = (texts.join(F.broadcast(train), "doc_id").select("doc_id", "label", "text")
              .mapInArrow(features, f"doc_id {kind}, label {label}, f array<long>"))
    sample = scratch.table(sample, "sample")
    n, n_pos = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = n_pos / n if n else 0.0
    hashes, weights, bias = np.zeros(0, _U), np.zeros(0), math.log((n_pos + 0.5) / (n - n_pos + 0.5)) if n else -20.0
    if 0 < n_pos < n:
        by = (sample.select("label", F.explode("f").alias("h")).groupBy("h")
              .agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")))
        odds = F.log((F.col("pos") + 0.5) / F.lit(n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n - n_pos + 1.0))
        top = (by.where(F.col("pos") >= min_docs).where(odds > 0.7)
               .orderBy((F.col("pos") * odds).desc(), "h").limit(max_features).select("h"))
        hashes = np.sort(top.toArrow().column("h").to_numpy().view(_U))
        chosen = spark.createDataFrame([(int(h), i) for i, h in enumerate(hashes.view(np.int64))], "h long, i long")
        per_doc = (sample.withColumn("row", F.monotonically_increasing_id()).select("row", "label", F.explode_outer("f").alias("h"))
                   .join(F.broadcast(chosen), "h", "left").groupBy("row").agg(F.first("label").alias("label"), F.collect_list("i").alias("i")))
        got = per_doc.toArrow()
        docs_i = got.column("i").to_pylist()
        weights, bias = _fit(docs_i, got.column("label").to_numpy().astype(float), len(hashes), ridge)
    weigh = spark.sparkContext.broadcast((hashes, weights, bias))

    def score(batches):
        lm, cache = trigram_model(model.value[0].view(_U), model.value[1]), {}
        hashes, weights, bias = weigh.value
        table = Table(hashes)
        for batch in batches:
            for part in bytescan.slices(batch, "text"):
                low, s, e, text = restored_words(*bytescan.buffer_of(part.column("text")), lm, cache)
                found, owner = [], []
                for h in word_features(low, s, e):
                    i = table.find(h)
                    hit = np.flatnonzero(i >= 0)
                    found.append(i[hit].astype(np.int64)), owner.append(text[hit])
                pairs = np.unique(np.concatenate(owner) * np.int64(max(1, len(hashes))) + np.concatenate(found))
                z = bias + np.bincount(pairs // max(1, len(hashes)), weights=weights[pairs % max(1, len(hashes))] if len(pairs) else None,
                                       minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    out = texts.mapInArrow(score, f"doc_id {kind}, score double")
    return out.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "score",
                      F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
