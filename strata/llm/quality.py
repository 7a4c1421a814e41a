"""Quality classifier by positive-unlabelled learning.

Trusted positives are the training documents labelled 1; the unlabelled set is
every document. With class prior p, logistic loss l and score z the unbiased
risk is  p E_pos[l(z)] + (E_all[l(-z)] - p E_pos[l(-z)]);  its second part
estimates the risk on the unseen negatives and must not go below zero, where
it would only fit noise. The logistic loss makes the unbiased risk convex with
gradient  E_all[s(z) x] - p E_pos[x],  so a few Newton steps minimise it. The fit
goes along a path of weaker and weaker ridge penalties and keeps the last
minimum whose second part is not negative by more than twice its standard error
(non-negative risk). The prior is the
share of positives among the labelled training rows.

Each Newton step is one aggregate over the feature table of all documents: a
task sends one partial sum per matrix cell, which Spark adds up by cell. No
rows are sampled.

Features are counts of character and word classes of the whole text, taken
with array operations on the Arrow buffers; no label, language, source or id
is among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import bytescan
from strata.llm.shared import Scratch


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _class("abcdefghijklmnopqrstuvwxyz")
_LETTER[0x80:] = True
_DIGIT = _class("0123456789")
_STOP = _class(".?!")
_MARKS = _class(".,;:?'\"()-")
_SIGNS = ~(_LETTER | _DIGIT | _MARKS | bytescan.SPACE)
_LINE = _class("\n")

#: ratios, in this order, each given as itself and as its square root
RATIOS = ("upper", "digit", "marks", "signs", "bang", "bar", "line ends", "words with capital", "words with sign",
          "words all capital", "words that end a sentence", "words that repeat the one before", "words seen before", "short words", "long words")


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[off[1:]] - total[off[:-1]]).astype(np.float64)


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of features per text; all zero but the constant for an empty text."""
    n = len(off) - 1
    s, e, at = bytescan.words(raw, off)
    low = bytescan.span_hashes(bytescan.LOWER[raw] if len(raw) else raw, s, e)
    size = np.maximum(1.0, _per_text(~bytescan.SPACE[raw], off))
    count = np.diff(at).astype(np.float64)
    words = np.maximum(1.0, count)
    text = np.repeat(np.arange(n), np.diff(at))
    upper, sign = _UPPER[raw], _SIGNS[raw]

    def inside(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[e] - total[s]

    again = np.zeros(len(s), bool)
    if len(s) > 1:
        again[1:] = (low[1:] == low[:-1]) & (text[1:] == text[:-1])
    order = np.lexsort((low, text))
    seen = np.zeros(len(s), bool)
    if len(s) > 1:
        seen[order[1:]] = (low[order[1:]] == low[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    letters = inside(_LETTER[raw])
    caps = inside(upper)
    last = raw[e - 1] if len(s) else raw[:0]
    head = raw[s] if len(s) else raw[:0]
    ratio = [_per_text(upper, off) / size, _per_text(_DIGIT[raw], off) / size, _per_text(_MARKS[raw], off) / size,
             _per_text(sign, off) / size, _per_text(raw == ord("!"), off) / size, _per_text(raw == ord("|"), off) / size,
             _per_text(_LINE[raw], off) / words, _per_text(_UPPER[head], at) / words, _per_text(inside(sign) > 0, at) / words,
             _per_text((caps > 1) & (caps * 2 > letters), at) / words, _per_text(_STOP[last], at) / words,
             _per_text(again, at) / words, _per_text(seen, at) / words, _per_text(e - s <= 3, at) / words,
             _per_text(e - s >= 12, at) / words]
    x = np.minimum(np.column_stack(ratio), 2.0) if n else np.zeros((0, len(RATIOS)))
    lengths = np.column_stack([np.log1p(count), size / words]) if n else np.zeros((0, 2))
    lengths[:, 1] = np.minimum(lengths[:, 1], 50)
    return np.column_stack([np.ones(n), x, np.sqrt(x), lengths])


WIDTH = 1 + 2 * len(RATIOS) + 2


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bytescan.slices(batch, "text"):
            raw, off = bytescan.buffer_of(part.column("text"))
            f = features(raw, off).astype(np.float32)
            rows = pa.ListArray.from_arrays(np.arange(0, f.size + 1, WIDTH, dtype=np.int32), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows], ["doc_id", "f"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column("f")
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, WIDTH)


def _cells(table: DataFrame, fn) -> dict[int, float]:
    """Sums over all rows of the vectors that ``fn(batch)`` gives per batch."""
    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                v = fn(b)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])
    return {r.i: r.v for r in table.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}


def _vector(cells: dict[int, float], n: int) -> np.ndarray:
    return np.array([cells.get(i, 0.0) for i in range(n)])


RIDGES = (0.3, 0.1, 0.03, 0.01, 0.003, 0.001, 0.0003, 0.0001)


def fit(table: DataFrame, prior: float | None = None, ridges: tuple = RIDGES, steps: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and scales from a table of ``f, label`` (label null: unlabelled).
    Without a positive row all weights are 0 (every score is one half).

    All ridges take their Newton steps in the same passes over the table, and the
    last search is one pass, so a fit is at most ``steps`` + 2 jobs.
    """
    def moments(b):
        x = _matrix(b)
        y = b.column("label").to_pandas().to_numpy(dtype=float, na_value=np.nan)
        return np.concatenate([[len(x), (y == 1).sum(), np.isfinite(y).sum()], x.sum(0), (x * x).sum(0)])

    m = _vector(_cells(table, moments), 3 + 2 * WIDTH)
    n, n_pos, n_known = m[:3]
    if not n_pos:
        return np.zeros(WIDTH), np.zeros(WIDTH), np.ones(WIDTH)
    prior = n_pos / n_known if prior is None else prior
    prior = min(max(prior, 0.01), 0.99)
    mean = m[3:3 + WIDTH] / n
    scale = np.sqrt(np.maximum(m[3 + WIDTH:] / n - mean ** 2, 1e-12))
    scale[scale < 1e-5] = 1.0
    mean[0], scale[0] = 0.0, 1.0

    def losses(ws, curved: bool):
        """Per weight vector the risk on negatives, its sampling error, and (``curved``) gradient and Hessian; one pass."""
        size = 4 + (WIDTH + WIDTH ** 2 if curved else 0)

        def cells(b):
            x = (_matrix(b) - mean) / scale
            pos = b.column("label").to_pandas().to_numpy(dtype=float, na_value=np.nan) == 1
            sums = []
            for w in ws:
                z = np.clip(x @ w, -30, 30)
                loss = np.logaddexp(0, z)
                sums.append([loss.sum(), (loss ** 2).sum(), loss[pos].sum(), (loss[pos] ** 2).sum()])
                if curved:
                    s = 1 / (1 + np.exp(-z))
                    sums += [x.T @ s / n - prior * x[pos].sum(0) / n_pos, ((x * (s * (1 - s))[:, None]).T @ x / n).ravel()]
            return np.concatenate(sums)

        out = []
        for v in _vector(_cells(table, cells), size * len(ws)).reshape(len(ws), size):
            all_, pos = v[0] / n, v[2] / n_pos
            error = np.sqrt(max(0.0, v[1] / n - all_ ** 2) / n + prior ** 2 * max(0.0, v[3] / n_pos - pos ** 2) / n_pos
                            + prior * (1 - prior) / max(1.0, n_known) * pos ** 2)
            out.append((all_ - prior * pos, error, v[4:4 + WIDTH], v[4 + WIDTH:].reshape(-1, WIDTH) if curved else None))
        return out

    eye = np.eye(WIDTH)
    eye[0, 0] = 1e-3  # the constant is hardly held back
    ws, valid, going = [np.zeros(WIDTH) for _ in ridges], [True] * len(ridges), list(range(len(ridges)))
    for _ in range(steps):
        for i, (negatives, error, grad, hess) in zip(going, losses([ws[i] for i in going], True), strict=True):
            valid[i] = negatives >= -2 * error
            step = np.linalg.solve(hess + ridges[i] * eye, grad + ridges[i] * eye @ ws[i])
            ws[i] = ws[i] - step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 0.02:
                going = [j for j in going if j != i]
        if not going:
            break
    # from a stiff model to a free one, as far as there is a minimum: a ridge too weak to give one in so many steps ends the path
    settled = next((i for i in range(len(ridges)) if i in going), len(ridges))
    # below zero by more than its sampling error, only noise is fitted from there on
    first = next((i for i in range(settled) if not valid[i]), settled)
    good = ws[first - 1] if first else np.zeros(WIDTH)
    if first < settled:  # as far towards that one as the risk allows
        between = [good + (ws[first] - good) * k / 16 for k in range(17)]
        kept = [negatives >= -2 * error for negatives, error, _, _ in losses(between, False)]
        low, high = 0, 16
        while high - low > 1:
            low, high = ((low + high) // 2, high) if kept[(low + high) // 2] else (low, (low + high) // 2)
        good = between[low]
    return good, mean, scale


def _training(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Feature tables in the shared folder: all documents, and ``f, label`` for the fit."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = docs.select("doc_id", "text").mapInArrow(_featurise, f"doc_id {kind}, f array<float>")
    table = scratch.table(table.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_out, F.lit(False))), "features")
    known = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
             .agg(F.min("quality").alias("label"), F.max("quality").alias("_max")).where("label = _max").select("doc_id", "label"))
    rows = table.join(known, "doc_id", "left").select("f", F.when(~F.col("held_out"), F.col("label")).cast("int").alias("label"))
    return table, scratch.table(rows, "rows")


def _score(x: np.ndarray, model: tuple) -> np.ndarray:
    w, mean, scale = model
    # summed row by row: a matrix product may round equal rows differently
    return 1 / (1 + np.exp(-np.clip((((x - mean) / scale) * w).sum(axis=1), -30, 30)))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3,
                  prior: float | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per row of ``docs``.

    Reads ``doc_id, text`` and ``labels.doc_id, quality``. Labels of rows whose
    crc32(doc_id as text) mod ``folds`` is ``held_out`` are not used; nor are null
    labels and ids with two different ones. A null text scores like an empty
    one. A null id is not held out and has no label. Repeated rows are scored
    alike. Without any usable positive label every score is 0.5.
    """
    table, rows = _training(docs, labels, folds, held_out, Scratch(docs.sparkSession, "quality"))
    model = fit(rows, prior)

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(_score(_matrix(b), model))], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = table.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3,
              prior: float | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`score_quality`
    predicts to be good; scored where they are read, so that no text is shuffled."""
    scratch = Scratch(docs.sparkSession, "quality")
    table, rows = _training(docs, labels, folds, held_out, scratch)
    model = fit(rows, prior)
    for t in (table, rows):
        scratch.drop(t)

    def good(batches):
        for batch in batches:
            for part in bytescan.slices(batch, "text"):
                x = features(*bytescan.buffer_of(part.column("text"))).astype(np.float32).astype(np.float64)
                yield part.filter(pa.array(_score(x, model) >= threshold))

    return docs.mapInArrow(good, docs.schema)
