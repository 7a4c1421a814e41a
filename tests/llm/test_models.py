"""Held-out accuracy of the classifiers, recall of the retrieval, restored words."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import bytescan, decontam, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def _held_out(scores, labels, column):
    rows = scores.where("held_out").join(labels, "doc_id").select("predicted", column).collect()
    good = [r.predicted for r in rows if r[column] == 1]
    bad = [r.predicted for r in rows if r[column] == 0]
    return sum(good) / len(good), sum(bad) / len(bad)


def test_quality_held_out(docs, labels):
    caught, wrong = _held_out(quality.score_quality(docs, labels), labels, "quality")
    assert caught >= 0.97 and wrong <= 0.15


def test_quality_reads_labels_of_training_rows_only(docs, labels):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: round(r.score, 9) for r in quality.score_quality(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_filter_is_the_prediction(docs, labels):
    kept = {r.doc_id for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}


def test_toxicity_held_out(docs, labels):
    caught, wrong = _held_out(toxicity.score_toxicity(docs, labels), labels, "toxic")
    assert caught >= 0.85 and wrong <= 0.05


def test_disguised_words(spark):
    r = random.Random(5)
    plain = ["the", "river", "stone", "walks", "under", "morning", "light", "garden", "quiet", "idle"]
    rows, marks = [], []
    for i in range(240):
        w = [r.choice(plain) for _ in range(30)]
        toxic = i % 3 == 0
        if toxic:
            w[r.randrange(30)] = r.choice(["moron", "idiot"])
        elif i % 3 == 1:  # the letters of the bad words are known, not the words
            w[r.randrange(30)] = r.choice(["mormon", "idiom", "riot"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(toxic)))
    hidden = ["m0r0n", "M O R O N", "m.o.r.o.n", "mooorrron", "1d10t", "i d i o t", "!diot", "idi0t!!"]
    rows += [(1000 + i, f"the river walks {w} under the stone") for i, w in enumerate(hidden)]
    rows += [(2000 + i, f"the river walks {w} under the stone 12 345 a b") for i, w in enumerate(["morning", "idle", "2024", "mp3"])]
    out = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = {x.doc_id: x.predicted for x in out.collect()}
    assert [got[1000 + i] for i in range(len(hidden))] == [1] * len(hidden)
    assert [got[2000 + i] for i in range(4)] == [0] * 4


def _cosine_pairs(texts, items, window, stride, threshold):
    """All (text, item) pairs with a pair of passages at the threshold, by full TF-IDF vectors."""
    words = [decontam.word_hashes(*bytescan.buffer_of(pa.array([t])))[0].tolist() for t in texts]
    own = [decontam.word_hashes(*bytescan.buffer_of(pa.array([t])))[0].tolist() for t in items]
    passages = [set(w[i:i + window]) for w in words for i in range(0, len(w), window)]
    idf = {}

    def weight(x):
        if x not in idf:
            idf[x] = np.log((len(passages) + 1) / (sum(x in p for p in passages) + 1)) + 1e-3
        return idf[x]

    def vectors(w):
        s, e, _ = decontam.windows(np.array([0, len(w)]), window, stride)
        out = []
        for a, b in zip(s, e, strict=True):
            v = {}
            for x in w[a:b]:
                v[x] = v.get(x, 0) + weight(x)
            size = sum(y * y for y in v.values()) ** 0.5
            out.append({x: y / size for x, y in v.items()})
        return out

    left, right = [vectors(w) for w in words], [vectors(w) for w in own]
    return {(i, j) for i, a in enumerate(left) for j, b in enumerate(right)
            if any(sum(y * q.get(x, 0) for x, y in p.items()) >= threshold for p in a for q in b)}


def test_leaks_and_paraphrases(spark):
    r = random.Random(11)
    vocab = ["w%d" % i for i in range(900)]
    make = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [make(r.randint(15, 50)) for _ in range(30)]
    texts, planted = [], set()
    for i in range(120):
        w = make(r.randint(5, 300))
        if i % 2 == 0:
            j = r.randrange(30)
            copy = list(items[j])
            if i % 4 == 0:  # a paraphrase: some words replaced, the answer kept
                for k in r.sample(range(len(copy) - 5), len(copy) // 5):
                    copy[k] = r.choice(vocab)
            at = r.randint(0, len(w))
            w[at:at] = copy
            planted.add((i, j))
        texts.append(" ".join(w).title() if i % 3 == 0 else " ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    for settings in ({}, {"block": 7, "blocks_at_once": 2}):
        got = {(x.doc_id, h.item_id) for x in decontam.find_leaks(docs, bench, **settings).collect() for h in x.hits}
        assert got == planted
    # retrieval alone, with the word check off, against full TF-IDF vectors
    near = {(x.doc_id, h.item_id) for x in decontam.find_leaks(docs, bench, strong=0.0).collect() for h in x.hits}
    want = _cosine_pairs(texts, [" ".join(w) for w in items], 24, 8, 0.5)
    assert len(near & want) >= 0.9 * len(want)


def test_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randint(0, 20))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
        assert decontam.common_subsequence(a, b) == best[-1][-1]
