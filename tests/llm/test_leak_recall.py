"""Decontamination with a full block of benchmark items."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from strata.llm import bytescan, decontam


def _words(r, n):
    return ["w%d" % min(int(r.paretovariate(0.6)), 6000) for _ in range(n)]


def _hashes(text):
    return decontam.word_hashes(*bytescan.buffer_of(pa.array([text])))[0].tolist()


def _cosines(texts, items, pairs, window=24, stride=8):
    """Largest cosine of the passages of each (text, item), by full TF-IDF vectors."""
    words, own = [_hashes(t) for t in texts], [_hashes(t) for t in items]
    seen, n = Counter(), 0
    for w in words:
        for i in range(0, len(w), window):
            seen.update(set(w[i:i + window]))
            n += 1

    def vectors(w):
        s, e, _ = decontam.windows(np.array([0, len(w)]), window, stride)
        out = []
        for a, b in zip(s, e, strict=True):
            v = {x: c * (np.log((n + 1) / (seen[x] + 1)) + 1e-3) for x, c in Counter(w[a:b]).items()}
            size = sum(y * y for y in v.values()) ** 0.5
            out.append({x: y / size for x, y in v.items()})
        return out

    right = [vectors(w) for w in own]
    left = {i: vectors(words[i]) for i, _ in pairs}
    return {(i, j): max(sum(y * q.get(x, 0) for x, y in p.items()) for p in left[i] for q in right[j]) for i, j in pairs}


def _plant(r, items, n, edited):
    texts, planted = [], []
    for i in range(n):
        copy = list(items[i % len(items)])
        if i >= n // 3:
            for k in r.sample(range(len(copy) - 5), int(len(copy) * edited)):
                copy[k] = r.choice(_words(r, 1))
        w = _words(r, 150)
        at = r.randint(0, len(w))
        texts.append(" ".join(w[:at] + copy + w[at:]))
        planted.append((i, i % len(items)))
    return texts, planted


def test_full_block_loses_no_copy(spark):
    r = random.Random(5)
    items = [_words(r, r.randint(15, 19) if j % 2 else r.randint(40, 59)) for j in range(200)]
    texts, planted = _plant(r, items, 600, 0.15)
    items = [" ".join(w) for w in items]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    # retrieval alone, the word check off
    got = {(x.doc_id, h.item_id) for x in decontam.find_leaks(docs, bench, strong=0.0).collect() for h in x.hits}
    want = {p for p, c in _cosines(texts, items, planted).items() if c >= 0.501}
    assert len(want) > 400 and not want - got, len(want - got)
    found = {(x.doc_id, h.item_id) for x in decontam.find_leaks(docs, bench).collect() for h in x.hits}
    assert set(planted[:200]) <= found


def test_blocks_hold_no_more_passages_than_the_rank():
    items = [(j, np.arange(1000 * j, 1000 * j + n).astype(np.uint64)) for j, n in enumerate([5, 59, 2100, 24, 30, 41])]
    for rank, block in ((256, 200), (8, 200), (256, 2), (1, 1)):
        blocks = decontam._blocks(items, 24, 8, rank, block)
        assert all(len(b) <= rank and len({i for i, _ in b}) <= block for b in blocks)
        got = [(i, w.tolist()) for b in blocks for i, w in b]
        s = [decontam.windows(np.array([0, len(h)]), 24, 8) for _, h in items]
        assert got == [(i, items[i][1][x:y].tolist()) for i, (a, e, _) in enumerate(s) for x, y in zip(a, e)]
    assert [len(c) for c in decontam._chunks(iter([]), 5, 5, 24, 8)] == [0]


def test_verbatim_copies_of_any_length_are_found(spark):
    r = random.Random(11)
    items, texts, planted = [], [], []
    for m in (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 50):
        for _ in range(60):
            # a short item of common words alone would stand in many texts by itself
            item = ["q%d" % r.randrange(10**6) if m < 5 and k == 0 else x for k, x in enumerate(_words(r, m))]
            w = _words(r, 150)
            at = r.randint(0, len(w))
            planted.append((len(texts), len(items), m))
            items.append(" ".join(item))
            texts.append(" ".join(w[:at] + item + w[at:]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(x.doc_id, h.item_id) for x in decontam.find_leaks(docs, bench).collect() for h in x.hits}
    share = {m: np.mean([(d, i) in found for d, i, k in planted if k == m]) for m in {m for *_, m in planted}}
    print(share)
    assert all(v >= 0.9 for v in share.values()) and all(share[m] == 1 for m in (1, 2, 3, 4)), share


def test_bound_holds_for_repeated_words():
    r = random.Random(3)
    for _ in range(60):
        texts = [[r.randrange(6) for _ in range(r.randrange(0, 40))] for _ in range(4)]
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        i = np.array([x if x < 4 else -1 for t in texts for x in t], np.int64)
        weight = np.array([0.5 + x for t in texts for x in t])
        window = r.choice([3, 8, 24])
        got = decontam._earlier(i, at, window)
        for k, t in enumerate(texts):
            for j, x in enumerate(t):
                want = t[max(0, j - window + 1):j].count(x) if x < 4 else 0
                assert got[at[k] + j] == want
        s, e, text = decontam.windows(at, window, 2)
        for a, b in zip(s, e, strict=True):
            counts = Counter(i[a:b][i[a:b] >= 0].tolist())
            true = sum(c * c * (0.5 + x) for x, c in counts.items())
            own = i[a:b] >= 0
            bound = (weight[a:b] * own).sum() + (2 * weight[a:b] * got[a:b]).sum()
            assert bound >= true - 1e-9
