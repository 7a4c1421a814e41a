"""Byte-context scoring against a dictionary implementation with explicit exclusion sets."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from strata.llm.ppm import score_documents

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ORDER = 3


def stream(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return WORD.findall(low)


def brute(rows, order=ORDER, folds=10):
    held = {d: d is not None and zlib.crc32(str(d).encode()) % folds == 0 for d, _ in rows}
    trie, words, n_docs = defaultdict(Counter), Counter(), 0
    for d, t in rows:
        if not held[d]:
            w = stream(t)
            words.update(w)
            n_docs += 1
            b = b"\n" * order + b" ".join(w) + b"\n"
            for i in range(order, len(b)):
                for k in range(order + 1):
                    trie[b[i - k:i]][b[i]] += 1
    n, v = sum(words.values()) + n_docs, len(words) + (n_docs > 0)
    out = []
    for d, t in rows:
        w = stream(t)
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(words[x] for x in w), n_docs])
        b, score = b"\n" * order + b" ".join(w) + b"\n", 0.0
        for i in range(order, len(b)):
            gone = set()
            for k in range(order, -1, -1):
                seen = {s: c for s, c in trie.get(b[i - k:i], {}).items() if s not in gone}
                total = sum(seen.values())
                if b[i] in seen:
                    score += math.log10((2 * seen[b[i]] - 1) / (2 * total))
                    break
                if total:
                    score += math.log10(len(seen) / (2 * total))
                gone |= set(trie.get(b[i - k:i], {}))
            else:
                score -= math.log10(max(1, 256 - len(gone)))
        out.append((d, held[d], len(w) + 1, sum(x in words for x in w) + (n_docs > 0), n, base, score))
    return sorted(out, key=repr)


ROWS = [(i, t) for i, t in enumerate(
    ["the cat sat on the mat", "The cat ate", "a\tb\n\nc  the", "", None, "été ñ the über", "zzz qqq   x", "the the the the",
     "mat cat the sat", "the cat sat on the mat", "x" * 3000 + " end", "new wörds hére", "q!w@e#", " lead and trail "] * 3)]


@pytest.mark.parametrize("settings", [{}, {"max_entries": 60}, {"heavy": 4}])
def test_against_brute_force(spark, settings):
    rows = [*ROWS, (None, "the cat"), (7, "the the the the")]
    df = spark.createDataFrame([(d, t, "x", 1.0) for d, t in rows], "doc_id long, text string, score string, rid double")
    got = sorted((tuple(r) for r in score_documents(df, order=ORDER, **settings).collect()), key=lambda r: repr((*r[:5],)))
    want = sorted(brute(rows), key=lambda r: repr((*r[:5],)))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(want, key=lambda r: (str(r[0]), r[2])), strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_empty_table(spark):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_probabilities_sum_to_one():
    import numpy as np

    from strata.llm import bytescan, ppm
    import pyarrow as pa
    raw, off = bytescan.buffer_of(pa.array([t or "" for _, t in ROWS]))
    s, e, at = bytescan.words(raw, off)
    keys, counts = np.unique(ppm.context_keys(*ppm.token_bytes(raw, s, e, at, ORDER), ORDER), return_counts=True)
    trie = ppm.Trie(keys, counts, ORDER)
    for ctx in (b"\n\n\n", b" th", b"zzz", b"\xff\xfe\xfd", b"the"):
        head = np.uint64(int.from_bytes(ctx, "big") << 8)
        total = (10 ** trie.log10(head + np.arange(256, dtype=np.uint64))).sum()
        assert total <= 1 + 1e-9
        assert total > 0.5
