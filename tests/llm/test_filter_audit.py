"""Posting lists against sets, and the audit against a brute-force version that applies every order row by row."""

import itertools
import random
import re

import numpy as np
import pytest

from strata.llm import filter_audit as A


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_sizes_against_sets(size):
    rng = random.Random(size)
    for n in (0, 1, 5, 300):
        sets = [set(rng.sample(range(2 * n + 1), rng.randrange(n + 1))) for _ in range(5)]
        marks = [set(rng.sample(range(2 * n + 1), rng.randrange(n + 1))) for _ in range(2)]
        got = A.interaction_sizes([np.array(sorted(s), np.int64) for s in sets], [np.array(sorted(s), np.int64) for s in marks], size)
        for f, s in itertools.product(range(5), range(32)):
            if s >> f & 1:
                assert not got[f, s].any()
                continue
            union = set().union(*(sets[i] for i in range(5) if s >> i & 1))
            left = sets[f] - union
            assert got[f, s].tolist() == [len(left), len(union | sets[f]), *(len(left & m) for m in marks)]


def test_gallop():
    ids = np.array([1, 4, 4, 9, 12, 30, 31, 32, 90])
    for at in range(len(ids) + 1):
        for bound in range(-1, 95):
            want = at + int((ids[at:] <= bound).sum())
            assert A.gallop(ids, at, bound) == want


def brute(rows, labels, min_words):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for d, t, lang in rows:
        text = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", text)
        f = set()
        if len(w) < min_words:
            f.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            f.add("C")
        if re.search("[#$%&*|]", text):
            f.add("D")
        if d is not None and any(x is not None and x < d and (y or "") == text for x, y, _ in rows):
            f.add("E")
        fails.append((lang or "", f, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for i, x in enumerate(order):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                failing = [r for r in mine if x in r[1]]
                out[part, order, i + 1] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), 0]
        for x in "ABCDE":
            total = sum(v[1] for (p, o, i), v in out.items() if p == part and o[i - 1] == x)
            for (p, o, i), v in out.items():
                if p == part and o[i - 1] == x:
                    v[6] = total
    return out


ROWS = [(1, "a b c d", "en"), (2, "a b c d", "en"), (2, "a b c d", "de"), (None, "a b c d", "en"), (3, None, None), (4, "", ""), (5, "x x x x x", "en"),
        (6, "ONE two $ three", "de"), (7, "one TWO # three", "de"), (8, "é ü ß É", "fr"), (9, "x x x x x", "fr"), (10, "A" * 5000, "fr"), (11, "w " * 3000, "en"),
        (11, "w " * 3000, "en"), (12, "all fine with this text", "it"), (13, " \n\t ", "it"), (14, "a b\x00c | d e", None)]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (5, 0, 1), (None, 1, 1), (6, None, None), (10, 1, 1), (99, 1, 1), (12, 1, 0), (11, 1, 0)]


def test_audit_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, lang string, part int, fails string").repartition(5)
    labels = spark.createDataFrame([(*r, "own") for r in LABELS], "doc_id long, quality int, toxic int, good string")
    got = A.filter_interactions(docs, labels, min_words=4).collect()
    want = brute(ROWS, LABELS, 4)
    assert len(got) == len(want) == 600 * 5
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == want[r.part, r.filter_order, r.step]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_interactions(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "fine " + " ".join(map(str, range(300))), "en")], docs.schema)
    rows = A.filter_interactions(one, labels).collect()
    assert len(rows) == 600 and {(r.kept, r.removed, r.redundant, r.shapley) for r in rows} == {(1, 0, 0, 0)}
