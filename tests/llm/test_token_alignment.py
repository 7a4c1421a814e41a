"""Groups, links and counts against a brute-force version over byte ranges."""

import collections
import hashlib
import random

import numpy as np
import pytest

from strata.llm import token_alignment as T
from strata.llm.queries import vocabulary

A_PATH, B_PATH = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
TEXTS = ["the cat sat on the mat", "the cat sat on the mat", None, "", "  a  b ", "tab\there\nand\r\n there", "é漢😀 ß ①", "▁x", "<|endoftext|> and <s> a </s> <0x41>", "hello▁", "\x00",
         "unbelievable " * 400, "q" * 3000, "Zürich straße naïve café", " \n\t "]


@pytest.fixture(scope="module")
def sides():
    return [kind(open(p, "rb").read()) for kind, p in ((T.SideA, A_PATH), (T.SideB, B_PATH))]


def ranges(ids, token):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(token[i])))
        at = out[-1][1]
    return out


def brute(rows, sides):
    found, count = [], collections.Counter()
    for _, t in rows:
        ids = [s.encode([t or ""])[0] for s in sides]
        if not t or any(b"".join(s.token[i] for i in x) != b" " + t.encode() for s, x in zip(sides, ids, strict=True)):
            found.append(None)
            continue
        ra, rb = (ranges(x, s.token) for s, x in zip(sides, ids, strict=True))
        links = [(ids[0][i], ids[1][j]) for i, (s, e) in enumerate(ra) for j, (u, v) in enumerate(rb) if u < e and s < v] if len(ra) < 500 else None
        if links is None:
            links, j = [], 0
            for i, (s, e) in enumerate(ra):
                while rb[j][1] <= s:
                    j += 1
                k = j
                while k < len(rb) and rb[k][0] < e:
                    links.append((ids[0][i], ids[1][k]))
                    k += 1
        groups, start = [], 0
        for e in sorted({e for _, e in ra} & {e for _, e in rb}):
            groups.append("|".join(",".join(str(i) for i, (u, v) in zip(x, r, strict=True) if start <= u and v <= e) for x, r in zip(ids, (ra, rb), strict=True)))
            start = e
        count.update(set(links))
        found.append((len(ids[0]), len(ids[1]), groups, links))
    best = collections.defaultdict(int)
    for (a, _), c in count.items():
        best[a] = max(best[a], c)
    return [(d, 0, 0, 0, 0, 0, 0, "") if f is None else
            (d, f[0], f[1], len(f[2]), len(f[3]), sum(count[x] == best[x[0]] for x in f[3]), sum(count[x] for x in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest())
            for (d, _), f in zip(rows, found, strict=True)]


@pytest.mark.parametrize("heavy", [0, 20, 1 << 20])
def test_against_brute_force(spark, sides, heavy):
    rows = [*enumerate(TEXTS), (None, "no id here"), (3, "the mat sat"), (0, "the cat")]
    df = spark.createDataFrame([(d, t, "own", 5) for d, t in rows], "doc_id long, text string, rid string, pair int").repartition(3)
    got = T.align_documents(df, A_PATH, B_PATH, heavy=heavy).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, sides), key=repr)
    assert sum(r.n_a > 0 for r in got) >= 12


def test_empty_table(spark):
    assert T.align_documents(spark.createDataFrame([], "doc_id long, text string"), A_PATH, B_PATH).collect() == []


def test_pointer_jumping_on_any_cuts():
    rng = random.Random(3)
    for _ in range(300):
        off, ids = [[0], [0]], [[], []]
        length = np.arange(1, 40)  # token i has i + 1 bytes
        for _ in range(rng.randrange(1, 5)):
            total = rng.choice([0, 1, 7, 60])
            for side in (0, 1):
                cuts = sorted(rng.sample(range(1, total), rng.randrange(min(total, 20)))) if total > 1 else []
                sizes = np.diff([0, *cuts, total]) if total else []
                sizes = [s for x in sizes for s in ([x] if x < 39 else [30, x - 30])]
                ids[side] += [int(s) - 1 for s in sizes]
                off[side].append(len(ids[side]))
        x = T.Aligned(np.array(ids[0], np.int64), np.array(off[0]), np.array(ids[1], np.int64), np.array(off[1]), length, length)
        terminal = x.terminals()
        both = set(x.a_end.tolist()) & set(x.b_end.tolist())
        for k, e in enumerate([*x.a_end.tolist(), *x.b_end.tolist()]):
            assert x.a_end[terminal[k]] == min(b for b in both if b >= e)
        n, written = x.groups(terminal)
        want = [len({e for e in both if a < e <= b}) for a, b in zip(*(lambda t: (t[:-1], t[1:]))(np.concatenate([[0], x.a_end])[x.a_off]), strict=True)]
        assert n.tolist() == want == [w.count("|") for w in written]
