"""Rows that repeat an id with other content are rows of their own."""

import itertools
import re

import numpy as np

from strata.llm import embedding_dedup, jaccard_join, line_dedup


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in links:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (1, [0.0, 0.0, 1.0], 2), (2, [1.0, 0.02, 0.0], 1), (3, [0.0, 1.0, 0.02], 1), (3, [0.0, 1.0, 0.02], 1),
            (4, [0.0, 0.0, 1.0], 1), (2, [0.0, 0.0, 1.0], 2), (7, [1.0, 1.0, 0.0], 1), (9, [0.0, 1.01, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    unit = [np.array(e) / np.linalg.norm(e) for _, e, _ in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98]
    comp = components(len(rows), links)
    least = {c: min(rows[i][0] for i in range(len(rows)) if comp[i] == c) for c in comp}
    want = sorted((rows[i][0], sum(i in p for p in links), least[comp[i]]) for i in range(len(rows)))
    for tile in (2, 2048):
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, tile=tile).collect()) == want


def test_jaccard(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(reversed(words))
    rows = [(1, a), (1, b), (3, b + " more"), (3, "other text of its own here"), (1, a + " tail"), (5, a), (6, b.upper()), (6, None), (8, "other text of its own here"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
        return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2)
             if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    comp = components(len(rows), links)
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = sorted(((rows[i][0], len(sets[i]), None if rows[i][0] is None else least[comp[i]], sum(i in p for p in links)) for i in range(len(rows))), key=repr)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_join(df).collect()), key=repr)
    assert got == want


def test_lines(spark):
    rows = [(3, "shared line of words here\nonly in the first text of three"), (3, "only in the second text\nalso only in the second"), (4, "x y z unique\nshared line of words here"),
            (5, "shared line of words here"), (5, "shared line of words here"), (6, "a b c\na b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.drop_recurring_lines(df).collect())
    assert got == sorted([(3, rows[0][1], 0), (3, rows[1][1], 0), (4, "x y z unique", 1), (5, "", 1), (5, "", 1), (6, "a b c\na b c", 0)])
