"""The mix draws every row by itself: repeated ids, null ids, equal rows."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import mixing


def test_repeated_and_null_ids_get_their_own_copies(spark):
    rows = [(i, f"a{i} " * (1 + i % 9), "xyz"[i % 3], i) for i in range(60)]
    rows += [(7, "hot words of one id", "x", 1)] * 40 + [(7, "other words one id", "x", k) for k in range(5)]
    rows += [(None, f"no id {i % 4}", "xyz"[i % 3], i) for i in range(30)] + [(None, "w " * 5, None, 0)] * 3 + [(None, None, "x", 0), (99, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    mixed = mixing.mix_sources(docs).collect()
    plan = Counter()
    for r in mixed:
        plan[r.doc_id, r.source, r["size"]] += r.copies
    size = {r: len((r[1] or "").split()) for r in rows}
    have, most = Counter(rows), max(r.copies for r in mixed)
    runs = []
    for d in (docs, docs.repartition(5, F.rand(3))):
        out = corpus_pipeline.mixed(spark, d, "")
        assert out.columns == docs.columns
        got = Counter(map(tuple, out.collect()))
        assert set(got) <= set(have) and all(n <= most * have[r] for r, n in got.items())
        by = Counter()
        for r, n in got.items():
            by[r[0], r[2], size[r]] += n
        assert by == +plan
        runs.append(got)
    assert runs[0] == runs[1]
    assert any(r[0] is None for r in runs[0])
    target = {r.source: r.target for r in mixed}
    for s, t in target.items():
        assert abs(sum(n * size[r] for r, n in runs[0].items() if r[2] == s) - t) <= max(size.values())
