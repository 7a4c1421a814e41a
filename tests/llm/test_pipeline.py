"""The stages against brute force on the rows each of them was given."""

import duckdb
import pytest
from test_jaccard_join import brute

import corpus_pipeline
from strata.llm import queries
from strata.llm.shared import Scratch

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, scratch.table(stage(spark, out[-1][1], SF), "step")))
    return out


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_columns_and_names(steps):
    assert [n for n, _ in steps[1:]] == [n for n, _ in corpus_pipeline.STAGES] and len(steps) == 6
    assert all(df.columns == steps[0][1].columns and df.schema.simpleString() == steps[0][1].schema.simpleString() for _, df in steps)


def test_quality_keeps_marked_good(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    kept = {r.doc_id for r in steps[1][1].collect()}
    good = [r.doc_id for r in labels if r.quality == 1]
    bad = [r.doc_id for r in labels if r.quality == 0]
    assert sum(d in kept for d in good) >= 0.98 * len(good)
    assert sum(d in kept for d in bad) <= 0.1 * len(bad)


def test_line_dedup_is_the_oracle(steps):
    con = duckdb.connect()
    documents = steps[1][1].toArrow()
    con.register("documents", documents)
    cut = queries.ORACLE["op2_line_dedup"]
    want = {r[0]: r for r in con.execute(cut).fetchall()}
    got = {r.doc_id: r for r in steps[2][1].collect()}
    gone = {d for d in want if d not in got}
    assert all(want[d][2] > 0 for d in gone)
    for d, r in got.items():
        assert (len(r.text or ""), r.n_chars) == (want[d][3], want[d][3] if want[d][2] else r.n_chars)
    assert all(want[d][3] < 200 for d in gone)


def test_one_of_each_near_duplicate_group(steps):
    rows = [(r.doc_id, r.text) for r in steps[2][1].collect()]
    keep = sorted(d for d, _, component, _ in brute(rows) if d == component)
    assert sorted(r.doc_id for r in steps[3][1].collect()) == keep


def test_no_benchmark_item_is_left_and_only_those_go(spark, steps):
    items = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: (r.text or "").lower() for r in steps[3][1].collect()}
    kept = {r.doc_id for r in steps[4][1].collect()}
    holds = {d for d, t in before.items() if any(i in t for i in items)}
    assert not holds & kept
    gone = set(before) - kept
    assert holds <= gone and len(gone - holds) <= 0.02 * len(before)


def test_mix_is_the_oracle(steps):
    con = duckdb.connect()
    con.register("documents", steps[4][1].toArrow())
    cur = con.execute(queries.ORACLE["op4_source_mix"])
    names = [d[0] for d in cur.description]
    want = {r[names.index("doc_id")]: r[names.index("copies")] for r in cur.fetchall()}
    got = {}
    for r in steps[5][1].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: c for d, c in want.items() if c}


def test_run_is_the_stages(spark):
    small = "/root/testdata/sf0.001"
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.table(stage(spark, docs, small), "step")
    assert _rows(corpus_pipeline.run(spark, small)) == _rows(docs)
