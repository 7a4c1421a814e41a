"""Connected components against a search over neighbours, and the number of tasks that store them."""

import random

from strata.llm.components import connected_components
from strata.llm.shared import Scratch


def reached(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for x in sorted(near):
        todo = [] if x in out else [x]
        while todo:
            y = todo.pop()
            if y not in out:
                out[y] = x
                todo += near[y]
    return sorted(out.items())


def graph(seed):
    r = random.Random(seed)
    line = r.sample(range(1000, 3000), 700)
    edges = [*zip(line, line[1:], strict=False), *((5000 + i, 9000) for i in range(400)),
             *((r.randrange(20_000, 21_000), r.randrange(20_000, 21_000)) for _ in range(600)),
             (7, None), (None, 8), (9, 9), (-3, 1 << 40), (1 << 40, -3)]
    r.shuffle(edges)
    return edges + edges[:50]


def test_few_files_whatever_the_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    edges = graph(1)
    df = spark.createDataFrame(edges, "a long, b long")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = connected_components(df, "a", "b", Scratch(spark, "test"))
        assert len(out.inputFiles()) <= spark.sparkContext.defaultParallelism
        assert sorted(tuple(r) for r in out.collect()) == reached(edges)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_forests_smaller_than_a_task(spark, monkeypatch):
    """A task that contracts a few edges at a time loses no connection."""
    monkeypatch.setattr("strata.llm.components.FOREST", 16)
    df = spark.createDataFrame(graph(2), "a long, b long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = connected_components(df, "a", "b", Scratch(spark, "test"), files=2)
        assert sorted(tuple(r) for r in out.collect()) == reached(graph(2))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_edges(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert connected_components(df, "a", "b", Scratch(spark, "test")).collect() == []
