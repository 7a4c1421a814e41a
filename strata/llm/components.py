"""Connected components of an edge table by alternating star contraction.

Every round joins each node with the smallest neighbour (large star, then
small star); after O(log^2 n) rounds each node points at the smallest node of
its component (a star forest). Minima are partial aggregates, so a node with very many edges
is combined before the shuffle, and the joins back are plain equi-joins whose
hot partitions adaptive execution splits. Edges are contracted to forests, a
bounded number at a time, by the tasks that store them, which saves rounds.
Tables of a round are stored by as many tasks as their size asks for, however
many partitions a shuffle has. Nothing but the answer to "is it a star forest"
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.shared import Scratch

FOREST = 1 << 18


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (i, j): the smallest node of each node's component."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:  # follow pointers to the end
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def forest(edges: list[np.ndarray], a: str, b: str) -> pa.RecordBatch:
    """Edges that connect the same nodes: from the smallest node reached (``a``) to each other one (``b``)."""
    ids, at = np.unique(np.concatenate(edges), return_inverse=True)
    root = least_reached(len(ids), *at.reshape(-1, 2).T)
    far = root != np.arange(len(root))
    return pa.RecordBatch.from_arrays([pa.array(ids[root[far]]), pa.array(ids[far])], [a, b])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as forests, of ``FOREST`` edges each."""
    held, n = [], 0
    for b in batches:
        held.append(np.column_stack([b.column("u").to_numpy(), b.column("v").to_numpy()]))
        n += b.num_rows
        if n >= FOREST:
            yield forest(held, "v", "u").select(["u", "v"])
            held, n = [], 0
    if n:
        yield forest(held, "v", "u").select(["u", "v"])


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch,
                         max_rounds: int = 64, files: int | None = None) -> DataFrame:
    """``node, component`` (both long) for every node that has an edge to
    another node; ``component`` is the smallest node reachable. Nulls, loops
    and repeated edges are ignored. ``files``: how many tasks write the edges at
    most; later tables are written by as many as the size of the edges asks for."""
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
         .where("_a is not null and _b is not null and u <> v").select("u", "v").distinct())

    def stored(df, name, n):
        return scratch.table((df if n is None else df.coalesce(n)).mapInArrow(_contract, "u long, v long"), name)

    e = stored(e, "edges", files)
    for _ in range(max_rounds):
        n = scratch.files(e)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are tables of their own: a join between two plain scans is one whose hot partitions can be split
        low, high = F.when(F.col("v") < F.col("u"), F.col("v")), F.col("v") > F.col("u")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.max(low).alias("low"), F.max(high).alias("high"))
        # in a star forest a node has either one smaller neighbour or larger ones only
        least = least.select("u", F.least("u", "m").alias("m"), ((F.col("m") < F.col("u")) & (F.col("high") | (F.col("low") > F.col("m")))).alias("open"))
        least = scratch.table(least, "least", n)
        if least.where("open").isEmpty():
            scratch.drop(e)
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = scratch.table(both.join(least.drop("open"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large", n)
        low = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "low", n)
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = stored(small, "star", n)
        for t in (e, least, large, low):
            scratch.drop(t)
        e = new
    raise RuntimeError(f"no star forest after {max_rounds} rounds")
