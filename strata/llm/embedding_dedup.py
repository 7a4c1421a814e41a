"""Near-duplicate embeddings by int8 tile products with error bounds.

Equal vectors of a label are first combined into classes (an aggregate that
combines before the shuffle), so copies cost one row. The classes of a label
are dealt into tiles of about ``tile`` vectors by hash; every pair of tiles is
one group of bounded size. In a group, unit vectors are quantised to int8
(scale s, codes q), with e = |x - s q| kept per vector. For two vectors

    |cos(x, y) - s q . t r|  <=  e_x |t r| + |s q| e_y + e_x e_y,

so the integer product decides most pairs; only those for which the bound
leaves both answers open are recomputed in double precision. A group returns,
per class, the number of vectors linked and one edge to the smallest class it
is connected with, never the pairs. Components come from those edges.

Integer products run as float32 matrix products, which are exact below 2^24;
longer vectors are multiplied in blocks of 1,024 dimensions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.components import connected_components, least_reached
from strata.llm.shared import Scratch

_BLOCK = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (float64), codes (float32 holding int8), scales, lengths of
    the decoded vectors, lengths of the errors (rounded up)."""
    # dividing by the largest component first keeps squares inside the range of doubles
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    size = np.sqrt((decoded ** 2).sum(axis=1)) * (1 + 1e-12)
    err = np.sqrt(((x - decoded) ** 2).sum(axis=1)) * (1 + 1e-12) + 1e-15
    return x, codes.astype(np.float32), scale, size, err


def linked(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Boolean matrix: cosine of a's and b's vectors >= threshold."""
    xa, qa, sa, la, ea = a
    xb, qb, sb, lb, eb = b
    dot = np.zeros((len(qa), len(qb)))
    for k in range(0, qa.shape[1], _BLOCK):
        dot += qa[:, k:k + _BLOCK] @ qb[:, k:k + _BLOCK].T
    near = dot * sa[:, None] * sb[None, :]
    bound = np.outer(ea, lb) + np.outer(la, eb) + np.outer(ea, eb) + 1e-12
    sure = near - bound >= threshold
    i, j = np.nonzero((near + bound >= threshold) & ~sure)
    for k in range(0, len(i), 1 << 16):
        p, q = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
        # unit vectors carry rounding errors of some 1e-16; exact ties count as links
        sure[p, q] = np.einsum("ij,ij->i", xa[p], xb[q]) >= threshold - 1e-15
    return sure


def _tile_pair(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid")
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        ids, copies = rows["cid"].to_numpy(), rows["copies"].to_numpy()
        side, own = rows["tile"].to_numpy(), rows["tile_a"].iloc[0]
        parts = quantise(x)
        first = np.flatnonzero(side == own)
        second = np.flatnonzero(side != own)
        same = rows["tile_a"].iloc[0] == rows["tile_b"].iloc[0]
        if same:
            second = first
        if not len(first) or not len(second):
            return pd.DataFrame({"cid": ids[:0], "links": copies[:0], "root": ids[:0]})
        hit = linked(tuple(p[first] for p in parts), tuple(p[second] for p in parts), threshold)
        links = np.zeros(len(ids), np.int64)
        if same:
            np.fill_diagonal(hit, False)
            links[first] = hit @ copies[second]
        else:
            links[first] = hit @ copies[second]
            links[second] = copies[first] @ hit
        i, j = np.nonzero(hit)
        root = ids[least_reached(len(ids), first[i], second[j])]
        keep = links > 0
        return pd.DataFrame({"cid": ids[keep], "links": links[keep], "root": root[keep]})
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = 2048) -> DataFrame:
    """``vec_id, n_links, component_id, kept, label``, one row per row of ``vectors``.

    Reads ``vec_id, embedding, label``. Two vectors link when their labels are
    equal and not null, their lengths are equal and their cosine is at least
    ``threshold``. A vector that is null, empty, zero, or holds a null or
    non-finite component links with nothing, nor does a row without id, whose
    component is null. Rows that repeat an id are further vectors, each with its own
    label, values and links. Components and ``kept`` go by the smallest id reached.
    An empty table gives none.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    sound = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
                       & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                       & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one group for Spark as well as one value here
    rows = rows.withColumn("sound", sound)
    classes = (rows.where("sound").groupBy("label", "embedding")
               .agg(F.min("vec_id").cast("long").alias("least_id"), F.count("*").alias("copies")))
    # a class has a key of its own: several may have one smallest id
    classes = scratch.table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    dims = classes.select("*", F.size("embedding").alias("dim"))
    tiles = dims.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles"))
    dealt = dims.join(tiles, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    pairs = (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .withColumns({"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")}))
    found = pairs.groupBy("label", "dim", "tile_a", "tile_b").applyInPandas(
        _tile_pair(threshold), "cid long, links long, root long")
    found = scratch.table(found, "found")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comps = connected_components(found, "cid", "root", scratch, files=scratch.files(found)).withColumnRenamed("node", "cid")
    # keys alone are dealt out by component, which may hold much of the table
    least = comps.join(classes.select("cid", "least_id"), "cid").groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = scratch.table(comps, "comps").join(scratch.table(least, "least"), "component").select("cid", "component_id")
    known = (classes.join(links, "cid", "left").join(named, "cid", "left")
             .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component_id", "least_id").alias("component_id")))
    out = rows.where("sound").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id", "label")
    rest = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                          F.col("vec_id").cast("long").alias("component_id"), "label")
    return out.unionByName(rest).select("vec_id", "n_links", "component_id",
                                        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), "label")
