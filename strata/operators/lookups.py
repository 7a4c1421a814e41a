"""Lookups that say what happens when a key of the lookup table repeats.

A left join to a lookup table is a plain lookup only while the table has one
row per key. A repeated key multiplies rows without a word, and the figures
above are wrong. Here every lookup states its rule:

* ``rule="one"``: the key is unique; a repeated key ends the job with an error
  that names the lookup and the key;
* ``rule="first"`` / ``"last"``: the row with the smallest / greatest ``order``
  counts (then the smallest / greatest taken values, so the order is total);
* ``rule="all"``: every distinct set of taken values gives a row, as a join
  does; equal rows of the table do not multiply.

The table is reduced to that before it is joined: one partial aggregate on the
key, so a key that holds much of the table is combined in the map tasks, and
the rows joined to are as few as can be. The check and the counts of repeats
(:class:`LookupReport`) come with the same job, not from one of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

RULES = ("one", "first", "last", "all")


class LookupReport:
    """Keys of a lookup table, how many of them repeat, and rows beyond one per
    key; known once an action on the joined rows has run."""

    def __init__(self, name: str = "lookup"):
        self.observation = Observation(f"{name}_{uuid.uuid4().hex[:8]}")

    @property
    def counts(self) -> dict[str, int]:
        return {k: int(v or 0) for k, v in self.observation.get.items()}


def reduced_lookup(lookup: DataFrame, keys: Sequence[str], take: Sequence[str], rule: str = "one", order: Sequence[str] = (),
                   name: str = "lookup", report: LookupReport | None = None) -> DataFrame:
    """``keys`` and ``take`` of ``lookup`` under ``rule`` (see the module); rows
    with a null key are left out, as they match nothing."""
    if rule not in RULES:
        raise ValueError(f"{rule} is none of {RULES}")
    present = lookup
    for k in keys:
        present = present.filter(F.col(k).isNotNull())
    taken = F.struct(*take)
    ranked = F.struct(*order, *take)
    value = {"one": F.min(taken), "first": F.min(ranked), "last": F.max(ranked), "all": F.collect_set(taken)}[rule]
    found = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), value.alias("__v"))
    if report is not None:
        found = found.observe(report.observation, F.count(F.lit(1)).alias("keys"), F.sum((F.col("__n") > 1).cast("long")).alias("repeated_keys"),
                              F.sum(F.col("__n") - 1).alias("extra_rows"))
    if rule == "all":
        return found.select(*keys, F.inline("__v"))
    one = F.col("__v")
    if rule == "one":
        said = F.concat(F.lit(f"{name}: repeated key "), F.to_json(F.struct(*keys)))
        one = F.when(F.col("__n") > 1, F.raise_error(said).cast(found.schema["__v"].dataType)).otherwise(one)
    return found.withColumn("__v", one).select(*keys, *[F.col(f"__v.{c}").alias(c) for c in take])


def checked_lookup(df: DataFrame, lookup: DataFrame, on: Sequence[tuple[Column | str, str]], take: Mapping[str, str],
                   rule: str = "one", order: Sequence[str] = (), found: str | None = None, name: str = "lookup",
                   report: LookupReport | None = None, few: bool = False) -> DataFrame:
    """``df`` with columns of ``lookup``: ``take`` maps new column names to the lookup's.

    ``on`` pairs an expression or column of ``df`` with a key column of the
    lookup; a null on either side matches nothing. Rows without a match have
    nulls; ``found`` names a boolean column that tells them from nulls in the
    lookup. Under ``rule="one"``, ``"first"`` and ``"last"`` every row of ``df``
    comes back exactly once. ``few``: the lookup has few keys, each of which may
    hold much of ``df`` (areas, classes); it is broadcast, not shuffled on them.
    """
    keys = [k for _, k in on]
    small = reduced_lookup(lookup, keys, list(dict.fromkeys(take.values())), rule, order, name, report)
    small = small.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.lit(True).alias("__hit"),
                         *[F.col(c).alias(f"__t{i}") for i, c in enumerate(take.values())])
    small = F.broadcast(small) if few else small
    cond = None
    for i, (expr, _) in enumerate(on):
        term = (F.col(expr) if isinstance(expr, str) else expr) == F.col(f"__k{i}")
        cond = term if cond is None else cond & term
    out = df.join(small, cond, "left")
    out = out.withColumns({new: F.col(f"__t{i}") for i, new in enumerate(take)})
    if found:
        out = out.withColumn(found, F.coalesce("__hit", F.lit(False)))
    return out.drop("__hit", *[f"__k{i}" for i in range(len(on))], *[f"__t{i}" for i in range(len(take))])


def row_key(cols: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row's values, 128 bits together.

    Spark's hash functions skip nulls, so ``(null, 'a')`` and ``('a', null)``
    hash alike; the places of the nulls are therefore hashed too.
    """
    holes = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return [F.xxhash64(F.lit(seed), holes, *cols) for seed in (17, 40_487)]


def collapse_rows(df: DataFrame, any_value: Mapping[str, Sequence[str]] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """One row per distinct set of the other columns; a column of ``any_value``
    keeps one of its values.

    Wide ``GROUP BY`` used to remove duplicates: rows meet on :func:`row_key`
    (16 bytes instead of all columns), so the sort and the comparisons of the
    aggregate do not touch the wide values, of which one copy per map task and
    group is shuffled. ``any_value`` maps a column to the columns that rank it:
    the value with the smallest rank counts (then the smallest value, nulls
    last), whatever the order of the rows, so reruns and other partitionings
    agree. Columns used only to rank are named in ``drop``.
    """
    any_value = dict(any_value or {})
    rest = [c for c in df.columns if c not in any_value and c not in drop]
    k1, k2 = row_key(rest)
    picks = [F.min(F.struct(*[F.col(r).alias(f"r{j}") for j, r in enumerate(rank)], F.col(c).isNull().alias("n"), F.col(c).alias("v"))).alias(f"__a{i}")
             for i, (c, rank) in enumerate(any_value.items())]
    rows = df.withColumn("__k1", k1).withColumn("__k2", k2)
    out = rows.groupBy("__k1", "__k2").agg(F.first(F.struct(*rest)).alias("__row"), *picks)
    where = {c: F.col(f"__a{i}.v") for i, c in enumerate(any_value)} | {c: F.col(f"__row.{c}") for c in rest}
    return out.select(*[where[c].alias(c) for c in df.columns if c in where])
