"""Workload-weighted apportionment of open work items to owners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.columns import seeded_order_key
from strata.operators.ordered import with_row_number

# Labels of items without an owner and of the team for complex ones.
UNASSIGNED = "No Agent Assigned"
COMPLEX_TEAM = "Complex Cases"


def adjusted_team(subject: str = "subject", team: str = "team", keyword: str = "COMPLEX",
                  label: str = COMPLEX_TEAM) -> Column:
    """Items whose subject mentions ``keyword`` (any case) go to ``label``."""
    return F.when(F.upper(F.col(subject)).like(f"%{keyword}%"), F.lit(label)).otherwise(F.col(team))


def _open(status: str, closed: str) -> Column:
    return F.col(status) != F.lit(closed)


def owner_workload(cases: DataFrame, capacity: DataFrame, kinds: Sequence[str] = ("LoneCase", "ChildCase"),
                   owner: str = "owner", status: str = "status", kind: str = "kind",
                   closed: str = "Closed", team: Column | None = None) -> DataFrame:
    """(owner, adjusted_team, open_count int, hours double) for open items of
    the given kinds that have an owner. Hours come from ``capacity`` (owner,
    hours), 0 for owners missing there; an owner in two teams gets full hours
    in each. Owners without open items do not appear. ``team`` is the team an
    item counts for (default: :func:`adjusted_team`)."""
    open_items = cases.filter(_open(status, closed) & F.col(kind).isin(*kinds)
                              & F.col(owner).isNotNull())
    team = adjusted_team() if team is None else team
    agg = (open_items.groupBy(F.col(owner).alias("owner"), team.alias("adjusted_team"))
           .agg(F.count(F.lit(1)).cast("int").alias("open_count")))
    cap = capacity.groupBy(F.col("owner").alias("__cap_owner")).agg(F.max("hours").alias("hours"))
    res = agg.join(cap, agg.owner == cap.__cap_owner, "left").drop("__cap_owner")
    return res.withColumn("hours", F.coalesce(F.col("hours"), F.lit(0.0)).cast("double"))


def unassigned(cases: DataFrame, kinds: Sequence[str], owner: str = "owner",
               status: str = "status", kind: str = "kind", closed: str = "Closed") -> DataFrame:
    """Open items of ``kinds`` with no owner, outside the complex team.

    Adds ``altered_agent`` (the owner or the unassigned label) and
    ``adjusted_team``. A NULL team compares unknown with the complex label, so
    such items drop out, as in SQL.
    """
    alt = F.coalesce(F.col(owner), F.lit(UNASSIGNED))
    adj = adjusted_team()
    return (cases.filter(_open(status, closed) & (alt == F.lit(UNASSIGNED))
                         & (adj != F.lit(COMPLEX_TEAM)) & F.col(kind).isin(*kinds))
            .select(alt.alias("altered_agent"), adj.alias("adjusted_team"), *cases.columns))


WEIGHT_UNIT = 10 ** 9


def agent_weights(workload: DataFrame, load_offset: int = 5) -> DataFrame:
    """weight = hours / (open_count + offset) for owners with hours > 0, its
    share of the team's weight, and the cumulative share by owner name.

    Weights are taken in whole units of 1e-9 (``units``), so sums over a team
    (``team_units``, and ``cum_units`` up to an owner) are exact and do not
    depend on the order in which rows arrive; shares are one division each, and
    a team's last cumulative share is exactly 1.

    One row per (owner, team): the per-team windows hold at most the number of
    owners in a team, which does not grow with the data.
    """
    units = F.floor(F.col("hours") / (F.col("open_count") + load_offset) * WEIGHT_UNIT + 0.5).cast("long")
    team = Window.partitionBy("adjusted_team")
    running = team.orderBy("owner").rowsBetween(Window.unboundedPreceding, 0)
    return (workload.filter(F.col("hours") > 0).withColumn("units", units)
            .withColumn("team_units", F.sum("units").over(team))
            .withColumn("cum_units", F.sum("units").over(running))
            .withColumn("weight", F.col("units") / F.lit(float(WEIGHT_UNIT)))
            .withColumn("normalized_weight", F.col("units") / F.col("team_units"))
            .withColumn("cum_weight", F.col("cum_units") / F.col("team_units")))


def agent_bands(weights: DataFrame, totals: DataFrame, mode: str = "exact") -> DataFrame:
    """Item-number band (lo, hi] of each owner within its team of n items:
    hi = floor(cumulative share x n), in integer arithmetic.

    ``exact``: lo = the previous owner's hi. ``floor``: lo is computed anew as
    floor((cumulative share - own share) x n). With exact sums both tile 1..n,
    so every item has one owner.
    """
    w = weights.join(totals, "adjusted_team")
    if mode == "floor":
        return (w.withColumn("__prev", F.col("cum_units") - F.col("units"))
                .withColumn("band_lo", _div("__prev")).withColumn("band_hi", _div("cum_units")).drop("__prev"))
    if mode != "exact":
        raise ValueError(mode)
    team = Window.partitionBy("adjusted_team").orderBy("owner")
    w = w.withColumn("band_hi", _div("cum_units"))
    return w.withColumn("band_lo", F.coalesce(F.lag("band_hi").over(team), F.lit(0)).cast("long"))


def _div(units: str) -> Column:
    """floor(units x n_items / team_units) in integer arithmetic."""
    return F.expr(f"(cast({units} as decimal(20,0)) * cast(n_items as decimal(18,0))) div team_units").cast("long")


def band_join(items: DataFrame, bands: DataFrame, key: str, pos: str, lo: str, hi: str,
              width: int = 1024, how: str = "inner") -> DataFrame:
    """Items whose ``pos`` lies in a band ``(lo, hi]`` of the same ``key``.

    Bands are cut into chunks of ``width`` positions and joined on
    (key, chunk), so an item meets only the one or two bands touching its
    chunk instead of every band of its key; a band spanning many items becomes
    many small rows rather than one giant match.
    """
    chunk = F.floor((F.col(pos) - 1) / width)
    it = items.withColumn("__chunk", chunk)
    first = F.floor(F.col(lo) / width)           # chunk of position lo + 1
    last = F.floor((F.col(hi) - 1) / width)      # chunk of position hi
    chunks = F.when(F.col(hi) > F.col(lo), F.sequence(first, last)).otherwise(
        F.array().cast("array<bigint>"))
    b = bands.withColumnRenamed(key, "__bkey").withColumn("__chunk", F.explode(chunks))
    cond = ((it[key] == b["__bkey"]) & (it["__chunk"] == F.col("__bchunk"))
            & (it[pos] > b[lo]) & (it[pos] <= b[hi]))
    return it.join(b.withColumnRenamed("__chunk", "__bchunk"), cond, how).drop("__chunk", "__bchunk", "__bkey")


def apportion(items: DataFrame, workload: DataFrame, seed: int, id_col: str = "id",
              mode: str = "exact") -> DataFrame:
    """Deal open items to owners of their team in proportion to weight.

    Items are numbered per team in a seeded pseudo-random order (md5 of seed
    and id, then id), which reproduces across runs and partitionings. Each
    owner receives the items whose number falls in its band. Returns all items
    with ``case_rn``, ``assigned_agent``, ``open_count`` and ``hours``; items of
    teams with no weighted owner come back unassigned (null agent).
    """
    order = [seeded_order_key(seed, id_col).asc(), F.col(id_col).asc()]
    numbered = with_row_number(items, ["adjusted_team"], order, out="case_rn")
    totals = items.groupBy("adjusted_team").agg(F.count(F.lit(1)).alias("n_items"))
    bands = agent_bands(agent_weights(workload), totals, mode)
    bands = bands.select(F.col("adjusted_team"), F.col("owner").alias("assigned_agent"),
                         "band_lo", "band_hi", "open_count", "hours")
    return band_join(numbered, bands, "adjusted_team", "case_rn", "band_lo", "band_hi", how="left") \
        .drop("band_lo", "band_hi")


def inherit_from_child(cases: DataFrame, seed: int, id_col: str = "id", owner: str = "owner",
                       parent: str = "parent_id", team: str = "team", kind: str = "kind",
                       status: str = "status", closed: str = "Closed") -> DataFrame:
    """Unassigned open parent items take the owner of one of their assigned
    open children in the same team, picked by a seeded hash of the child id.

    The pick is an aggregate (``min_by`` on the hash), so many children of one
    parent are reduced map-side before the shuffle.
    """
    alt = F.coalesce(F.col(owner), F.lit(UNASSIGNED))
    parents = cases.filter(_open(status, closed) & (alt == UNASSIGNED)
                           & (F.col(kind) == "ParentCase"))
    children = cases.filter(_open(status, closed) & (alt != UNASSIGNED)
                            & (F.col(kind) == "ChildCase"))
    ch = children.select(F.col(parent).alias("__parent"), F.col(team).alias("__team"),
                         F.col(owner).alias("__owner"),
                         seeded_order_key(seed, id_col).alias("__h"), F.col(id_col).alias("__cid"))
    pick = (ch.groupBy("__parent", "__team")
            .agg(F.min_by("__owner", F.struct("__h", "__cid")).alias("assigned_agent")))
    cond = (parents[id_col] == pick["__parent"]) & (parents[team] == pick["__team"])
    return parents.join(pick, cond).drop("__parent", "__team")
