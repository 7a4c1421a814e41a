"""Relations derived from the driver tables (FIXTURES.md section 3).

Each function reads the given tables through Spark, so its work grows with
them. The SQL twins used by the DuckDB oracle live in ``strata.plans.oracle``
and must stay equivalent row for row.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import concat_parts, first_match, ntz
from strata.operators.history import EventHistory, describe_events
from strata.operators.intervals import bucket_by_interval, contiguous_intervals
from strata.operators.ordered import spread, with_next_in_group
from strata.session import materialize
from strata.sources.tables import Tables

AS_OF = dt.date(2001, 8, 1)
EVENTS_AS_OF = dt.date(2024, 1, 31)
SEED = 42

# Run types and how many days each run trails its daily run
# date; together they define the derived run calendar.
RUN_LAGS = [("II", 30), ("SF", 210), ("R1", 395), ("R2", 760), ("R3", 1125), ("RF", 1670)]
# Hours per owner (one owner deliberately has no entry).
CAPACITY = [("agent0", 36.5), ("agent1", 36.5), ("agent2", 30.0), ("agent3", 22.5),
            ("agent4", 15.0), ("agent5", 0.0)]
# Order status code descriptions (the code lookup table).
STATUS_CODES = [("F", "fulfilled"), ("O", "open"), ("P", "partial")]


def memo(fn):
    """Derive a fixture once per query plan (see ``Tables.memo``)."""
    @functools.wraps(fn)
    def wrapper(t: Tables, *args, **kwargs):
        if args or kwargs:
            return fn(t, *args, **kwargs)
        return t.memo(fn.__name__, lambda: fn(t))
    return wrapper


@memo
def runs(t: Tables) -> DataFrame:
    """(run, date, run_day): each distinct order day is a run day two days
    later; each run type settles the day ``lag`` days before the order day."""
    days = t.orders.select(F.to_date("o_orderdate").alias("d")).distinct()
    lags = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(n).alias("lag")) for r, n in RUN_LAGS])
    cal = (days.select("d", F.inline(lags))
           .select("run", F.date_sub("d", F.col("lag")).alias("date"),
                   F.date_add("d", 2).alias("run_day")))
    return materialize(cal)  # the run calendar table (days x run types)


@memo
def intervals(t: Tables) -> DataFrame:
    """One row per run type; written once so scalar lookups read a tiny file."""
    return materialize(contiguous_intervals(runs(t), AS_OF))


@memo
def periods(t: Tables) -> DataFrame:
    """(pk, id, start_date, end_date, status, priority): one validity period per order,
    ending on the customer's next order day (open for the last order)."""
    o = t.orders.select(F.col("o_orderkey").alias("pk"), F.col("o_custkey").alias("id"),
                        F.to_date("o_orderdate").alias("start_date"),
                        F.col("o_orderstatus").alias("status"),
                        F.col("o_orderpriority").alias("priority"))
    nxt = with_next_in_group(o, ["id"], [F.col("start_date"), F.col("pk")], ["start_date"],
                             prefix="next_")
    return nxt.withColumnRenamed("next_start_date", "end_date")  # stored once, read by every period query


@memo
def rule_periods(t: Tables, per: DataFrame | None = None) -> DataFrame:
    """Periods plus derived disconnection / de-energisation dates and flag."""
    pk = F.col("pk")
    per = periods(t) if per is None else per
    return (per
            .withColumn("disc_date", F.when(pk % 9 == 0,
                                            F.date_add("start_date", (pk % 500).cast("int"))))
            .withColumn("energ", F.when(pk % 4 == 1, F.lit("D")).otherwise(F.lit("E")))
            .withColumn("deenerg_date", F.when(pk % 4 == 1,
                                               F.date_add("start_date", (pk % 300).cast("int")))))


@memo
def reads(t: Tables) -> DataFrame:
    """(id, ts, code, note, l_orderkey, l_linenumber): line items as readings."""
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag",
                           "l_linestatus")
    o = t.orders.select("o_orderkey", "o_custkey")
    return (spread(li, "l_orderkey").join(o, F.col("l_orderkey") == o.o_orderkey)
            .select(F.col("o_custkey").alias("id"), F.col("l_shipdate").alias("ts"),
                    F.col("l_returnflag").alias("code"),
                    F.when(F.col("l_orderkey") % 5 == 0, F.lit(None).cast("string"))
                    .otherwise(F.col("l_linestatus")).alias("note"),
                    "l_orderkey", "l_linenumber"))


@memo
def checkpoints(t: Tables) -> DataFrame:
    """(id, cp_date): latest fulfilled order day per customer."""
    return (t.orders.filter(F.col("o_orderstatus") == "F")
            .groupBy(F.col("o_custkey").alias("id"))
            .agg(F.max(F.to_date("o_orderdate")).alias("cp_date")))


@memo
def contracts(t: Tables) -> DataFrame:
    """(id, contract_end): latest urgent/high order day per customer (contract end)."""
    return (t.orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
            .groupBy(F.col("o_custkey").alias("id"))
            .agg(F.max(F.to_date("o_orderdate")).alias("contract_end")))


@memo
def position(t: Tables) -> DataFrame:
    """One row per customer: name, meter_type (both with nulls), area, value,
    and the run/start/end of one order picked by md5 of its key."""
    per = periods(t)
    picked = (per.groupBy("id")
              .agg(F.min_by(F.struct("pk", "start_date", "end_date"),
                            F.struct(F.md5(F.col("pk").cast("string")), F.col("pk"))).alias("p"))
              .select("id", "p.pk", "p.start_date", "p.end_date"))
    c = t.customer
    n = t.nation
    cust = (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("c_custkey").alias("id"),
                    F.when(F.col("c_custkey") % 17 == 0, F.lit(None).cast("string"))
                    .otherwise(F.col("c_mktsegment")).alias("name"),
                    F.when(F.col("c_custkey") % 13 == 0, F.lit(None).cast("string"))
                    .otherwise(F.col("n_regionkey").cast("string")).alias("meter_type"),
                    F.col("n_name").alias("area"), F.col("c_acctbal").alias("value")))
    pos = cust.join(picked, "id")
    pos = bucket_by_interval(pos, "start_date", intervals(t), label="run")
    return materialize(pos)  # the position table: written once, read by many queries


@memo
def cases(t: Tables) -> DataFrame:
    """Work items: (id, owner, team, status, kind, parent_id, subject)."""
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("id"),
        F.when(k % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("agent"), (F.col("o_custkey") % 7).cast("string"))).alias("owner"),
        F.col("o_orderpriority").alias("team"),
        F.when(F.col("o_orderstatus") == "F", "Closed").otherwise("Open").alias("status"),
        F.when(k % 4 == 0, "LoneCase").when(k % 4 == 2, "ParentCase")
        .otherwise("ChildCase").alias("kind"),
        F.when(k % 4 != 0, F.when(k % 4 != 2, k - k % 4 + 2)).alias("parent_id"),
        F.when(k % 11 == 0, "Complex query").otherwise("Routine query").alias("subject"))


# Descriptions of the return flags (the event code lookup table).
EVENT_CODES = [("A", "accepted"), ("N", "not returned"), ("R", "returned")]
# What a part type says about export; other types are FALSE.
EXPORT_TYPES, UNKNOWN_EXPORT_TYPES = ("ECONOMY",), ("PROMO",)
# Customer types by market segment; the others are Domestic.
CUSTOMER_TYPES = {"BUILDING": "Commercial", "MACHINERY": "Commercial", "AUTOMOBILE": "Micro Business"}


def event_codes(spark) -> DataFrame:
    return spark.createDataFrame(EVENT_CODES, "code string, description string")


@memo
def details(t: Tables) -> DataFrame:
    """(pk, distributor, line_class, profile_class, config_id, area, postcode, service_flag): what a
    period's registration says; the class is not a number for every tenth customer."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    c, n = t.customer, t.nation
    x = spread(o, "o_custkey").join(c, F.col("o_custkey") == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return x.select(F.col("o_orderkey").alias("pk"), F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 25 + 1).cast("string")).alias("distributor"),
                    (F.col("c_custkey") % 10 + 1).cast("int").alias("line_class"),
                    F.when(F.col("c_custkey") % 10 == 0, F.lit("n/a")).otherwise(F.col("c_nationkey").cast("string")).alias("profile_class"),
                    F.col("c_mktsegment").alias("config_id"), F.col("n_name").alias("area"),
                    F.concat_ws(" ", F.concat(F.lit("Z"), F.col("c_nationkey").cast("string")), (F.col("c_custkey") % 90 + 10).cast("string")).alias("postcode"),
                    F.substring("o_orderpriority", 1, 1).alias("service_flag"))


@memo
def exports(t: Tables) -> DataFrame:
    """(participant, class_id, export_indicator, priority): keys repeat; the flag is three-valued."""
    flag = F.when(F.col("p_type").isin(*UNKNOWN_EXPORT_TYPES), F.lit(None)).otherwise(F.col("p_type").isin(*EXPORT_TYPES))
    return t.part.select(F.col("p_brand").alias("participant"), (F.col("p_size") % 10 + 1).alias("class_id"), flag.alias("export_indicator"), F.col("p_partkey").alias("priority"))


@memo
def meters(t: Tables) -> DataFrame:
    """(link, meter_type, seen, line): a meter per line item, linked to its order's period."""
    return spread(t.lineitem, "l_orderkey").select(F.col("l_orderkey").alias("link"), F.col("l_returnflag").alias("meter_type"), F.col("l_shipdate").alias("seen"), F.col("l_linenumber").alias("line"))


@memo
def handlers(t: Tables) -> DataFrame:
    """(area, handler): of each nation the supplier with the largest balance."""
    s, n = t.supplier, t.nation
    return (s.join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("area"))
            .agg(F.max_by("s_name", F.struct("s_acctbal", "s_suppkey")).alias("handler")))


@memo
def account_holders(t: Tables) -> DataFrame:
    """(id, customer_type, customer_name, customer_number, address); every 17th has no name."""
    c, n, r = t.customer, t.nation, t.region
    kind = first_match([(F.col("c_mktsegment") == k, v) for k, v in CUSTOMER_TYPES.items()], "Domestic")
    parts = [F.col("c_name"), F.when(F.col("c_custkey") % 7 == 0, F.lit("   ")).otherwise(F.col("c_mktsegment")),
             F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.col("n_name")), F.col("r_name")]
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("c_custkey").alias("id"), kind.alias("customer_type"),
                    F.when(F.col("c_custkey") % 17 != 0, F.col("n_name")).alias("customer_name"), F.col("c_name").alias("customer_number"),
                    concat_parts(parts).alias("address")))


@memo
def own_volumes(t: Tables) -> DataFrame:
    """(id, annual_volume): recent returned value per customer that has any, as a decimal."""
    li, o = t.lineitem, t.orders.select("o_orderkey", "o_custkey")
    recent = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= ntz(dt.datetime(2000, 1, 1)))
    return (spread(li.filter(recent), "l_orderkey").join(o, F.col("l_orderkey") == o.o_orderkey).groupBy(F.col("o_custkey").alias("id"))
            .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("annual_volume")))


@memo
def default_volumes(t: Tables) -> DataFrame:
    """(class_num, config_id, area, default_annual_volume): mean balance per nation and segment, as a decimal."""
    c, n = t.customer, t.nation
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .groupBy(F.col("c_nationkey").cast("bigint").alias("class_num"), F.col("c_mktsegment").alias("config_id"), F.col("n_name").alias("area"))
            .agg((F.sum(F.col("c_acctbal").cast("decimal(18,2)")) / F.count(F.lit(1))).alias("default_annual_volume")))


@memo
def event_history(t: Tables) -> EventHistory:
    """All readings with description and audit flag, stored once (bucketed) for every join to periods."""
    return EventHistory.store(describe_events(reads(t), event_codes(t.spark), "code", "code", "description", ["N"]), "id", "ts")


def capacity(spark) -> DataFrame:
    return spark.createDataFrame(CAPACITY, "owner string, hours double")


def status_codes(spark) -> DataFrame:
    return spark.createDataFrame(STATUS_CODES, "code string, description string")


@memo
def profit(t: Tables) -> DataFrame:
    """(id, value): per part, discounted revenue minus list price x quantity,
    summed exactly in decimal and returned as double."""
    li = t.lineitem.select(
        "l_partkey",
        (F.col("l_extendedprice").cast("decimal(18,2)")
         * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).alias("rev"),
        F.col("l_quantity").cast("decimal(18,2)").alias("qty"))
    per = li.groupBy("l_partkey").agg(F.sum("rev").alias("rev"), F.sum("qty").alias("qty"))
    p = t.part.select("p_partkey", F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    return (per.join(p, per.l_partkey == p.p_partkey)
            .select(F.col("p_partkey").alias("id"),
                    (F.col("rev") - F.col("price") * F.col("qty")).cast("double").alias("value")))


@memo
def messages(t: Tables) -> DataFrame:
    return (t.conversations
            .select(F.col("conv_id").alias("id"), "turn", "text"))
