"""Queries: hierarchy flatten, bridge lookups, text parts, rule cascades,
fallback lookup, try_cast, NOT IN."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strata.functions.columns import ntz, concat_parts, first_match
from strata.operators.ordered import spread
from strata.operators.position import affecting_flags
from strata.operators.rows import (fallback_lookup, flatten_hierarchy, join_chain, not_in,
                                  preferred_row)
from strata.plans import fixtures as fx
from strata.plans.oracle_fixtures import with_ctes
from strata.plans.registry import register
from strata.sources.tables import Tables


@register("q_hierarchy_flatten", with_ctes(["status_codes"], """
SELECT DISTINCT r_name, n_name, c_custkey, CAST(o_orderdate AS DATE) AS order_day,
       o_orderstatus AS status, s.description,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Non-Auditable'
            ELSE 'Auditable' END AS audit_status
FROM region
JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey
JOIN orders ON o_custkey = c_custkey
JOIN status_codes s ON s.code = o_orderstatus"""))
def q_hierarchy_flatten(spark, sf):
    """Four-level inner join chain, a code lookup and an audit flag, distinct."""
    t = Tables(spark, sf)
    r, n, c, o = t.region, t.nation, t.customer, t.orders
    # from the largest table up: its rows stay spread over tasks, the few nations and regions come to them
    return flatten_hierarchy(
        spread(o, "o_custkey"), [(c, F.col("o_custkey") == c.c_custkey), (n, c.c_nationkey == n.n_nationkey),
                                 (r, n.n_regionkey == r.r_regionkey)],
        fx.status_codes(spark), "o_orderstatus", "code", ["1-URGENT", "2-HIGH"], "audit_status",
        ["r_name", "n_name", "c_custkey", F.to_date("o_orderdate").alias("order_day"),
         F.col("o_orderstatus").alias("status"), "description"],
        flag_source="o_orderpriority")


@register("q_bridge_lookup", with_ctes(["periods", "reads"], """
SELECT r.id, r.ts, r.l_orderkey, r.l_linenumber, p.pk, c.c_name, n.n_name, g.r_name
FROM reads r
LEFT JOIN (SELECT id, pk FROM (
    SELECT id, pk, ROW_NUMBER() OVER (PARTITION BY id ORDER BY
      CASE WHEN end_date IS NULL THEN 1 ELSE 0 END DESC,
      COALESCE(end_date, DATE '9999-12-31') DESC,
      COALESCE(start_date, DATE '1900-01-01') DESC, pk DESC) rn
    FROM periods WHERE status <> 'P') x WHERE rn = 1) p ON p.id = r.id
LEFT JOIN customer c ON c.c_custkey = p.id AND c.c_acctbal > 0
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN region g ON g.r_regionkey = n.n_regionkey"""))
def q_bridge_lookup(spark, sf):
    """Readings -> preferred period per id -> customer (only with a positive
    balance, a filter inside the join) -> nation -> region, all left joins."""
    t = Tables(spark, sf)
    rd = fx.reads(t)
    per = preferred_row(fx.periods(t).filter(F.col("status") != "P"), ["id"], "start_date",
                        "end_date", [F.col("pk").desc()]).select(F.col("id").alias("p_id"), "pk")
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    g = t.region.select("r_regionkey", "r_name")
    out = join_chain(rd, [(per, rd.id == per.p_id),
                          (c, (c.c_custkey == per.p_id) & (c.c_acctbal > 0)),
                          (n, n.n_nationkey == c.c_nationkey),
                          (g, g.r_regionkey == n.n_regionkey)], how="left")
    return out.select("id", "ts", "l_orderkey", "l_linenumber", "pk", "c_name", "n_name", "r_name")


ADDRESS_SQL = """trim(array_to_string(list_filter(list_transform(
         [c_name, if(c_custkey % 7 = 0, '', c_mktsegment), if(c_custkey % 5 = 0, NULL, n_name), r_name],
         lambda part: trim(part)), lambda part: part <> ''), ', '))"""


def address_parts():
    """Address parts of a customer; one blank and one missing part on purpose."""
    return [F.col("c_name"),
            F.when(F.col("c_custkey") % 7 == 0, F.lit("   ")).otherwise(F.col("c_mktsegment")),
            F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.col("n_name")),
            F.col("r_name")]


@register("q_concat_parts", f"""
SELECT DISTINCT c_custkey, {ADDRESS_SQL} AS address
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def q_concat_parts(spark, sf):
    t = Tables(spark, sf)
    c, n, r = t.customer, t.nation, t.region
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return x.select("c_custkey", concat_parts(address_parts()).alias("address")).distinct()


# every reason says FALSE, so one that is true is enough; grouped by what they compare
_RF, _II = (f"(SELECT max(max_date) FROM intervals WHERE run = '{r}')" for r in ("RF", "II"))
AFFECTING_SQL = f"""NOT list_contains([
    -- never live within the settled days
    p.start_date > {_II}, p.end_date < {_RF}, p.disc_date < {_RF}, if(p.energ = 'D', p.deenerg_date < {_RF}, FALSE),
    -- no day between start and end
    p.end_date <= p.start_date, p.disc_date <= p.start_date, if(p.energ = 'D', p.deenerg_date <= p.start_date, FALSE),
    -- read up to the end
    c.cp_date >= least(p.end_date, p.disc_date), if(p.energ = 'D', c.cp_date >= p.deenerg_date, FALSE)], TRUE)"""


@register("q_rule_cascade", with_ctes(["rule_periods", "checkpoints", "intervals"], f"""
SELECT p.pk, p.id, {AFFECTING_SQL} AS affecting
FROM rule_periods p LEFT JOIN checkpoints c ON c.id = p.id"""))
def q_rule_cascade(spark, sf):
    """Ten ordered reasons a period does not affect settlement; first TRUE
    wins, NULL comparisons fall through, default TRUE."""
    t = Tables(spark, sf)
    p = fx.rule_periods(t).join(fx.checkpoints(t), "id", "left")
    out = affecting_flags(p, fx.intervals(t), "start_date", "end_date", "disc_date", "energ",
                          "deenerg_date", "cp_date")
    return out.select("pk", "id", "affecting")


# Contract-end boundaries (defer from, defer to, caution from,
# caution to, safe from).
DECISION_DAYS = ("2001-01-01", "2001-03-31", "2001-04-01", "2001-05-31", "2001-06-01")


#: the decision by how many of the days it starts a new one a contract has reached
DECISION_SQL = f"""if(contract_end IS NULL, 'manual', list_extract(['exclude', 'defer', 'caution', 'safe'],
         1 + len(list_filter([DATE '{DECISION_DAYS[0]}', DATE '{DECISION_DAYS[2]}', DATE '{DECISION_DAYS[4]}'], lambda day: day <= contract_end))))"""


@register("q_decision_dates", with_ctes(["contracts"], f"""
SELECT c_custkey, contract_end, {DECISION_SQL} AS decision FROM customer LEFT JOIN contracts ON id = c_custkey"""))
def q_decision_dates(spark, sf):
    """Contract-end date -> migration decision (date cascade, NULL first)."""
    t = Tables(spark, sf)
    c = t.customer.select("c_custkey").join(
        fx.contracts(t).withColumnRenamed("id", "c_custkey"), "c_custkey", "left")
    d = F.col("contract_end").cast("date")
    lo, hi, lo2, hi2, safe = (F.to_date(F.lit(x)) for x in DECISION_DAYS)
    rules = [(d.isNull(), "manual"), (d < lo, "exclude"), (d.between(lo, hi), "defer"),
             (d.between(lo2, hi2), "caution"), (d >= safe, "safe")]
    return c.select("c_custkey", "contract_end", first_match(rules, "unknown").alias("decision"))


def part_class(part):
    """Parts with a textual class code; every tenth size gets a non-numeric code."""
    return part.withColumn(
        "class_code", F.when(F.col("p_size") % 10 == 0, F.lit("n/a"))
        .otherwise(F.substring("p_brand", 7, 10)))


_PART_CLASS_SQL = """part_class AS (
  SELECT *, CASE WHEN p_size % 10 = 0 THEN 'n/a' ELSE substr(p_brand, 7, 10) END AS class_code
  FROM part)"""


@register("q_try_cast", with_ctes([], """
SELECT p_partkey, class_code, TRY_CAST(class_code AS BIGINT) AS class_num FROM part_class""",
                                  extra=[_PART_CLASS_SQL]))
def q_try_cast(spark, sf):
    p = part_class(Tables(spark, sf).part)
    return p.select("p_partkey", "class_code", F.col("class_code").try_cast("bigint").alias("class_num"))


@register("q_fallback_lookup", with_ctes([], """
SELECT p.p_partkey,
       CASE WHEN v.l_partkey IS NULL THEN d.default_volume ELSE v.volume END AS volume,
       CASE WHEN v.l_partkey IS NOT NULL THEN 'primary'
            WHEN d.default_volume IS NOT NULL THEN 'secondary' END AS volume_source
FROM part_class p
LEFT JOIN (SELECT l_partkey, SUM(l_quantity) FILTER (l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '2001-01-01 00:00:00') AS volume
           FROM lineitem GROUP BY l_partkey HAVING volume IS NOT NULL) v ON v.l_partkey = p.p_partkey
LEFT JOIN (SELECT TRY_CAST(substr(p_brand, 7, 10) AS BIGINT) AS class_num,
                  CAST(p_size // 10 AS BIGINT) AS size_band,
                  CAST(SUM(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS default_volume
           FROM part GROUP BY 1, 2) d
       ON TRY_CAST(p.class_code AS BIGINT) = d.class_num
      AND CAST(p.p_size // 10 AS BIGINT) = d.size_band
      AND v.l_partkey IS NULL""", extra=[_PART_CLASS_SQL]))
def q_fallback_lookup(spark, sf):
    """Primary volume (recent returned quantity) else a class default found
    through a try_cast composite key."""
    t = Tables(spark, sf)
    li = t.lineitem
    counted = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= ntz(dt.datetime(2001, 1, 1)))
    primary = (li.groupBy(F.col("l_partkey").alias("p_partkey"))
               .agg(F.sum(F.when(counted, F.col("l_quantity"))).alias("volume"))
               .filter(F.col("volume").isNotNull()))
    band = F.floor(F.col("p_size") / 10).cast("bigint")
    defaults = (t.part.groupBy(F.substring("p_brand", 7, 10).try_cast("bigint").alias("class_num"),
                               band.alias("size_band"))
                .agg((F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double")
                      / F.count(F.lit(1))).alias("default_volume")))
    p = part_class(t.part).select("p_partkey", "class_code", "p_size")
    out = fallback_lookup(p, primary, ["p_partkey"], "volume", defaults,
                          [(F.col("class_code").try_cast("bigint"), "class_num"),
                           (band, "size_band")], "default_volume", out="volume",
                          source="volume_source")
    return out.select("p_partkey", "volume", "volume_source")


@register("q_null_aware_anti", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey * 2 FROM orders)""")
def q_null_aware_anti(spark, sf):
    """Customers whose key is not twice that of any customer with an order,
    with SQL NOT IN semantics, against all orders."""
    t = Tables(spark, sf)
    lst = t.orders.select((F.col("o_custkey") * 2).alias("key"))
    return not_in(t.customer.select("c_custkey", "c_name"), "c_custkey", lst, "key")
