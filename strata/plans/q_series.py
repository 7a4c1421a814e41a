"""Queries: recent activity, seasonal sample, unpivot of period columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from strata.functions.columns import ntz
from strata.operators.series import seasonal_sample, unpivot_periods
from strata.plans import fixtures as fx
from strata.plans.registry import register
from strata.sources.tables import Tables


@register("q_recent_active", """
SELECT e.event_id, e.user_id, e.ts, e.value FROM events e
WHERE e.user_id IN (SELECT user_id FROM events
                    WHERE ts >= DATE '2024-01-30' AND event_type = 'purchase')
  AND e.ts >= DATE '2023-01-31' AND month(e.ts) IN (1, 4, 7, 10) AND day(e.ts) <= 7""")
def q_recent_active(spark, sf):
    """Events of users with a purchase in the last day before as_of, limited
    to the first week of Jan/Apr/Jul/Oct within the last year."""
    ev = Tables(spark, sf).events.select("event_id", "user_id", "ts", "value", "event_type")
    s = seasonal_sample(ev, "user_id", "ts", fx.EVENTS_AS_OF, recent_days=1,
                        active_filter=F.col("event_type") == "purchase")
    return s.select("event_id", "user_id", "ts", "value")


@register("q_seasonal_sample", """
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_totalprice FROM orders o
WHERE o.o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '2001-07-02')
  AND o.o_orderdate >= DATE '2000-08-01' AND month(o.o_orderdate) IN (1, 4, 7, 10)
  AND day(o.o_orderdate) <= 7""")
def q_seasonal_sample(spark, sf):
    """Orders of customers active in the last 30 days, first week of each
    quarter's first month, last 12 months."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return seasonal_sample(o, "o_custkey", "o_orderdate", fx.AS_OF, recent_days=30)


UNPIVOT_CUTOFF = fx.AS_OF.replace(day=1) - dt.timedelta(days=14)
PERIOD_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("q_unpivot", f"""
SELECT u.*, p.p_name FROM (
  {' UNION ALL '.join(
      f"SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, CAST({i} AS BIGINT) AS period, "
      f"CAST({c} AS DOUBLE) AS period_volume FROM lineitem "
      f"WHERE l_shipdate >= TIMESTAMP '{UNPIVOT_CUTOFF} 00:00:00'"
      for i, c in enumerate(PERIOD_COLS, start=1))}) u
LEFT JOIN part p ON p.p_partkey = u.l_partkey""")
def q_unpivot(spark, sf):
    """Four measure columns of recent line items to (period, value) rows,
    filtered early on the ship date, then a name lookup."""
    t = Tables(spark, sf)
    li = t.lineitem.filter(F.col("l_shipdate") >= ntz(dt.datetime.combine(UNPIVOT_CUTOFF, dt.time())))
    long = unpivot_periods(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"],
                           PERIOD_COLS, period="period", value="period_volume")
    p = t.part.select(F.col("p_partkey"), F.col("p_name"))
    return long.join(p, long.l_partkey == p.p_partkey, "left").drop("p_partkey")
