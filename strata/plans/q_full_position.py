"""Queries: the complete position table with checked lookups and the stored event
history, its duplicate-collapsing form and the drill-down on its stored layout."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.lookups import LookupReport, checked_lookup, collapse_rows
from strata.operators.position import drill_down, position_base, with_event_facts, with_priority
from strata.plans import fixtures as fx
from strata.plans.oracle_fixtures import AS_OF, with_ctes
from strata.plans.q_intervals import EXCLUSION_SQL, keep_reading
from strata.plans.q_position import _score_sql
from strata.plans.q_rows import AFFECTING_SQL
from strata.plans.registry import register
from strata.session import materialize
from strata.sources.layout import read_layout, write_layout
from strata.sources.tables import Tables

BASE_COLUMNS = ["pk", "id", "start_date", "end_date", "last_valid_date", "profile_class", "config_id", "area", "handler", "run",
                "affecting", "export_indicator", "current_supplier", "meter_type", "customer_type", "customer_name", "customer_number",
                "address", "postcode", "service_flag", "volume"]
FULL_COLUMNS = [*BASE_COLUMNS, "event_ts", "event_code", "event_description", "event_note", "audit_status", "events_since_start",
                "events_since_checkpoint", "score", "priority_rank", "period_rank"]


def full_base(t: Tables, reports: dict[str, LookupReport] | None = None) -> DataFrame:
    per = fx.rule_periods(t).drop("priority")
    return position_base(per, fx.details(t), fx.checkpoints(t), fx.own_volumes(t), fx.default_volumes(t), fx.account_holders(t), fx.exports(t),
                         fx.meters(t), fx.handlers(t), fx.intervals(t), fx.AS_OF, reports)


def full_position(t: Tables) -> DataFrame:
    base = with_event_facts(materialize(full_base(t)), fx.event_history(t), fx.AS_OF, ["l_orderkey", "l_linenumber"], keep_reading())
    return with_priority(base, fx.intervals(t), fx.AS_OF).select(*FULL_COLUMNS)


BASE_FIXTURES = ["rule_periods", "checkpoints", "intervals", "lookups"]
BASE_CTES = [f"""full_base AS (
  SELECT p.pk, p.id, p.start_date, p.end_date, greatest(c.cp_date, p.start_date) AS last_valid_date, d.profile_class, d.config_id, d.area, handler,
         i.run, {AFFECTING_SQL} AS affecting, export_indicator, coalesce(p.end_date, DATE '9999-12-31') >= {AS_OF} AS current_supplier, meter_type,
         customer_type, customer_name, customer_number, address, postcode, service_flag, c.cp_date,
         if(o.id IS NULL, f.v, round(o.v, 2)::DOUBLE) AS volume
  FROM rule_periods p
  JOIN details d USING (pk)
  LEFT JOIN checkpoints c ON c.id = p.id
  LEFT JOIN intervals i ON greatest(c.cp_date, p.start_date) BETWEEN i.min_date AND i.max_date
  LEFT JOIN exports x ON x.participant = d.distributor AND x.class_id = d.line_class
  LEFT JOIN meters m ON m.link = p.pk
  LEFT JOIN handlers h ON h.area = d.area
  LEFT JOIN holders u ON u.id = p.id
  LEFT JOIN own_volumes o ON o.id = p.id
  LEFT JOIN default_volumes f ON o.id IS NULL AND f.profile_class = d.profile_class AND f.config_id = d.config_id
  WHERE p.status <> 'P' AND coalesce(p.start_date < p.end_date, TRUE))"""]
FULL_FIXTURES = [*BASE_FIXTURES, "events_described"]
FULL_CTES = [*BASE_CTES, f"""seen AS (
  SELECT b.pk, count(*) AS events_since_start, count_if(r.ts >= b.last_valid_date) AS events_since_checkpoint,
         max(row(r.ts, r.l_orderkey, r.l_linenumber, r.code, coalesce(r.note, ''), r.description, r.audit_status, r.note)) AS e
  FROM full_base b JOIN events_described r ON r.id = b.id AND r.ts BETWEEN b.start_date AND coalesce(b.end_date, {AS_OF}) AND {EXCLUSION_SQL}
  GROUP BY b.pk),
full_scored AS (
  SELECT b.*, e[1] AS event_ts, e[4] AS event_code, e[6] AS event_description, e[8] AS event_note, e[7] AS audit_status,
         coalesce(events_since_start, 0) AS events_since_start, coalesce(events_since_checkpoint, 0) AS events_since_checkpoint,
         {_score_sql('b.volume', 'b.run', 'b.affecting', 'b.cp_date', 'b.start_date')} AS score
  FROM full_base b LEFT JOIN seen USING (pk)),
full_position AS (
  SELECT *, rank() OVER (PARTITION BY handler ORDER BY score DESC NULLS LAST) AS priority_rank,
         row_number() OVER (PARTITION BY id ORDER BY start_date DESC, pk DESC) AS period_rank
  FROM full_scored)"""]


@register("q_position_full", with_ctes(FULL_FIXTURES, f"SELECT {', '.join(FULL_COLUMNS)} FROM full_position", extra=FULL_CTES))
def q_position_full(spark, sf):
    """Every valid period with all it belongs to (checked lookups of export flag, meter, handler, customer, volume to 2 places),
    its latest event with description and audit flag, counts, score and ranks."""
    return full_position(Tables(spark, sf))


def collapsed(t: Tables) -> DataFrame:
    """Periods joined to lookups whose keys repeat (all rows kept), collapsed to distinct rows; one quantity survives of each."""
    per = fx.periods(t).select("pk", "id", "start_date", "end_date")
    per = checked_lookup(per, fx.details(t), [("pk", "pk")], {c: c for c in ("distributor", "line_class")}, name="period details")
    out = checked_lookup(per, fx.exports(t), [("distributor", "participant"), ("line_class", "class_id")], {"export_indicator": "export_indicator"}, rule="all")
    lines = t.lineitem.select("l_orderkey", "l_returnflag", "l_quantity", F.md5(F.concat_ws("|", "l_partkey", "l_suppkey", "l_linenumber")).alias("tag"))
    out = checked_lookup(out, lines, [("pk", "l_orderkey")], {"meter_type": "l_returnflag", "quantity": "l_quantity", "tag": "tag"}, rule="all")
    return collapse_rows(out, {"quantity": ["tag"]}, drop=["tag"])


@register("q_position_collapse", """
WITH fanned AS (
  SELECT o_orderkey AS pk, o_custkey AS id, o_orderdate::DATE AS start_date,
         lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) AS end_date FROM orders),
flags AS (
  SELECT p_brand, p_size % 10 + 1 AS class_id, CASE WHEN p_type <> 'PROMO' THEN p_type = 'ECONOMY' END AS export_indicator FROM part)
SELECT pk, id, start_date, end_date, 'Brand#' || (pk % 25 + 1) AS distributor, (id % 10 + 1)::INT AS line_class, export_indicator, l_returnflag AS meter_type,
       arg_min(l_quantity, row(md5(l_partkey || '|' || l_suppkey || '|' || l_linenumber), l_quantity)) AS quantity
FROM fanned
LEFT JOIN flags ON p_brand = 'Brand#' || (pk % 25 + 1) AND class_id = id % 10 + 1
LEFT JOIN lineitem ON l_orderkey = pk
GROUP BY ALL""")
def q_position_collapse(spark, sf):
    """A wide GROUP BY as removal of duplicates: rows fanned out by two lookups, one per distinct set of values."""
    return collapsed(Tables(spark, sf))


DRILL_DAY = dt.date(2000, 7, 7)
DRILL = {"customer": "NATION_18", "meter_type": "R", "customer_type": "Commercial"}


def stored_position(t: Tables) -> str:
    """The position table as it is kept for drill-down: a folder per export flag and run, sorted by customer and start."""
    return t.memo("stored_position", lambda: write_layout(full_position(t), partition_by=["export_indicator", "run"],
                                                          sort_by=["customer_name", "meter_type", "start_date", "pk"]))


@register("q_position_drilldown", with_ctes(FULL_FIXTURES, f"""
SELECT {', '.join(FULL_COLUMNS)} FROM full_position
WHERE customer_name = '{DRILL["customer"]}' AND meter_type = '{DRILL["meter_type"]}' AND customer_type = '{DRILL["customer_type"]}'
  AND affecting AND export_indicator IS FALSE AND run NOT IN ('RF')
  AND DATE '{DRILL_DAY}' BETWEEN start_date AND coalesce(end_date, DATE '9999-12-31')""", extra=FULL_CTES))
def q_position_drilldown(spark, sf):
    """One customer's live, affecting, non-exporting periods outside the final run, from the stored position table:
    folders are pruned by flag and run, files by the statistics of their sort columns."""
    stored = read_layout(spark, stored_position(Tables(spark, sf)))
    return drill_down(stored, DRILL_DAY, **DRILL).select(*FULL_COLUMNS)
