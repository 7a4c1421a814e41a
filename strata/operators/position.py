"""Settlement-position style operators: affecting flags, priority score and
rank, and the wide position table that joins them all per validity period."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.columns import first_match, later_of, safe_ratio
from strata.operators.history import EventHistory
from strata.operators.intervals import bucket_by_interval
from strata.operators.lookups import LookupReport, checked_lookup
from strata.operators.ordered import spread, with_rank, with_row_number
from strata.operators.rows import fallback_lookup
from strata.operators.sweep import sweep_periods
from strata.session import materialize


def run_max(intervals: DataFrame, run: str) -> Column:
    """Scalar subquery: the last settled day of ``run``."""
    return intervals.filter(F.col("run") == run).agg(F.max("max_date")).scalar()


def affecting_rules(start: str, end: str, disc: str, energ: str, deenerg: str, cp: str,
                    first_max: Column, final_max: Column) -> list[tuple[Column, bool]]:
    """The ordered reasons a period cannot affect settlement (each -> FALSE).

    ``first_max``: last day of the most recent run; ``final_max``: last day of
    the final run. A NULL comparison falls through to the next rule.
    """
    s, e, d, en, de, c = (F.col(x) for x in (start, end, disc, energ, deenerg, cp))
    dead = en == F.lit("D")
    return [
        (s > first_max, False),     # starts after the most recent run
        (e < final_max, False),     # ended before the final run
        (d < final_max, False),     # disconnected before the final run
        (dead & (de < final_max), False),
        (s >= e, False),            # withdrawn: start on/after end
        (s >= d, False),            # disconnected before it started
        (c >= e, False),            # read up to the end already
        (c >= d, False),            # read up to disconnection already
        (dead & (c >= de), False),  # read up to de-energisation already
        (dead & (de <= s), False),  # de-energised before it started
    ]


def affecting_flags(df: DataFrame, intervals: DataFrame, start: str, end: str, disc: str,
                    energ: str, deenerg: str, cp: str, out: str = "affecting",
                    first_run: str = "II", final_run: str = "RF") -> DataFrame:
    rules = affecting_rules(start, end, disc, energ, deenerg, cp,
                            run_max(intervals, first_run), run_max(intervals, final_run))
    return df.withColumn(out, first_match(rules, True))


# Run weights of the priority score (run -> factor applied to
# volume x elapsed share; the final run uses volume x 5 without the share).
RUN_WEIGHTS = {"R3": 1.0, "R1": 0.5, "R2": 0.5, "SF": 0.5, "II": 0.1}
FINAL_RUN_FACTOR = 5


def priority_score(volume: str, run: str, affecting: str, cp: str, start: str,
                   final_max: Column, as_of: dt.date, final_run: str = "RF") -> Column:
    """volume x 5 for the final run; otherwise volume x elapsed share x run
    weight, where elapsed share = days since the last read (or start) / days
    since the final run's last day. 0 when not affecting or run unknown."""
    today = F.lit(as_of)
    share = safe_ratio(F.datediff(today, F.coalesce(F.col(cp), F.col(start))),
                       F.datediff(today, final_max))
    v = F.col(volume)
    by_run = [(F.col(run) == final_run, v * FINAL_RUN_FACTOR)]
    for r, w in RUN_WEIGHTS.items():
        term = v * share if w == 1.0 else v * share * w
        by_run.append((F.col(run) == r, term))
    scored = first_match(by_run, F.lit(0.0))
    return F.when(F.col(affecting) == F.lit(True), scored).otherwise(F.lit(0.0))


def priority_rank(df: DataFrame, partition: Sequence[str], score: str, tiebreak: Sequence[str],
                  out: str = "rank") -> DataFrame:
    """``RANK() OVER (PARTITION BY partition ORDER BY score DESC)`` computed
    without putting a whole partition (an area of the grid) into one task."""
    return with_rank(df, partition, [F.col(score).desc_nulls_last()], [score],
                     [F.col(c).asc() for c in tiebreak], out=out)


def classed_periods(periods: DataFrame, checkpoints: DataFrame, volumes: DataFrame, defaults: DataFrame, customers: DataFrame,
                    intervals: DataFrame, as_of: dt.date) -> DataFrame:
    """Valid periods with their last valid day, customer, volume, run and flags; inputs as for :func:`build_position`."""
    base = periods.filter(F.col("status").isin("O", "F")
                          & ((F.col("start_date") < F.col("end_date"))
                             | F.col("end_date").isNull()))
    base = spread(base, "id").withColumn("current_supplier", F.col("end_date").isNull() | (F.col("end_date") >= F.lit(as_of)))
    base = base.join(checkpoints, "id", "left")
    base = base.withColumn("last_valid_date", later_of("cp_date", "start_date"))
    base = base.join(customers, "id", "left")
    base = fallback_lookup(base, volumes, ["id"], "annual_volume", F.broadcast(defaults),
                           [(F.col("class_code").try_cast("bigint"), "class_num"),
                            (F.col("segment"), "segment")], "default_annual_volume", out="volume",
                           source="volume_source")
    base = bucket_by_interval(base, "last_valid_date", intervals, label="run", salt=1)
    return affecting_flags(base, intervals, "start_date", "end_date", "disc_date", "energ",
                           "deenerg_date", "cp_date")


def build_position(periods: DataFrame, reads: DataFrame, checkpoints: DataFrame,
                   volumes: DataFrame, defaults: DataFrame, customers: DataFrame,
                   intervals: DataFrame, as_of: dt.date, keep_event: Column | None) -> DataFrame:
    """Wide position table, one row per valid period (see ``q_position``).

    Inputs (already renamed to these columns):
      periods(pk, id, start_date, end_date, status, disc_date, energ, deenerg_date)
      reads(id, ts, code, note, l_orderkey, l_linenumber)
      checkpoints(id, cp_date) one row per id
      volumes(id, annual_volume) primary volume, one row per id
      defaults(class_num, segment, default_annual_volume) fallback volume
      customers(id, class_code, segment, cust_name, area, handler, address)
    Periods that are filtered out still contribute nothing; every join to a
    per-period or per-id table is on a unique key, so nothing fans out. Events
    are swept once for both counts and the latest one.
    """
    base = classed_periods(periods, checkpoints, volumes, defaults, customers, intervals, as_of)
    kept = reads if keep_event is None else reads.filter(keep_event)
    facts = sweep_periods(base.select("pk", "id", "start_date", "end_date", "last_valid_date"), kept, "pk", "id", F.col("start_date"),
                          F.coalesce("end_date", F.lit(as_of)), "ts", ["l_orderkey", "l_linenumber", "code", "note"], since=F.col("last_valid_date"))
    facts = facts.select("pk", F.col("n").alias("count_since_start"), F.col("n_since").alias("count_since_checkpoint"),
                         F.col("latest.ts").alias("latest_read_ts"),
                         F.col("latest.code").alias("latest_read_code"),
                         F.col("latest.note").alias("latest_read_note"))
    pos = spread(base, "pk").join(spread(facts, "pk"), "pk", "left")
    for c in ("count_since_start", "count_since_checkpoint"):
        pos = pos.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return with_priority(pos, intervals, as_of)


def position_base(periods: DataFrame, details: DataFrame, checkpoints: DataFrame, volumes: DataFrame, defaults: DataFrame,
                  customers: DataFrame, exports: DataFrame, meters: DataFrame, handlers: DataFrame, intervals: DataFrame,
                  as_of: dt.date, reports: dict[str, LookupReport] | None = None) -> DataFrame:
    """All that a valid period is and belongs to, without its events and ranks.

    Inputs, under these names:
      periods(pk, id, start_date, end_date, status, disc_date, energ, deenerg_date), pk unique
      details(pk, distributor, line_class, profile_class, config_id, area, postcode, service_flag)
      checkpoints(id, cp_date)
      volumes(id, annual_volume), defaults(class_num, config_id, area, default_annual_volume): decimals
      customers(id, customer_type, customer_name, customer_number, address)
      exports(participant, class_id, export_indicator, priority): the row of the smallest priority counts
      meters(link, meter_type, seen, line): the latest row of a link counts
      handlers(area, handler): one row per area, checked
    Every lookup states its rule for repeated keys (:mod:`strata.operators.lookups`),
    so a period is one row. ``reports`` takes a :class:`LookupReport` by lookup name.
    The volume is rounded to 2 places. Filters on the result that need no volume
    reach the periods below the lookups.
    """
    report = (reports or {}).get
    base = periods.filter(F.col("status").isin("O", "F") & ((F.col("start_date") < F.col("end_date")) | F.col("end_date").isNull()))
    own = ["distributor", "line_class", "profile_class", "config_id", "area", "postcode", "service_flag"]
    base = checked_lookup(spread(base, "pk"), spread(details, "pk"), [("pk", "pk")], {c: c for c in own}, name="period details", report=report("details"))
    base = checked_lookup(base, exports, [("distributor", "participant"), ("line_class", "class_id")], {"export_indicator": "export_indicator"},
                          rule="first", order=["priority"], name="export flags", report=report("exports"), few=True)
    base = checked_lookup(base, meters, [("pk", "link")], {"meter_type": "meter_type"}, rule="last", order=["seen", "line"], name="meters", report=report("meters"))
    base = checked_lookup(base, handlers, [("area", "area")], {"handler": "handler"}, name="handlers", report=report("handlers"), few=True)
    base = spread(base, "id").withColumn("current_supplier", F.col("end_date").isNull() | (F.col("end_date") >= F.lit(as_of)))
    base = checked_lookup(base, checkpoints, [("id", "id")], {"cp_date": "cp_date"}, rule="last", name="checkpoints", report=report("checkpoints"))
    base = base.withColumn("last_valid_date", later_of("cp_date", "start_date"))
    base = bucket_by_interval(base, "last_valid_date", intervals, label="run", salt=1)
    base = affecting_flags(base, intervals, "start_date", "end_date", "disc_date", "energ", "deenerg_date", "cp_date")
    who = ["customer_type", "customer_name", "customer_number", "address"]
    base = checked_lookup(base, customers, [("id", "id")], {c: c for c in who}, name="customers", report=report("customers"))
    base = checked_lookup(base, volumes, [("id", "id")], {"annual_volume": "annual_volume"}, found="__own", name="volumes", report=report("volumes"))
    # a default only where the id has no volume of its own: a null key matches nothing
    missing = lambda c: F.when(~F.col("__own"), c)
    base = checked_lookup(base, defaults, [(missing(F.col("profile_class").try_cast("bigint")), "class_num"), ("config_id", "config_id"), ("area", "area")],
                          {"default_annual_volume": "default_annual_volume"}, rule="first", name="default volumes", report=report("defaults"), few=True)
    volume = F.round(F.when(F.col("__own"), F.col("annual_volume")).otherwise(F.col("default_annual_volume")), 2)
    return base.withColumn("volume", volume.cast("double")).drop("__own", "annual_volume", "default_annual_volume")


def with_event_facts(base: DataFrame, history: EventHistory, as_of: dt.date, order: Sequence[str], keep_event: Column | None) -> DataFrame:
    """``base`` with each period's event counts and its latest event: time, code, description, note, audit flag.
    One join to the stored history; periods without events have counts of 0."""
    payload = ["code", "note", "description", "audit_status"]
    facts = history.facts(base, "pk", "id", "start_date", "end_date", as_of, since=F.col("last_valid_date"), order=[*order, *payload], event_filter=keep_event)
    facts = facts.select("pk", "events_since_start", "events_since_checkpoint", F.col(f"latest.{history.ts}").alias("event_ts"),
                         *[F.col(f"latest.{c}").alias(n) for c, n in (("code", "event_code"), ("description", "event_description"),
                                                                      ("note", "event_note"), ("audit_status", "audit_status"))])
    out = spread(base, "pk").join(spread(facts, "pk"), "pk", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("events_since_start", "events_since_checkpoint")})


def with_priority(base: DataFrame, intervals: DataFrame, as_of: dt.date) -> DataFrame:
    """``base`` with its score, the rank of the score per handler and the number of the period per id (latest first).
    Only keys and order columns go through the two ordered steps."""
    scored = base.withColumn("score", priority_score("volume", "run", "affecting", "cp_date", "start_date", run_max(intervals, "RF"), as_of))
    scored = materialize(scored)
    ranked = priority_rank(scored.select("pk", "handler", "score"), ["handler"], "score", ["pk"], out="priority_rank").select("pk", "priority_rank")
    numbered = with_row_number(scored.select("pk", "id", "start_date"), ["id"], [F.col("start_date").desc(), F.col("pk").desc()], out="period_rank")
    return spread(scored, "pk").join(ranked, "pk").join(numbered.select("pk", "period_rank"), "pk")


def drill_down(pos: DataFrame, day: dt.date, customer: str, meter_type: str, customer_type: str, final_run: str = "RF") -> DataFrame:
    """Rows of one customer, meter type and customer type that affect settlement, are known not
    to export (null is not FALSE), are not in the final run and are live on ``day``."""
    d = F.lit(day)
    return pos.filter((F.col("customer_name") == customer) & (F.col("meter_type") == meter_type) & (F.col("customer_type") == customer_type)
                      & F.col("affecting") & ~F.col("export_indicator") & (F.col("run") != final_run)
                      & (F.col("start_date") <= d) & ((F.col("end_date") >= d) | F.col("end_date").isNull()))


def position_filter(pos: DataFrame, day: dt.date, segment: str, handler_not: str) -> DataFrame:
    """Drill-down: affecting, current on ``day``, one segment, excluding one
    handler's final-run rows (plain predicates on the finished table)."""
    d = F.lit(day)
    return pos.filter((F.col("segment") == segment) & (F.col("affecting") == True)  # noqa: E712
                      & (F.col("run") != "RF") & (F.col("handler") != handler_not)
                      & (F.col("start_date") <= d)
                      & ((F.col("end_date") >= d) | F.col("end_date").isNull()))
