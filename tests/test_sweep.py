"""The sorted sweep, the stored history and the neighbour row against brute force, over ranges that cut groups anywhere."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strata.operators.history import EventHistory, describe_events
from strata.operators.ordered import with_next_in_group
from strata.operators.sweep import facts_in_period, sweep_periods

D0 = dt.date(2020, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def made(seed, n_events, n_periods, hot=0.5):
    rng = random.Random(seed)
    key = lambda: 7 if rng.random() < hot else rng.choice([1, 2, 3, None])
    events = [(key(), None if rng.random() < 0.05 else dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.choice([0, 12, 24]) + 24 * rng.randrange(60)),
               rng.choice("ab"), rng.choice([None, "x", "y"]), i) for i in range(n_events)]
    periods = []
    for pk in range(n_periods):
        lo = rng.randrange(-5, 60)
        periods.append((pk, key(), day(lo), None if rng.random() < 0.2 else day(lo + rng.choice([-1, 0, 1, 5, 30, 36_500]))))
    return events, periods


def brute(events, periods, as_of):
    out = {}
    for pk, key, lo, hi in periods:
        hi = as_of if hi is None else hi
        got = [e for e in events if key is not None and e[0] == key and e[1] is not None and dt.datetime.combine(lo, dt.time()) <= e[1] <= dt.datetime.combine(hi, dt.time())]
        out[pk] = (len(got), sum(e[3] is not None for e in got), max(((e[1], e[4]) for e in got), default=None))
    return out


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 3), (3, 16), (4, 40)])
def test_sweep_against_brute_force(spark, seed, parts):
    events, periods = made(seed, 400, 60)
    as_of = day(45)
    ev = spark.createDataFrame(events, "id long, ts timestamp_ntz, code string, note string, n long").repartition(3)
    per = spark.createDataFrame(periods, "pk long, id long, lo date, hi date")
    late = F.when(F.col("pk") % 4 != 0, F.date_add("lo", F.col("pk").cast("int") % 40))  # some beyond the end, some unknown
    got = sweep_periods(per, ev, "pk", "id", F.col("lo"), F.coalesce("hi", F.lit(as_of)), "ts", ["n"], ["note"], since=late, num_partitions=parts).collect()
    found = {r.pk: (r.n, r.n_whole, tuple(r.latest) if r.latest else None) for r in got}
    want = brute(events, periods, as_of)
    since = brute(events, [(pk, k, lo + dt.timedelta(pk % 40 if pk % 4 else 0), hi) for pk, k, lo, hi in periods], as_of)
    assert all(r.n_since == since[r.pk][0] for r in got)
    for pk, w in want.items():
        assert found.get(pk, (0, 0, None)) == w, pk
    counts = facts_in_period(per, ev, "pk", "id", F.col("lo"), F.coalesce("hi", F.lit(as_of)), "ts", {"n": "c"}, event_filter=F.col("code") == "a")
    want = brute([e for e in events if e[2] == "a"], periods, as_of)
    assert {r.pk: r.c for r in counts.collect()} == {pk: w[0] for pk, w in want.items()}


def test_sweep_of_text_keys_and_empty_sides(spark):
    ev = spark.createDataFrame([("k", dt.datetime(2020, 1, 5))], "id string, ts timestamp_ntz")
    per = spark.createDataFrame([(1, "k", day(0), day(9)), (2, "j", day(0), day(9))], "pk int, id string, lo date, hi date")
    got = sweep_periods(per, ev, "pk", "id", F.col("lo"), F.col("hi"), "ts").collect()
    assert sorted((r.pk, r.n) for r in got) == [(1, 1), (2, 0)]
    assert sweep_periods(per, ev.limit(0), "pk", "id", F.col("lo"), F.col("hi"), "ts").where("n > 0").count() == 0
    assert sweep_periods(per.limit(0), ev, "pk", "id", F.col("lo"), F.col("hi"), "ts").count() == 0


@pytest.mark.parametrize("cell_rows", [3, 1000])
def test_history_against_brute_force(spark, cell_rows):
    events, periods = made(9, 500, 50)
    as_of = day(45)
    ev = spark.createDataFrame(events, "id long, ts timestamp_ntz, code string, note string, n long")
    history = EventHistory.store(ev, "id", "ts", bin_days=7, buckets=5, cell_rows=cell_rows)
    try:
        assert (history.hot.count() > 0) == (cell_rows == 3)
        per = spark.createDataFrame(periods, "pk long, pid long, lo date, hi date")
        got = history.facts(per, "pk", "pid", "lo", "hi", as_of, since=F.date_add("lo", 3), order=["n"])
        found = {r.pk: (r.events_since_start, r.events_since_checkpoint, tuple(r.latest)) for r in got.collect()}
        late = brute(events, [(pk, k, lo + dt.timedelta(3), hi) for pk, k, lo, hi in periods], as_of)
        for pk, (n, _, latest) in brute(events, periods, as_of).items():
            assert found.get(pk, (0, 0, None)) == (n, late[pk][0], latest)
    finally:
        history.drop()


def test_joins_to_the_history_do_not_exchange_it(spark):
    events, periods = made(5, 300, 40)
    history = EventHistory.store(spark.createDataFrame(events, "id long, ts timestamp_ntz, code string, note string, n long"), "id", "ts", buckets=16)
    per = spark.createDataFrame(periods, "pk long, pid long, lo date, hi date")
    joins = [history.pairs(per, "pid", F.col("lo"), F.coalesce("hi", F.lit(day(40)))).groupBy("pk").count(),
             history.pairs(per, "pid", F.date_add("lo", 9), F.coalesce("hi", F.lit(day(40)))).groupBy("pk").count(),
             history.facts(per, "pk", "pid", "lo", "hi", day(40), since=F.col("lo"), order=["n"])]
    for df in joins:
        plan = df._jdf.queryExecution().executedPlan().toString()
        scan = plan[:plan.index(f"FileScan parquet spark_catalog.default.{history.name}")].splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        # the lines above the scan that are its ancestors, up to the join
        above, at = [], 10**9
        for line in reversed([*scan[:-1]]):
            if depth(line) < at:
                at = depth(line)
                above.append(line)
                if "SortMergeJoin" in line:
                    break
        assert "SortMergeJoin" in above[-1] and not any("Exchange" in x for x in above), plan
    history.drop()


def test_described_events_drop_unknown_codes_and_repeats(spark):
    ev = spark.createDataFrame([(1, "a"), (1, "a"), (1, "q"), (2, "b"), (3, None)], "id long, code string")
    codes = spark.createDataFrame([("a", "first"), ("b", "second"), ("a", "first")], "code string, description string")
    got = describe_events(ev, codes, "code", "code", "description", ["b"])
    assert sorted(map(tuple, got.collect())) == [(1, "a", "first", "Auditable"), (2, "b", "second", "Non-Auditable")]


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_neighbour_row_over_ranges(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), i, rng.choice([None, 1.5, 2.5])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, n long, v double").repartition(5)
    got = with_next_in_group(df, ["g"], [F.col("n")], ["n", "v"], num_partitions=parts)
    assert got.columns == ["g", "n", "v", "next_n", "next_v"]
    want = []
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        want += [(*a, *(b[1:] if b else (None, None))) for a, b in zip(own, [*own[1:], None], strict=True)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert with_next_in_group(df.limit(0), ["g"], [F.col("n")], ["v"]).collect() == []
    whole = with_next_in_group(df, [], [F.col("n")], ["n"], num_partitions=parts).collect()
    assert sorted((r.n, r.next_n) for r in whole if r.next_n is not None) == [(i, i + 1) for i in range(199)]
