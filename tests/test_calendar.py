import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import calendar, ordered

START = datetime(2020, 1, 1)


def day(n):
    return START + timedelta(days=n)


def events_of(n, span, rng):
    rows = []
    for i in range(n):
        at = rng.randrange(span)
        rows.append((day(at).strftime("%Y-%m-%d"), f"E {i}", rng.choice(["trailer", "patch"]), day(at + rng.randrange(-30, 10)).strftime("%Y-%m-%d")))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_event_known_at_origin_equals_scan(spark, seed):
    rng = random.Random(seed)
    rows = events_of(rng.choice([1, 7, 40]), 200, rng)
    cal = calendar.prepare_calendar(spark.createDataFrame(rows, "event_date string, event_name string, event_type string, announced_date string"))
    pairs = sorted({(day(p), day(p + rng.randrange(60))) for p in (rng.randrange(-20, 230) for _ in range(150))})
    got = calendar.event_features(spark.createDataFrame(pairs, "p timestamp, o timestamp"), cal, "p", "o").collect()
    assert len(got) == len(pairs)
    for r in got:
        known = [(d, n) for d, n, _, a in rows if day(0).fromisoformat(d) <= r.p and day(0).fromisoformat(a) <= r.o]
        assert r.last_event_name == (max(known)[1] if known else calendar.PRE_EVENT)
    plain = calendar.event_features(spark.createDataFrame(pairs, "p timestamp, o timestamp"), cal, "p").collect()
    for r in plain:
        dated = [(d, n) for d, n, *_ in rows if day(0).fromisoformat(d) <= r.p]
        assert r.last_event_name == (max(dated)[1] if dated else calendar.PRE_EVENT)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_hold_no_nested_loops_and_scale(spark):
    """10,000 events and 10,000 periods, each with its own origin."""
    raw = spark.range(10_000).select(
        F.date_format(F.expr("timestamp'2000-01-01' + make_dt_interval(cast(id AS int), 5)"), "yyyy-MM-dd HH:mm:ss").alias("event_date"),
        F.concat(F.lit("e"), "id").alias("event_name"), F.lit("patch").alias("event_type"),
        F.date_format(F.expr("timestamp'2000-01-01' + make_dt_interval(cast(id - id % 17 AS int))"), "yyyy-MM-dd").alias("announced_date"))
    cal = calendar.prepare_calendar(raw)
    pairs = spark.range(10_000).select(F.expr("timestamp'2000-01-02' + make_dt_interval(cast(id AS int))").alias("p"),
                                       F.expr("timestamp'2000-01-02' + make_dt_interval(cast(id AS int))").alias("o"))
    out = calendar.event_features(pairs, cal, "p", "o")
    usable = calendar.event_usability(pairs, cal, "p")
    assert "NestedLoop" not in plan_of(out) + plan_of(usable) and "Cartesian" not in plan_of(out) + plan_of(usable)
    assert out.where("last_event_name = 'pre_announcement'").count() == 0
    assert usable.where("periods_before + periods_after <> 10000").count() == 0


def test_running_over_ranges_equals_one_pass(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.randrange(100), rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, v int, w int")
    got = {r.i: (r.total, r.peak) for r in ordered.running(df, ["k"], [F.asc("i")], {"total": "w"}, {"peak": "v"}).collect()}
    state = {"a": [0, -1], "b": [0, -1]}
    for k, i, v, w in rows:
        state[k] = [state[k][0] + w, max(state[k][1], v)]
        assert got[i] == tuple(state[k])
    numbers = {r.v: r.number for r in ordered.numbered_values(df, "v").collect()}
    assert numbers == {v: n for n, v in enumerate(sorted({r[2] for r in rows}))}


def test_empty_calendar(spark):
    cal = calendar.prepare_calendar(spark.createDataFrame([], "event_date string, event_name string"))
    periods = spark.createDataFrame([(day(1), day(2))], "p timestamp, o timestamp")
    for origin in (None, "o"):
        assert calendar.event_features(periods, cal, "p", origin).first().last_event_name == calendar.PRE_EVENT
    assert calendar.event_usability(periods, cal, "p").count() == 0
