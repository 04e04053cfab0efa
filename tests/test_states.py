import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from pulseframe.operators import backtest, calendar, forecasters, states

START = datetime(2020, 1, 6)


def series(spark, n, seed=1, names=("a", "b")):
    rng = random.Random(seed)
    rows = [(k, START + timedelta(weeks=i), round(50 + 10 * rng.random() + 5 * (i % 4), 3)) for k in names for i in range(n)]
    return spark.createDataFrame(rows, "k string, at timestamp, v double").repartition(3)


def events(spark):
    rows = [((START + timedelta(weeks=w, days=2)).strftime("%Y-%m-%d"), f"Event {w}", "trailer") for w in (5, 20, 33, 41, 43)]
    rows = [(*r, r[0]) for r in rows[:-1]] + [(*rows[-1], (START + timedelta(weeks=39)).strftime("%Y-%m-%d"))]
    return calendar.prepare_calendar(spark.createDataFrame(rows, "event_date string, event_name string, event_type string, announced_date string"))


def key(r):
    return r["k"], r["model"], r["horizon_step"]


@pytest.mark.parametrize("n", [41, 120])
def test_roll_forward_equals_the_backtest_of_the_last_origin(spark, n):
    """A series cut h periods earlier and rolled forward gives the backtest rows of that origin, for every model."""
    df, cal, h = series(spark, n), events(spark), 2
    cut = df.where(df["at"] < START + timedelta(weeks=n - h))
    made = states.fitted_states(cut, ["k"], "at", "v", calendar=cal)
    got = {key(r): (r["forecast"], r["lower"], r["upper"]) for r in states.roll_forward(made, ["k"], "at", h, calendar=cal).collect()}
    grid = dict(min_train=n - h, horizon=h, step=1)
    want = [backtest.backtest(df, ["k"], "at", "v", **grid), forecasters.smoothing_backtest(df, ["k"], "at", "v", **grid),
            forecasters.ridge_backtest(df, cal, ["k"], "at", "v", **grid)]
    want = {key(r): (r["forecast"], r["lower"], r["upper"]) for part in want for r in part.collect()}
    # The backtest looks at the whole history for a seasonal model, the state at what it has.
    assert {k for k in want if k[1] != "seasonal_naive"} == {k for k in got if k[1] != "seasonal_naive"}
    for k in want.keys() & got.keys():
        np.testing.assert_allclose(got[k], want[k], rtol=1e-9, atol=1e-9, err_msg=str(k))


def test_states_of_short_series(spark):
    df = series(spark, 9, names=("a",)).union(series(spark, 1, names=("one",))).union(series(spark, 20, names=("long",)))
    made = states.fitted_states(df, ["k"], "at", "v", calendar=events(spark))
    found = {(r.k, r.model) for r in made.collect()}
    simple = {"naive", "mean"}
    assert found == {(k, m) for k, ms in (("a", simple | {"exponential_smoothing"}), ("one", simple),
                                         ("long", simple | {"exponential_smoothing", "ridge_event"})) for m in ms}
    rows = states.roll_forward(made, ["k"], "at", 3, calendar=events(spark)).collect()
    assert len(rows) == 3 * len(found) and all(r.lower <= r.forecast <= r.upper for r in rows)
    assert {r["at"] for r in rows if r.k == "one"} == {START + timedelta(weeks=w) for w in (1, 2, 3)}


def test_selected_model_has_future_rows(spark):
    forecast = states.roll_forward(states.fitted_states(series(spark, 60), ["k"], "at", "v", calendar=events(spark)), ["k"], "at", calendar=events(spark))
    selection = spark.createDataFrame([("a", "ridge_event"), ("b", "exponential_smoothing")], "k string, selected string")
    got = states.selected_forecast(forecast, selection, ["k"]).collect()
    assert sorted((r.k, r.model, r.horizon_step) for r in got) == [("a", "ridge_event", i) for i in range(1, 5)] + [("b", "exponential_smoothing", i) for i in range(1, 5)]
