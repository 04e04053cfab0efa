import math
import re

import pytest

from pulseframe.operators import media

CONSTANTS = {"sales_mean": 100.0, "week_mean": 5.0, "week_scale": 2.0, "price_mean": 3.0}


def test_outcome_of_draws_shuffles_no_period(spark):
    plan = spark.createDataFrame([(t, 10.0 + t, 4.0 * (t % 2), 3.0 + t % 3, float(t % 2), 1.0) for t in range(9)],
                                 "t int, a double, b double, price double, promotion double, event double")
    draws = [(k, c, 0.1 * (k % 5), 1.2, 0.7, 2.0 + k) for k in range(20) for c in "ab"]
    scale = spark.createDataFrame([("a", 14.0), ("b", 2.0)], "channel string, spend_scale double")
    effects = spark.createDataFrame([(k, 1.0 * k, 2.0, -0.5, 5.0, 3.0, 1.5, 0.5) for k in range(20)],
                                    "draw int, baseline double, trend double, price_coefficient double, promotion_coefficient double, event_coefficient double, "
                                    "season_sin double, season_cos double")
    frame = spark.createDataFrame(draws, "draw int, channel string, decay double, alpha double, theta double, beta double")
    out = media.expected_outcome(plan, media.media_by_draw(plan, ["a", "b"], frame, scale), effects, CONSTANTS)
    got = {(r.draw, r.t): r.expected for r in out.collect()}
    want = {}
    for k in range(20):
        carried = {"a": 0.0, "b": 0.0}
        for t, *spend, price, promotion, event in plan.collect():
            value = 100.0 + k + 2.0 * (t - 5) / 2 - 0.5 * (price - 3) + 5 * promotion + 3 * event
            value += 1.5 * math.sin(2 * math.pi * t / 52) + 0.5 * math.cos(2 * math.pi * t / 52)
            for c, x, s in zip("ab", spend, (14.0, 2.0)):
                carried[c] = x / s + 0.1 * (k % 5) * carried[c]
                a = (carried[c] * (1 - 0.1 * (k % 5))) ** 1.2
                value += (2.0 + k) * a / (a + 0.7**1.2)
            want[k, t] = value
    assert got == pytest.approx(want)
    # A draw's periods stay where the draw was dealt to: they are neither dealt again nor sorted.
    text = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(draw#\d+, t#", text) and not re.search(r"SortMergeJoin \[draw", text)
