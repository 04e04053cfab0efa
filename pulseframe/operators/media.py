"""Media plans, carry-over, response and plan scenarios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pulseframe.functions import scoring
from pulseframe.operators.draws import quantile
from pulseframe.session import by_key, keyed

# --- fixed values -------------------------------------------------------------
SPEND_TOLERANCE = 1.25
PRICE_LOW, PRICE_HIGH = 0.8, 1.2
PRICE_FLOOR = 0.01
CURVE_POINTS = 25
CURVE_REACH = 1.2
UNDER_ATTRIBUTED = 0.85
RANK_CORRELATION = 0.5
SEASON = 52.0
SYNTHETIC = "synthetic"

#: Tasks over which draws are spread at least; copies of a channel's response levels, so that a few channels are many join keys.
SALTS = 64


def require_data_type(df: DataFrame, expected: str = SYNTHETIC) -> DataFrame:
    """Refuse a plan whose rows are not all of the expected kind."""
    if "data_type" not in df.columns:
        raise ValueError("a plan needs a data_type column")
    if df.filter(F.coalesce(F.col("data_type"), F.lit("")) != expected).limit(1).count():
        raise ValueError(f"the plan holds rows that are not {expected}")
    return df


def plan_long(plan: DataFrame, keys: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Plan rows per channel."""
    wide = plan.select(*keys, *[F.col(c).cast("double").alias(c) for c in channels])
    return wide.unpivot(list(keys), list(channels), "channel", "spend")


@F.pandas_udf(ArrayType(DoubleType()))
def _carry(spends: pd.Series, decay: pd.Series) -> pd.Series:
    """Exact carry-over ``a_t = x_t + d * a_(t-1)`` over ordered arrays; one step per period."""
    out = []
    for x, d in zip(spends, decay):
        carried, last = [], 0.0
        for v in x:
            last = v + d * last
            carried.append(last)
        out.append(carried)
    return pd.Series(out, dtype=object)


def adstock(
    long: DataFrame, series_cols: Sequence[str], order_col: str, decay: Column, value: str = "spend", normalise: bool = False, name: str = "adstock"
) -> DataFrame:
    """Geometric carry-over per series; decay in [0, 1), spend not negative.

    A group is one series of one channel, bounded by its number of periods.
    """
    fine = (decay >= 0) & (decay < 1)
    checked = F.when(fine, decay).otherwise(F.raise_error(F.lit("decay must be in [0, 1)")).cast("double"))
    spend = F.when(F.col(value) >= 0, F.col(value)).otherwise(F.raise_error(F.lit("spend cannot be negative")).cast("double"))
    items = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("t"), spend.cast("double").alias("x"))))
    grouped = long.withColumn("_d", checked).groupBy(*series_cols, "_d").agg(items.alias("_items"))
    carried = grouped.withColumn("_a", _carry(F.col("_items.x"), F.col("_d")))
    scale = F.lit(1.0) - F.col("_d") if normalise else F.lit(1.0)
    zipped = F.arrays_zip(F.col("_items.t").alias("t"), F.col("_items.x").alias("x"), F.col("_a").alias("a"))
    return carried.select(*series_cols, "_d", F.inline(zipped)).select(
        *series_cols, F.col("t").alias(order_col), F.col("x").alias(value), (F.col("a") * scale).alias(name)
    )


def response(long: DataFrame, series_cols: Sequence[str], order_col: str, decay: Column, alpha: Column, theta: Column) -> DataFrame:
    """Normalised carry-over followed by saturation; ``alpha`` and ``theta`` belong to the series key."""
    kept = long.withColumns({"_alpha": alpha, "_theta": theta})
    out = adstock(kept, [*series_cols, "_alpha", "_theta"], order_col, decay, normalise=True)
    return out.withColumn("response", scoring.hill(F.col("adstock"), F.col("_alpha"), F.col("_theta"))).drop("_alpha", "_theta")


@dataclass(frozen=True)
class PlanScenario:
    """Edit of a media plan."""

    budget_changes: Mapping[str, float] = field(default_factory=dict)
    reallocations: Sequence[tuple[str, str, float]] = ()
    price_change: float = 0.0
    promotion: bool | None = None
    event: bool | None = None
    label: str = "scenario"

    def validate(self, channels: Sequence[str]) -> None:
        named = [*self.budget_changes, *[c for move in self.reallocations for c in move[:2]]]
        unknown = sorted(set(named) - set(channels))
        if unknown:
            raise ValueError(f"Unknown channels {unknown}; known channels: {list(channels)}")
        if any(m < 0 for m in self.budget_changes.values()):
            raise ValueError("Budget multipliers cannot be negative")
        for source, target, share in self.reallocations:
            if source == target:
                raise ValueError("A reallocation needs two different channels")
            if not 0 < share < 1:
                raise ValueError("Reallocation fraction must be between 0 and 1")


def reallocation(source: str, target: str, share: float) -> PlanScenario:
    """Move a share of one channel's budget into another, budget-neutral."""
    if not 0 < share < 1:
        raise ValueError("fraction must be between 0 and 1")
    return PlanScenario(reallocations=((source, target, share),), label=f"move_{int(share * 100)}pct_{source}_to_{target}")


def apply_scenario(plan: DataFrame, scenario: PlanScenario, channels: Sequence[str]) -> DataFrame:
    """L4: multipliers first, then transfers in order, then price, promotion and event."""
    scenario.validate(channels)
    spend = {c: F.col(c).cast("double") * F.lit(float(scenario.budget_changes.get(c, 1.0))) for c in channels}
    for source, target, share in scenario.reallocations:
        moved = spend[source] * F.lit(float(share))
        spend[target] = spend[target] + moved
        spend[source] = spend[source] - moved
    changes = dict(spend)
    if scenario.price_change:
        changes["price"] = F.greatest(F.col("price") + F.lit(float(scenario.price_change)), F.lit(PRICE_FLOOR))
    for name in ("promotion", "event"):
        value = getattr(scenario, name)
        if value is not None:
            changes[name] = F.lit(1.0 if value else 0.0)
    return plan.withColumns(changes)


def training_ranges(plan: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Smallest, largest and mean value per channel, price and total spend."""
    values = [F.col(c).cast("double").alias(c) for c in columns]
    return plan.select(*keys, *values).unpivot(list(keys), list(columns), "name", "value").groupBy(*keys, "name").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )


def plan_warnings(plan: DataFrame, ranges: DataFrame, channels: Sequence[str], tolerance: float = SPEND_TOLERANCE) -> DataFrame:
    """Channels and price that leave the range of the training plan."""
    planned = training_ranges(plan, [*channels, "price"]).select("name", F.col("max").alias("planned_max"), F.col("mean").alias("planned_mean"))
    joined = planned.join(ranges.select("name", F.col("min").alias("seen_min"), F.col("max").alias("seen_max")), "name")
    is_price = F.col("name") == "price"
    spend = ~is_price & (F.col("seen_max") > 0) & (F.col("planned_max") > F.col("seen_max") * tolerance)
    price = is_price & ((F.col("planned_mean") < F.col("seen_min") * PRICE_LOW) | (F.col("planned_mean") > F.col("seen_max") * PRICE_HIGH))
    return joined.withColumn("warning", F.when(spend, "spend beyond the training range").when(price, "price outside the observed range")).filter(
        F.col("warning").isNotNull()
    )


def media_by_draw(
    plan: DataFrame, channels: Sequence[str], draws: DataFrame, scale: DataFrame, order_col: str = "t", salts: int = SALTS
) -> DataFrame:
    """Media effect per (draw, channel, period) = beta x saturation of the scaled carry-over.

    ``draws (draw, channel, decay, alpha, theta, beta)``; ``scale (channel, spend_scale)``. The plan is one array of periods
    for each channel, bounded by its number of periods, so it is sent to all tasks. Draws are dealt by their hash over at least
    ``salts`` tasks, and again with their arrays, since a Python step keeps no partitioning: what groups or joins the periods of
    a draw shuffles no expanded row.
    """
    long = plan_long(plan, [order_col], channels).join(scale, "channel")
    spend = F.when(F.col("spend") >= 0, F.col("spend") / F.col("spend_scale")).otherwise(F.raise_error(F.lit("spend cannot be negative")).cast("double"))
    periods = long.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("t"), spend.alias("x")))).alias("_periods"))
    fine = (F.col("decay") >= 0) & (F.col("decay") < 1)
    checked = F.when(fine, F.col("decay")).otherwise(F.raise_error(F.lit("decay must be in [0, 1)")).cast("double"))
    dealt = by_key(draws.withColumn("_d", checked), "draw", salts)
    carried = dealt.join(F.broadcast(periods), "channel").withColumns({"_a": _carry(F.col("_periods.x"), F.col("_d")), "_t": F.col("_periods.t")})
    carried = by_key(carried.drop("_periods"), "draw", 4 * salts)
    level = lambda a: scoring.hill(a * (1.0 - F.col("_d")), F.col("alpha"), F.col("theta")) * F.col("beta")
    out = carried.select("draw", "channel", "_d", "alpha", "theta", "beta", F.inline(F.arrays_zip(F.col("_t").alias("t"), F.col("_a").alias("a"))))
    return out.select("draw", "channel", F.col("t").alias(order_col), level(F.col("a")).alias("effect"))


def channel_contributions(media: DataFrame) -> DataFrame:
    """Mean over draws of each channel's total."""
    totals = media.groupBy("draw", "channel").agg(F.sum("effect").alias("total"))
    return totals.groupBy("channel").agg(F.avg("total").alias("contribution_mean"))


def contribution_table(media: DataFrame, total_sales: Column) -> DataFrame:
    """Contribution, interval and share per channel, summed over periods within each draw first."""
    totals = media.groupBy("draw", "channel").agg(F.sum("effect").alias("total"))
    table = totals.groupBy("channel").agg(
        F.avg("total").alias("contribution_mean"), quantile("total", 0.05).alias("contribution_hdi_5"), quantile("total", 0.95).alias("contribution_hdi_95")
    )
    names = ("contribution_mean", "contribution_hdi_5", "contribution_hdi_95")
    return table.withColumns({n.replace("contribution_", "contribution_share_"): F.col(n) / total_sales for n in names})


def expected_outcome(plan: DataFrame, media: DataFrame, effects: DataFrame, constants: Mapping[str, float], order_col: str = "t") -> DataFrame:
    """Expected outcome per (draw, period).

    ``effects`` has one row per draw: baseline, trend, price_coefficient, promotion_coefficient,
    event_coefficient, season_sin, season_cos. The season uses raw week numbers, the trend centred ones. The plan has one row per
    period and goes to all tasks; draws meet their effects in a hash table of a partition's draws, so their periods are never sorted.
    """
    per_period = media.groupBy("draw", order_col).agg(F.sum("effect").alias("media"))
    week = F.col(order_col)
    angle = F.lit(2.0) * F.pi() * week / F.lit(SEASON)
    centred = (week - F.lit(float(constants["week_mean"]))) / F.lit(float(constants["week_scale"]))
    rows = per_period.join(F.broadcast(plan.select(order_col, "price", "promotion", "event")), order_col).join(effects.hint("shuffle_hash"), "draw")
    value = (
        F.lit(float(constants["sales_mean"])) + F.col("baseline") + F.col("trend") * centred + F.col("media")
        + F.col("price_coefficient") * (F.col("price") - F.lit(float(constants["price_mean"])))
        + F.col("promotion_coefficient") * F.col("promotion") + F.col("event_coefficient") * F.col("event")
        + F.col("season_sin") * F.sin(angle) + F.col("season_cos") * F.cos(angle)
    )
    return rows.select("draw", order_col, value.alias("expected"))


def compare_outcomes(baseline: DataFrame, scenario: DataFrame, level: float = 0.9) -> DataFrame:
    """Difference of the totals per draw: mean, interval, percent and probability of an increase."""
    tail = round((1.0 - level) / 2.0, 12)
    base = baseline.groupBy("draw").agg(F.sum("expected").alias("base"))
    other = scenario.groupBy("draw").agg(F.sum("expected").alias("other"))
    difference = F.col("other") - F.col("base")
    return base.join(other, "draw").withColumn("d", difference).agg(
        F.avg("base").alias("baseline_expected"), F.avg("other").alias("scenario_expected"), F.avg("d").alias("difference_mean"),
        quantile("d", tail).alias("difference_lower"), quantile("d", 1.0 - tail).alias("difference_upper"),
        (F.avg("d") / F.avg("base") * 100).alias("difference_percent"), F.avg((F.col("d") > 0).cast("double")).alias("probability_of_increase"),
    )


def spend_change(plan: DataFrame, edited: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Total spend of both plans and its change."""
    total = sum((F.col(c) for c in channels[1:]), F.col(channels[0]))
    a = plan.agg(F.sum(total).alias("v")).scalar()
    return edited.agg(F.sum(total).alias("scenario_total_spend")).select(
        a.alias("baseline_total_spend"), "scenario_total_spend", (F.col("scenario_total_spend") - a).alias("spend_change")
    )


def response_curves(plan: DataFrame, channels: Sequence[str], draws: DataFrame, scale: DataFrame, points: int = CURVE_POINTS) -> DataFrame:
    """Steady-state response on an even grid to 1.2 times the largest spend, with draw mean and 5/95%."""
    largest = training_ranges(plan, channels).select(F.col("name").alias("channel"), (F.col("max") * CURVE_REACH).alias("_top"))
    shape = draws.groupBy("channel").agg(F.avg("alpha").alias("_alpha"), F.avg("theta").alias("_theta"))
    grid = largest.join(scale, "channel").join(shape, "channel").withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    spend = F.col("_top") * F.col("point") / F.lit(float(points - 1))
    levels = grid.select("channel", "point", spend.alias("spend"), scoring.hill(spend / F.col("spend_scale"), F.col("_alpha"), F.col("_theta")).alias("_s"))
    salt = F.pmod(F.xxhash64("draw"), F.lit(SALTS)).cast("int").alias("_salt")
    copies = levels.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    made = copies.join(draws.select("channel", "beta", salt), ["channel", "_salt"]).withColumn("_r", F.col("beta") * F.col("_s"))
    return made.groupBy("channel", "point", "spend").agg(
        F.avg("_r").alias("response_mean"), quantile("_r", 0.05).alias("response_hdi_5"), quantile("_r", 0.95).alias("response_hdi_95")
    )


def curve_shape(curves: DataFrame) -> DataFrame:
    """L3: per channel, does the response rise throughout and does its marginal return fall towards the end."""
    order = Window.partitionBy("channel").orderBy("point")
    steps = curves.withColumn("_d", F.col("response_mean") - F.lag("response_mean").over(order)).filter(F.col("_d").isNotNull())
    ranked = steps.withColumns(
        {"_i": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy("channel"))}
    )
    mid = F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2), F.col("_d")))
    late = F.max(F.when(F.col("_i") == F.col("_n") - 1, F.col("_d")))
    return ranked.groupBy("channel").agg(F.bool_and(F.col("_d") >= -1e-9).alias("monotone"), (late <= mid + 1e-12).alias("saturating"))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank with ties at their mean position, within ``keys``."""
    order = Window.partitionBy(*keyed(keys)).orderBy(value)
    ties = Window.partitionBy(*keyed(keys), value)
    return df.withColumn(name, F.rank().over(order) + (F.count("*").over(ties) - 1) / 2.0)


def rank_correlation(df: DataFrame, first: str, second: str, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation; null for a constant side. For tables of groups or channels, not for raw rows."""
    ranked = average_rank(average_rank(df, keys, first, "_a"), keys, second, "_b")
    varied = (F.stddev_pop("_a") > 0) & (F.stddev_pop("_b") > 0)
    return ranked.groupBy(*keys).agg(F.when(varied, F.corr("_a", "_b")).alias("rank_correlation"))


def true_vs_estimated(contributions: DataFrame, truth: DataFrame) -> DataFrame:
    """C20: estimated contribution next to the true one, ``truth (channel, true_contribution)``."""
    return contributions.join(truth, "channel").withColumn(
        "in_interval", F.col("true_contribution").between(F.col("contribution_hdi_5"), F.col("contribution_hdi_95"))
    )


def recovery_checks(matched: DataFrame, effects: DataFrame, draws: DataFrame, shapes: DataFrame, decays: DataFrame) -> DataFrame:
    """One row per check of the fit against the known process. ``decays (channel, true_decay)``."""
    name = lambda n: F.lit(n).alias("check")
    signs = effects.agg(*[F.avg(c).alias(c) for c in ("price_coefficient", "promotion_coefficient", "event_coefficient")])
    direction = signs.select(F.inline(F.array(
        F.struct(name("price_direction"), (F.col("price_coefficient") < 0).alias("passed")),
        F.struct(name("promotion_direction"), (F.col("promotion_coefficient") > 0).alias("passed")),
        F.struct(name("event_direction"), (F.col("event_coefficient") > 0).alias("passed")),
    )))
    positive = draws.groupBy("channel").agg(F.avg("beta").alias("b")).agg(F.bool_and(F.col("b") >= 0).alias("passed"))
    ranking = rank_correlation(matched, "true_contribution", "contribution_mean").select((F.col("rank_correlation") >= RANK_CORRELATION).alias("passed"))
    top = matched.agg((F.max_by("channel", "true_contribution") == F.max_by("channel", "contribution_mean")).alias("passed"))
    inside = matched.agg(F.bool_and("in_interval").alias("passed"))
    shape = shapes.agg(F.bool_and(F.col("monotone") & F.col("saturating")).alias("passed"))
    span = draws.groupBy("channel").agg(quantile("decay", 0.05).alias("lo"), quantile("decay", 0.95).alias("hi")).join(decays, "channel")
    carry = span.agg((F.count_if(F.col("true_decay").between(F.col("lo"), F.col("hi"))) >= F.greatest(F.lit(1), F.floor(F.count("*") / 2))).alias("passed"))
    out = direction
    for label, frame in (
        ("media_effects_non_negative", positive), ("contribution_ranking", ranking), ("largest_channel_identified", top),
        ("true_contribution_in_interval", inside), ("diminishing_returns", shape), ("adstock_decay_in_interval", carry),
    ):
        out = out.unionByName(frame.select(name(label), "passed"))
    return out


def attribution(matched: DataFrame) -> DataFrame:
    """Channel with the widest interval and whether media is under-attributed in total."""
    width = F.col("contribution_hdi_95") - F.col("contribution_hdi_5")
    true_total, estimated = F.sum("true_contribution"), F.sum("contribution_mean")
    return matched.agg(
        F.max_by("channel", width).alias("widest_channel"), F.max(width).alias("width"),
        ((true_total > 0) & (estimated < true_total * UNDER_ATTRIBUTED)).alias("under_attributed"),
    )
