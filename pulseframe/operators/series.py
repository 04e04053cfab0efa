"""Period spines and per-series sequence operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions import timing
from pulseframe.session import keyed

# --- fixed values -------------------------------------------------------------
TARGET_KINDS = {
    "actionable_probability_mass": "continuous_nonnegative",
    "actionable_count": "count",
    "total_comments": "count",
    "high_intent_count": "count",
    "actionable_rate": "rate",
}
DEFAULT_TARGETS = ("actionable_probability_mass", "actionable_count", "total_comments")
SEASON = 52.0


def spine(df: DataFrame, series_cols: Sequence[str], period_col: str, freq: str = "W-MON") -> DataFrame:
    """Complete gap-free period index per series, first to last observed period."""
    bounds = df.groupBy(*series_cols).agg(F.min(period_col).alias("_lo"), F.max(period_col).alias("_hi"))
    step = F.expr(timing.period_step(freq))
    return bounds.filter(F.col("_lo").isNotNull()).select(
        *series_cols, F.explode(F.sequence("_lo", "_hi", step)).alias(period_col)
    )


def fill_spine(
    aggregated: DataFrame,
    series_cols: Sequence[str],
    period_col: str,
    zero_cols: Sequence[str],
    freq: str = "W-MON",
) -> DataFrame:
    """C4: left join onto the spine; only ``zero_cols`` become 0, everything else stays null."""
    full = spine(aggregated, series_cols, period_col, freq)
    return full.join(aggregated, [*series_cols, period_col], "left").fillna(0, subset=list(zero_cols))


def in_order(series_cols: Sequence[str], order_col: str):
    return Window.partitionBy(*keyed(series_cols)).orderBy(order_col)


def with_period_index(df: DataFrame, series_cols: Sequence[str], period_col: str, name: str = "period_index") -> DataFrame:
    """Position of each period in its series, from 0."""
    return df.withColumn(name, F.row_number().over(in_order(series_cols, period_col)) - 1)


def extend_periods(df: DataFrame, series_cols: Sequence[str], period_col: str, periods: int,
                   freq: str = "W-MON") -> DataFrame:
    """The next ``periods`` period starts after the end of each series."""
    step = timing.period_step(freq)
    last = df.groupBy(*series_cols).agg(F.max(period_col).alias("_last"))
    number = int(step.split()[1])
    future = F.explode(
        F.sequence(
            F.col("_last") + F.expr(step),
            F.col("_last") + F.expr(f"INTERVAL {number * periods} DAYS"),
            F.expr(step),
        )
    )
    return last.select(*series_cols, future.alias(period_col))


def trim_leading_empty(df: DataFrame, series_cols: Sequence[str], period_col: str, target: str) -> DataFrame:
    """Drop the empty periods before the first positive value; all-empty series stay whole."""
    whole = Window.partitionBy(*keyed(series_cols))
    first = F.min(F.when(F.col(target) > 0, F.col(period_col))).over(whole)
    return (
        df.withColumn("_first", first)
        .filter(F.col("_first").isNull() | (F.col(period_col) >= F.col("_first")))
        .drop("_first")
    )


def drop_undefined(df: DataFrame, series_cols: Sequence[str], period_col: str, target: str) -> DataFrame:
    """Keep the periods a target is defined on and number them anew."""
    return with_period_index(df.dropna(subset=[target]), series_cols, period_col)


def available_targets(df: DataFrame, requested: Sequence[str] = DEFAULT_TARGETS) -> list[str]:
    """Requested targets the table carries."""
    return [name for name in requested if name in df.columns]


def select_targets(df: DataFrame, series_cols: Sequence[str], period_col: str, targets: Sequence[str]) -> DataFrame:
    """Targets in long form ``(series, period, target, value)``."""
    missing = sorted(set(targets) - set(df.columns))
    if missing:
        known = sorted(set(TARGET_KINDS) & set(df.columns))
        raise ValueError(f"Targets {missing} are not in the table. Available: {known}")
    values = [F.col(t).cast("double").alias(t) for t in targets]
    wide = df.select(*series_cols, period_col, *values)
    return wide.unpivot([*series_cols, period_col], list(targets), "target", "value")


def target_kind(target: Column) -> Column:
    """Likelihood family of a target."""
    pairs = [F.lit(x) for item in TARGET_KINDS.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[target], F.lit("continuous_nonnegative"))


def likelihood(kind: Column, has_zero: Column) -> Column:
    """Likelihood name by target kind and presence of zeros."""
    return (
        F.when(kind == "count", "negative_binomial")
        .when(kind == "rate", "binomial")
        .when(has_zero, "hurdle_gamma")
        .otherwise("gamma")
    )


def series_profile(df: DataFrame, series_cols: Sequence[str], target: str, kind: Column) -> DataFrame:
    """Size, zero share, complexity tier, dispersion and likelihood per series."""
    value = F.col(target)
    stats = df.groupBy(*series_cols).agg(
        F.count(value).alias("periods"),
        F.count_if(value > 0).alias("non_empty_periods"),
        F.avg((value <= 0).cast("double")).alias("zero_period_share"),
        F.coalesce(F.bool_or(value <= 0), F.lit(False)).alias("has_zero"),
        F.try_divide(F.var_pop(value), F.avg(value)).alias("dispersion_ratio"),
    )
    return stats.withColumns(
        {
            "complexity_tier": complexity_tier(F.col("non_empty_periods")),
            "likelihood": likelihood(kind, F.col("has_zero")),
        }
    )


def complexity_tier(non_empty: Column) -> Column:
    return F.when(non_empty < 30, "minimal").when(non_empty <= 60, "moderate").otherwise("rich")


def _runs(df: DataFrame, series_cols: Sequence[str], period_col: str, flag: Column) -> DataFrame:
    """Runs of consecutive rows of the spine for which ``flag`` holds."""
    everything = in_order(series_cols, period_col)
    numbered = df.withColumn("_pos", F.row_number().over(everything)).filter(flag)
    island = F.col("_pos") - F.row_number().over(in_order(series_cols, period_col))
    return (
        numbered.withColumn("_island", island)
        .groupBy(*series_cols, "_island")
        .agg(
            F.min(period_col).alias("start"),
            F.max(period_col).alias("end"),
            F.count("*").alias("periods"),
        )
        .drop("_island")
    )


def gap_runs(filled: DataFrame, series_cols: Sequence[str], period_col: str, count_col: str, min_gap: int = 2) -> DataFrame:
    """Runs of at least ``min_gap`` empty periods."""
    runs = _runs(filled, series_cols, period_col, F.col(count_col) == 0)
    return runs.filter(F.col("periods") >= min_gap)


def longest_dense_run(filled: DataFrame, series_cols: Sequence[str], period_col: str, count_col: str) -> DataFrame:
    """Longest run of non-empty periods."""
    runs = _runs(filled, series_cols, period_col, F.col(count_col) > 0)
    return runs.groupBy(*series_cols).agg(F.max("periods").alias("longest_dense_run"))


def lag_design(df: DataFrame, series_cols: Sequence[str], period_col: str, target: str, lags: int = 2,
               exog_cols: Sequence[str] = ()) -> DataFrame:
    """Target with its lags and exogenous columns; rows without full history are dropped."""
    order = in_order(series_cols, period_col)
    lagged = {f"lag_{k}": F.lag(target, k).over(order) for k in range(1, lags + 1)}
    design = df.select(*series_cols, period_col, target, *exog_cols).withColumns(lagged)
    return design.dropna(subset=list(lagged))


def time_terms(df: DataFrame, series_cols: Sequence[str], period_col: str) -> DataFrame:
    """Centred and scaled time index plus one annual sine/cosine pair."""
    whole = Window.partitionBy(*keyed(series_cols))
    t = F.row_number().over(in_order(series_cols, period_col)) - 1
    n = F.count("*").over(whole)
    angle = F.lit(2.0) * F.pi() * F.col("_t") / F.lit(SEASON)
    return (
        df.withColumns({"_t": t, "_n": n})
        .withColumns(
            {
                "time_index": (F.col("_t") - (F.col("_n") - 1) / 2.0) / F.greatest(F.col("_n") - 1, F.lit(1)),
                "seasonal_sin": F.sin(angle),
                "seasonal_cos": F.cos(angle),
            }
        )
        .drop("_t", "_n")
    )


def residuals(df: DataFrame, series_cols: Sequence[str], period_col: str, target: str, period: int = 52) -> DataFrame:
    """Naive and seasonal one-step residuals."""
    order = in_order(series_cols, period_col)
    return df.withColumns(
        {
            "naive_residual": F.col(target) - F.lag(target, 1).over(order),
            "seasonal_residual": F.col(target) - F.lag(target, period).over(order),
        }
    )


def identifiable_features(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Per key, which features vary in the training window (long form)."""
    values = [F.col(f).cast("double").alias(f) for f in features]
    long = df.select(*keys, *values).unpivot(list(keys), list(features), "feature", "value")
    return long.groupBy(*keys, "feature").agg((F.stddev_pop("value") > 0).alias("identifiable"))
