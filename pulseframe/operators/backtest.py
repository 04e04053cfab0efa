"""Rolling-origin backtests of simple forecasters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators.series import extend_periods, in_order, with_period_index
from pulseframe.session import keyed

# --- fixed values -------------------------------------------------------------
INTERVAL_LEVEL = 0.8
MEAN_WINDOW = 8
SEASON_PERIOD = 52
MIN_TRAIN = 12
HORIZON = 2
STEP = 2
COMPLEXITY = {
    "naive": 1,
    "mean": 1,
    "seasonal_naive": 2,
    "exponential_smoothing": 3,
    "ridge_event": 4,
}
MIN_SMOOTHING = 8
MIN_RIDGE = 16
WINDOW_MODELS = ("naive", "mean", "seasonal_naive")

ROW_SCHEMA = (
    "model string, origin int, horizon_step int, period_index int, actual double, "
    "forecast double, lower double, upper double"
)


def _check(min_train: int, horizon: int, step: int) -> None:
    for name, value in (("min_train", min_train), ("horizon", horizon), ("step", step)):
        if value < 1:
            raise ValueError(f"{name} must be at least 1")


def rolling_origins(
    df: DataFrame,
    series_cols: Sequence[str],
    min_train: int = MIN_TRAIN,
    horizon: int = HORIZON,
    step: int = STEP,
    max_origins: int | None = None,
) -> DataFrame:
    """K1, K2: every (series, origin, step) with its test position; training is ``[0, origin)``."""
    _check(min_train, horizon, step)
    sizes = df.groupBy(*series_cols).agg(F.count("*").alias("_n"))
    origins = F.sequence(F.lit(min_train), F.col("_n") - horizon, F.lit(step))
    if max_origins is not None:
        origins = F.slice(origins, -F.least(F.size(origins), F.lit(max_origins)), max_origins)
    steps = F.sequence(F.lit(1), F.lit(horizon))
    return (
        sizes.filter(F.col("_n") >= min_train + horizon)
        .select(*series_cols, F.explode(origins).alias("origin"))
        .select(*series_cols, F.col("origin").cast("int"), F.explode(steps).alias("horizon_step"))
        .withColumn("train_end", F.col("origin") - 1)
        .withColumn("period_index", F.col("origin") + F.col("horizon_step") - 1)
    )


def eligible_models(n: Column, min_train: int | None = None, season: int = SEASON_PERIOD) -> Column:
    """Models the length of the history supports, simplest first."""
    smallest = n if min_train is None else F.least(n, F.lit(min_train))
    return F.array_compact(
        F.array(
            F.lit("naive"),
            F.lit("mean"),
            F.when((n >= 2 * season) & (smallest >= season), F.lit("seasonal_naive")),
            F.when(smallest >= MIN_SMOOTHING, F.lit("exponential_smoothing")),
            F.when(smallest >= MIN_RIDGE, F.lit("ridge_event")),
        )
    )


def expanding_forecasts(
    df: DataFrame,
    series_cols: Sequence[str],
    period_col: str,
    target: str,
    models: Sequence[str] = WINDOW_MODELS,
    horizon: int = HORIZON,
    interval_level: float = INTERVAL_LEVEL,
    season: int = SEASON_PERIOD,
    mean_window: int = MEAN_WINDOW,
) -> DataFrame:
    """K4, K5, K6, K9: forecasts made after every period, from windows that end there.

    One shuffle by series. The frame of each statistic ends at the current row, so a forecast cannot see
    later periods. Residual quantiles of the trailing mean are value quantiles shifted by its level.
    """
    tail = round((1.0 - interval_level) / 2.0, 12)
    order = in_order(series_cols, period_col)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    trailing = order.rowsBetween(-(mean_window - 1), Window.currentRow)
    value = F.col(target).cast("double")
    base = df.select(*series_cols, period_col, value.alias("_v")).withColumns(
        {
            "_r1": F.col("_v") - F.lag("_v", 1).over(order),
            "_rs": F.col("_v") - F.lag("_v", season).over(order),
        }
    )

    def span(column: str, shift: Column | None = None) -> tuple[Column, Column]:
        # Fewer than two residuals: plus/minus the spread of the history.
        spread = F.coalesce(F.stddev_pop("_v").over(so_far), F.lit(0.0))
        enough = F.count(column).over(so_far) >= 2
        low, high = (F.percentile(column, F.lit(q)).over(so_far) for q in (tail, 1.0 - tail))
        if shift is not None:
            low, high = low - shift, high - shift
        return F.when(enough, low).otherwise(-spread), F.when(enough, high).otherwise(spread)

    n = F.count("*").over(Window.partitionBy(*keyed(series_cols)))
    frame = base.withColumns({"origin": F.row_number().over(order), "_n": n})
    per_model = []
    if "naive" in models:
        per_model.append(("naive", [F.col("_v")] * horizon, *span("_r1"), F.lit(True)))
    if "mean" in models:
        level = F.avg("_v").over(trailing)
        per_model.append(("mean", [level] * horizon, *span("_v", level), F.lit(True)))
    if "seasonal_naive" in models:
        points = [F.lag("_v", season - 1 - (h % season)).over(order) for h in range(horizon)]
        fits = (F.col("origin") >= season) & (F.col("_n") >= 2 * season)
        per_model.append(("seasonal_naive", points, *span("_rs"), fits))
    structs = [
        F.when(
            fits,
            F.struct(
                F.lit(name).alias("model"),
                F.array(*[F.greatest(p, F.lit(0.0)) for p in points]).alias("points"),
                low.alias("low"),
                high.alias("high"),
            ),
        )
        for name, points, low, high, fits in per_model
    ]
    ahead = F.array(*[F.lead("_v", h).over(order) for h in range(1, horizon + 1)])
    wide = frame.withColumns({"_models": F.array(*structs), "_ahead": ahead})
    rows = (
        wide.select(*series_cols, period_col, "origin", "_n", "_ahead", F.explode("_models").alias("_m"))
        .filter(F.col("_m").isNotNull())
        .select(*series_cols, period_col, "origin", "_n", "_ahead", "_m.*")
    )
    steps = rows.select(
        *series_cols, period_col, "origin", "_n", "model", "low", "high", "_ahead",
        F.posexplode("points").alias("_pos", "forecast"),
    )
    growth = F.sqrt(F.col("horizon_step").cast("double"))
    return (
        steps.withColumn("horizon_step", F.col("_pos") + 1)
        .withColumns(
            {
                "period_index": F.col("origin") + F.col("horizon_step") - 1,
                "actual": F.get("_ahead", F.col("_pos")),
                "lower": F.greatest(
                    F.least(F.col("forecast") + F.col("low") * growth, F.col("forecast")), F.lit(0.0)
                ),
                "upper": F.greatest(F.col("forecast") + F.col("high") * growth, F.col("forecast")),
            }
        )
        .drop("_pos", "_ahead", "low", "high")
    )


def backtest(
    df: DataFrame,
    series_cols: Sequence[str],
    period_col: str,
    target: str,
    models: Sequence[str] = WINDOW_MODELS,
    min_train: int = MIN_TRAIN,
    horizon: int = HORIZON,
    step: int = STEP,
    max_origins: int | None = None,
    interval_level: float = INTERVAL_LEVEL,
    season: int = SEASON_PERIOD,
) -> DataFrame:
    """K3: one row per (series, model, origin, step). Origins are the expanding rows on the step grid."""
    _check(min_train, horizon, step)
    made = expanding_forecasts(df, series_cols, period_col, target, models, horizon, interval_level, season)
    on_grid = (
        (F.col("origin") >= min_train)
        & ((F.col("origin") - min_train) % step == 0)
        & (F.col("origin") + horizon <= F.col("_n"))
    )
    if "seasonal_naive" in models:
        # Offered only when its first origin can be fitted.
        on_grid = on_grid & ((F.col("model") != "seasonal_naive") | F.lit(min_train >= season))
    if max_origins is not None:
        last = F.col("_n") - horizon - ((F.col("_n") - horizon - min_train) % step)
        on_grid = on_grid & (F.col("origin") > last - step * max_origins)
    columns = ["model", "origin", "horizon_step", "period_index", "actual", "forecast", "lower", "upper"]
    return made.filter(on_grid).select(*series_cols, *columns)


def backtest_grouped(
    df: DataFrame,
    series_cols: Sequence[str],
    period_col: str,
    target: str,
    forecaster: Callable[[pd.DataFrame], pd.DataFrame],
) -> DataFrame:
    """Extension point: ``forecaster`` maps one series (sorted, with ``period_index``) to backtest rows.

    A group is one series, bounded by its number of periods. Returned columns are those of ``backtest``.
    """
    keys = list(series_cols)
    indexed = with_period_index(df, keys, period_col)
    types = dict(indexed.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in keys] + [ROW_SCHEMA])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period_index").reset_index(drop=True)
        out = forecaster(pdf)
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out

    if not keys:
        return indexed.groupBy(F.lit("all").alias("_all")).applyInPandas(run, schema)
    return indexed.groupBy(*keys).applyInPandas(run, schema)


def future_forecast(
    df: DataFrame,
    series_cols: Sequence[str],
    period_col: str,
    target: str,
    models: Sequence[str] = WINDOW_MODELS,
    horizon: int = 4,
    freq: str = "W-MON",
) -> DataFrame:
    """Forecast of the periods after the end of each series, with calendar dates."""
    made = expanding_forecasts(df, series_cols, period_col, target, models, horizon)
    ends = made.filter(F.col("origin") == F.col("_n")).drop(period_col, "actual", "_n", "period_index")
    ahead = extend_periods(df, series_cols, period_col, horizon, freq)
    dated = ahead.withColumn(
        "horizon_step", F.row_number().over(in_order(series_cols, period_col))
    )
    return ends.join(dated, [*series_cols, "horizon_step"]).select(
        *series_cols, period_col, "horizon_step", "model", "forecast", "lower", "upper"
    )
