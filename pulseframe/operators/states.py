"""Fitted states of forecast models and the forecasts that follow from them.

A state is one row per (series, model): what the model needs to go on from the end of the series. Window models are aggregates,
smoothing and ridge are fitted on one series at a time, whose size is its number of periods. The roll-forward reads states only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators import backtest as bt_ops
from pulseframe.operators import calendar as cal_ops
from pulseframe.operators import forecasters
from pulseframe.operators.series import extend_periods, in_order
from pulseframe.session import keyed, materialise

_STATE = ("model string, n int, last_period timestamp, points array<double>, lags array<double>, slope array<double>, "
          "centre array<double>, mean double, low double, high double")
_NAMES = [part.split()[0] for part in _STATE.split(", ")]


def _window_states(df: DataFrame, keys: list[str], period_col: str, target: str, models: Sequence[str], level: float) -> DataFrame:
    """Last value, trailing mean and last season, each with the quantiles of its one-step residuals."""
    tail, season = round((1.0 - level) / 2.0, 12), bt_ops.SEASON_PERIOD
    order = in_order(keys, period_col)
    back = F.row_number().over(Window.partitionBy(*keyed(keys)).orderBy(F.desc(period_col)))
    value = F.col(target).cast("double")
    rows = df.select(*keys, period_col, value.alias("_v")).withColumns(
        {"_back": back, "_r1": F.col("_v") - F.lag("_v").over(order), "_rs": F.col("_v") - F.lag("_v", season).over(order)})
    # At most a season of values is collected per series.
    recent = F.sort_array(F.collect_list(F.when(F.col("_back") <= season, F.struct((-F.col("_back")).alias("o"), "_v"))))

    def span(column: str) -> list:
        return [F.percentile(column, F.lit(q)).alias(f"{column}_{name}") for q, name in ((tail, "low"), (1.0 - tail, "high"))]

    ends = rows.groupBy(*keys).agg(
        F.count("*").cast("int").alias("n"), F.max(period_col).cast("timestamp").alias("last_period"), recent.getField("_v").alias("_recent"),
        F.avg(F.when(F.col("_back") <= bt_ops.MEAN_WINDOW, F.col("_v"))).alias("_mean"), F.stddev_pop("_v").alias("_sd"),
        F.count("_r1").alias("_r1_n"), F.count("_rs").alias("_rs_n"), F.count("_v").alias("_v_n"), *span("_r1"), *span("_rs"), *span("_v"))
    spread = F.coalesce("_sd", F.lit(0.0))

    def state(model: str, points, column: str, shift=0.0, fits=None):
        enough = F.col(f"{column}_n") >= 2
        low = F.when(enough, F.col(f"{column}_low") - shift).otherwise(-spread)
        high = F.when(enough, F.col(f"{column}_high") - shift).otherwise(spread)
        found = F.struct(F.lit(model).alias("model"), points.alias("points"), low.alias("low"), high.alias("high"))
        return found if fits is None else F.when(fits, found)

    made = {
        "naive": state("naive", F.array(F.element_at("_recent", -1)), "_r1"),
        "mean": state("mean", F.array("_mean"), "_v", F.col("_mean")),
        "seasonal_naive": state("seasonal_naive", F.col("_recent"), "_rs", fits=F.col("n") >= 2 * season),
    }
    states = ends.select(*keys, "n", "last_period", F.explode(F.array_compact(F.array(*[made[m] for m in models]))).alias("s"))
    none = F.lit(None).cast("array<double>")
    return states.select(*keys, "s.model", "n", "last_period", "s.points", none.alias("lags"), none.alias("slope"), none.alias("centre"),
                         F.lit(None).cast("double").alias("mean"), "s.low", "s.high")


def _fit_series(df: DataFrame, keys: list[str], fit) -> DataFrame:
    """One state row per series from ``fit(frame of the series)``; None where the series is too short."""
    types = dict(df.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [_STATE])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = fit(pdf.sort_values("_at"))
        if made is None:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in [*keys, *_NAMES]})
        row = {**dict.fromkeys(_NAMES), **{k: pdf[k].iloc[0] for k in keys}, "n": len(pdf), "last_period": pdf["_at"].max(), **made}
        return pd.DataFrame([row], columns=[*keys, *_NAMES])

    return df.groupBy(*keys).applyInPandas(run, schema) if keys else df.groupBy(F.lit(1)).applyInPandas(run, schema)


def fitted_states(
    df: DataFrame, series_cols: Sequence[str], period_col: str, target: str, models: Sequence[str] = tuple(bt_ops.COMPLEXITY),
    calendar: DataFrame | None = None, features: Sequence[str] = forecasters.EXOG_COLUMNS, alpha: float | None = None,
    level: float = bt_ops.INTERVAL_LEVEL,
) -> DataFrame:
    """One written row per (series, model) that the length of the series allows.

    points: constant or seasonal forecasts in the order in which they come; lags, slope, centre, mean: the ridge and the
    last values it goes on from, latest first; low, high: quantiles of the one-step residuals. Ridge needs ``calendar`` unless it has no
    ``features``; ``alpha`` fixes the weight of the smoothing.
    """
    keys, names = list(series_cols), list(features)
    parts = []
    window = [m for m in models if m in bt_ops.WINDOW_MODELS]
    if window:
        parts.append(_window_states(df, keys, period_col, target, window, level))
    rows = df.select(*keys, F.col(period_col).cast("timestamp").alias("_at"), F.col(target).cast("double").alias("_v"))

    def smooth(pdf: pd.DataFrame):
        values = pdf["_v"].to_numpy(dtype=float)
        if values.size < bt_ops.MIN_SMOOTHING:
            return None
        last, residuals = forecasters.fit_smoothing(values, alpha)
        low, high = forecasters.one_step_span(residuals, values, level)
        return {"model": "exponential_smoothing", "points": [last], "low": low, "high": high}

    def ridge(pdf: pd.DataFrame):
        values = pdf["_v"].to_numpy(dtype=float)
        if values.size < bt_ops.MIN_RIDGE:
            return None
        slope, centre, mean, residuals = forecasters.fit_ridge(values, pdf[names].to_numpy(dtype=float))
        low, high = forecasters.one_step_span(residuals, values, level)
        return {"model": "ridge_event", "lags": values[: -forecasters.RIDGE_LAGS - 1 : -1].tolist(), "slope": np.asarray(slope).tolist(),
                "centre": centre.tolist(), "mean": mean, "low": low, "high": high}

    if "exponential_smoothing" in models:
        parts.append(_fit_series(rows, keys, smooth))
    if "ridge_event" in models and (calendar is not None or not names):
        known = F.max("_at").over(Window.partitionBy(*keyed(keys)))
        dated = rows.withColumn("_known", known)
        if names:
            dated = cal_ops.event_features(dated, calendar, "_at", "_known")
        parts.append(_fit_series(dated.select(*keys, "_at", "_v", *names), keys, ridge))
    if not parts:
        raise ValueError("no model to fit")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return materialise(out, "states")


def roll_forward(
    states: DataFrame, series_cols: Sequence[str], period_col: str, horizon: int = 4, freq: str = "W-MON",
    calendar: DataFrame | None = None, features: Sequence[str] = forecasters.EXOG_COLUMNS,
) -> DataFrame:
    """Forecasts of the periods after the end of each series, from its states alone.

    Ridge goes on step by step with its own forecasts as lags and the events announced by the end of the series.
    """
    keys, names = list(series_cols), list(features)
    ends = states.select(*keys, F.col("last_period").alias(period_col)).distinct()
    ahead = extend_periods(ends, keys, period_col, horizon, freq).join(ends.withColumnRenamed(period_col, "_known"), keys) if keys else (
        extend_periods(ends, keys, period_col, horizon, freq).crossJoin(ends.withColumnRenamed(period_col, "_known")))
    if names and calendar is not None:
        ahead = cal_ops.event_features(ahead, calendar, period_col, "_known")
        exog = F.array(*[F.col(c).cast("double") for c in names])
    else:
        exog = F.array().cast("array<double>")
    # One entry per step.
    path = F.sort_array(F.collect_list(F.struct(F.col(period_col).alias("at"), exog.alias("x"))))
    path = ahead.groupBy(*keys).agg(path.alias("path"))
    rows = states.join(path, keys) if keys else states.crossJoin(path)

    def step(state, p):
        x = F.concat(state["lags"], p["x"])
        terms = F.zip_with(F.col("slope"), F.zip_with(x, F.col("centre"), lambda a, c: a - c), lambda b, d: b * d)
        point = F.col("mean") + F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
        lags = F.slice(F.concat(F.array(point), state["lags"]), 1, F.size(state["lags"]))
        return F.struct(lags.alias("lags"), F.concat(state["made"], F.array(point)).alias("made"))

    start = F.struct(F.col("lags").alias("lags"), F.array().cast("array<double>").alias("made"))
    recursive = F.aggregate("path", start, step, lambda state: state["made"])
    constant = F.transform(F.col("path"), lambda p, i: F.element_at("points", (i % F.size("points") + 1).cast("int")))
    made = F.when(F.col("slope").isNotNull(), recursive).otherwise(constant)
    rows = rows.withColumn("_made", made).select(*keys, "path", "model", "low", "high", F.posexplode("_made").alias("_i", "_f"))
    growth, point = F.sqrt((F.col("_i") + 1).cast("double")), F.greatest("_f", F.lit(0.0))
    return rows.select(
        *keys, F.get("path", F.col("_i")).getField("at").alias(period_col), (F.col("_i") + 1).alias("horizon_step"), "model", point.alias("forecast"),
        F.greatest(F.least(point + F.col("low") * growth, point), F.lit(0.0)).alias("lower"), F.greatest(point + F.col("high") * growth, point).alias("upper"))


def selected_forecast(forecast: DataFrame, selection: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    """The future rows of the model that was selected for each series."""
    keys = list(series_cols)
    chosen = selection.select(*keys, F.col("selected").alias("model"))
    return forecast.join(chosen, [*keys, "model"])
