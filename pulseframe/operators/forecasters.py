"""Per-series fits that windows cannot express."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.operators import backtest as bt_ops
from pulseframe.operators import calendar as cal_ops
from pulseframe.operators.series import in_order, with_period_index

# --- fixed values -------------------------------------------------------------
EXOG_COLUMNS = ("event_active", "event_decay", "major_announcement_flag")
RIDGE_LAGS = 2
RIDGE_ALPHA = 1.0


def one_step_span(residuals: np.ndarray, history: np.ndarray, level: float) -> tuple[float, float]:
    """Residual quantiles around a one-step forecast; with fewer than two residuals the spread of the history."""
    if residuals.size < 2:
        spread = float(np.std(history)) if history.size > 1 else 0.0
        return -spread, spread
    tail = (1.0 - level) / 2.0
    low, high = np.quantile(residuals, [tail, 1.0 - tail])
    return float(low), float(high)


def _interval(residuals: np.ndarray, history: np.ndarray, points: np.ndarray, level: float):
    low, high = one_step_span(residuals, history, level)
    growth = np.sqrt(np.arange(1, points.size + 1))
    lower = np.clip(np.minimum(points + low * growth, points), 0.0, None)
    return lower, np.maximum(points + high * growth, points)


def smooth_levels(values: np.ndarray, alphas: np.ndarray):
    """Levels of simple smoothing for many smoothing weights at once.

    The level is linear in the start level, so the best start has a closed form for each weight.
    Returns squared error, start level and final level per weight.
    """
    base = np.zeros_like(alphas)
    share = np.ones_like(alphas)
    num, den = np.zeros_like(alphas), np.zeros_like(alphas)
    for v in values:
        num += share * (v - base)
        den += share * share
        base = alphas * v + (1.0 - alphas) * base
        share = (1.0 - alphas) * share
    start = num / den
    level, sse = start.copy(), np.zeros_like(alphas)
    for v in values:
        sse += (v - level) ** 2
        level = alphas * v + (1.0 - alphas) * level
    return sse, start, level


def fit_smoothing(values: np.ndarray, alpha: float | None = None):
    """Last level and residuals. Without ``alpha``, the weight and start level with the least squared one-step error:
    coarse grid, then one refinement; with it the start level alone is estimated."""
    if alpha is not None:
        fine = np.array([alpha])
    else:
        grid = np.linspace(0.01, 0.99, 50)
        best = grid[int(np.argmin(smooth_levels(values, grid)[0]))]
        fine = np.clip(np.linspace(best - 0.02, best + 0.02, 41), 1e-4, 0.9999)
    sse, start, level = smooth_levels(values, fine)
    i = int(np.argmin(sse))
    fitted, current = np.empty_like(values), start[i]
    for t, v in enumerate(values):
        fitted[t] = current
        current = fine[i] * v + (1.0 - fine[i]) * current
    return float(level[i]), values - fitted


def fit_ridge(history: np.ndarray, exog: np.ndarray, penalty: float = RIDGE_ALPHA):
    """(slope, centre, mean, residuals) of a ridge on the last lags and the exogenous rows of the same periods."""
    n = history.size
    lagged = [history[RIDGE_LAGS - k : n - k] for k in range(1, RIDGE_LAGS + 1)]
    x, y = np.column_stack([*lagged, exog[RIDGE_LAGS:n]]), history[RIDGE_LAGS:]
    centre, mean = x.mean(axis=0), float(y.mean())
    gram = (x - centre).T @ (x - centre) + penalty * np.eye(x.shape[1])
    slope = np.linalg.solve(gram, (x - centre).T @ (y - mean))
    return slope, centre, mean, y - mean - (x - centre) @ slope


def _grid(n: int, min_train: int, horizon: int, step: int, max_origins: int | None) -> list[int]:
    origins = list(range(min_train, n - horizon + 1, step))
    return origins if max_origins is None else origins[-max_origins:]


def _rows(model, origin, values, points, lower, upper):
    steps = np.arange(1, points.size + 1)
    return pd.DataFrame(
        {
            "model": model, "origin": origin, "horizon_step": steps, "period_index": origin + steps - 1,
            "actual": values[origin : origin + points.size], "forecast": points, "lower": lower, "upper": upper,
        }
    )


EMPTY_ROWS = pd.DataFrame(
    {c: pd.Series(dtype=t) for c, t in (
        ("model", "str"), ("origin", "int32"), ("horizon_step", "int32"), ("period_index", "int32"),
        ("actual", "float64"), ("forecast", "float64"), ("lower", "float64"), ("upper", "float64"))}
)


def smoothing_backtest(
    df: DataFrame, series_cols: Sequence[str], period_col: str, target: str,
    min_train: int = bt_ops.MIN_TRAIN, horizon: int = bt_ops.HORIZON, step: int = bt_ops.STEP,
    max_origins: int | None = None, level: float = bt_ops.INTERVAL_LEVEL, alpha: float | None = None,
) -> DataFrame:
    """K7: simple exponential smoothing, refitted at every origin; weight and start level estimated, or the weight given."""

    def forecaster(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf[target].to_numpy(dtype=float)
        parts = []
        for origin in _grid(values.size, min_train, horizon, step, max_origins):
            history = values[:origin]
            if history.size < bt_ops.MIN_SMOOTHING:
                continue
            last, residuals = fit_smoothing(history, alpha)
            points = np.clip(np.full(horizon, last), 0.0, None)
            parts.append(_rows("exponential_smoothing", origin, values, points, *_interval(residuals, history, points, level)))
        return pd.concat(parts, ignore_index=True) if parts else EMPTY_ROWS.copy()

    return bt_ops.backtest_grouped(df, series_cols, period_col, target, forecaster)


def exog_blocks(
    df: DataFrame, calendar: DataFrame | None, series_cols: Sequence[str], period_col: str,
    min_train: int = bt_ops.MIN_TRAIN, horizon: int = bt_ops.HORIZON, step: int = bt_ops.STEP,
    max_origins: int | None = None,
) -> DataFrame:
    """Training and future rows of every origin with only the events announced by its last known period.

    Without a calendar the rows carry no event columns.
    """
    indexed = with_period_index(df, series_cols, period_col, "period_index")
    origins = bt_ops.rolling_origins(df, series_cols, min_train, horizon, step, max_origins)
    origins = origins.groupBy(*series_cols, "origin").agg(F.max("period_index").alias("_last"))
    at = indexed.select(*series_cols, F.col("period_index").alias("train_end"), F.col(period_col).alias("known_until"))
    dated = origins.withColumn("train_end", F.col("origin") - 1).join(at, [*series_cols, "train_end"])
    left, right = indexed.alias("p"), dated.alias("o")
    same = F.lit(True)
    for c in series_cols:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"o.{c}"))
    rows = left.join(right, same & (F.col("p.period_index") <= F.col("o._last"))).select(
        *[F.col(f"p.{c}") for c in indexed.columns], "o.origin", "o.known_until",
        (F.col("p.period_index") < F.col("o.origin")).alias("in_training"),
    )
    return rows if calendar is None else cal_ops.event_features(rows, calendar, period_col, "known_until")


def ridge_backtest(
    df: DataFrame, calendar: DataFrame | None, series_cols: Sequence[str], period_col: str, target: str,
    features: Sequence[str] = EXOG_COLUMNS, min_train: int = bt_ops.MIN_TRAIN, horizon: int = bt_ops.HORIZON,
    step: int = bt_ops.STEP, max_origins: int | None = None, level: float = bt_ops.INTERVAL_LEVEL,
) -> DataFrame:
    """K8: ridge on two lags and the event features known at the origin, rolled forward step by step.

    A group is one (series, origin): its rows up to the horizon, bounded by the length of the series.
    """
    blocks = exog_blocks(df, calendar, series_cols, period_col, min_train, horizon, step, max_origins)
    keys, names = list(series_cols), list(features)
    types = dict(blocks.dtypes)
    schema = ", ".join([f"{c} {types[c]}" for c in keys] + [bt_ops.ROW_SCHEMA])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period_index")
        origin = int(pdf["origin"].iloc[0])
        values = pdf[target].to_numpy(dtype=float)
        exog = pdf[names].to_numpy(dtype=float)
        history = values[:origin]
        if origin < bt_ops.MIN_RIDGE or origin - RIDGE_LAGS < 3:
            out = EMPTY_ROWS.copy()
            return out.assign(**{k: pd.Series(dtype=pdf[k].dtype) for k in keys})
        slope, centre, mean, residuals = fit_ridge(history, exog[:origin])
        known, points = list(history), []
        for h in range(horizon):
            row = np.concatenate([known[: -RIDGE_LAGS - 1 : -1], exog[origin + h]])
            points.append(mean + float((row - centre) @ slope))
            known.append(points[-1])
        clipped = np.clip(np.asarray(points), 0.0, None)
        out = _rows("ridge_event", origin, values, clipped, *_interval(residuals, history, clipped, level))
        for key in keys:
            out[key] = pdf[key].iloc[0]
        return out

    return blocks.groupBy(*keys, "origin").applyInPandas(fit, schema)


def bootstrap_draws(
    df: DataFrame, series_cols: Sequence[str], period_col: str, target: str,
    horizon: int = 4, draws: int = 1000, seed: int = 42,
) -> DataFrame:
    """Forecast draws from the last value plus resampled one-step residuals of the same series.

    Picks are hashes of (series, draw, step), so they repeat. The path of a draw is the running sum of its
    picks; draws are long rows, never arrays.
    """
    order = in_order(series_cols, period_col)
    keys = list(series_cols)
    steps = df.select(*keys, period_col, (F.col(target) - F.lag(target).over(order)).alias("residual")).dropna(subset=["residual"])
    numbered = steps.withColumn("slot", F.row_number().over(order) - 1).drop(period_col)
    last = df.groupBy(*keys).agg(F.max_by(F.col(target), F.col(period_col)).alias("_last"), F.count("*").alias("_n"))
    picks = (
        last.filter(F.col("_n") > 1)
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .withColumn("slot", F.pmod(F.xxhash64(*keys, "draw", "step", F.lit(seed)), F.col("_n") - 1).cast("int"))
    )
    joined = picks.join(numbered, [*keys, "slot"])
    path = Window.partitionBy(*keys, "draw").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    value = F.greatest(F.col("_last") + F.sum("residual").over(path), F.lit(0.0))
    return joined.select(*keys, "draw", "step", value.alias("value"))
