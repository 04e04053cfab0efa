"""Forecast runs over many series and targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators import backtest as bt_ops
from pulseframe.operators import compare, forecasters, series, states
from pulseframe.session import materialise, require_columns

TARGET = "target"


def run_targets(
    weekly: DataFrame,
    targets: Sequence[str],
    series_cols: Sequence[str] = (),
    period_col: str = "period_start",
    calendar: DataFrame | None = None,
    models: Sequence[str] = bt_ops.WINDOW_MODELS,
    reference_model: str | None = None,
    min_train: int = bt_ops.MIN_TRAIN,
    horizon: int = bt_ops.HORIZON,
    step: int = bt_ops.STEP,
    max_origins: int | None = None,
    extra_backtest: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Trim, drop undefined periods, backtest, monitor, compare and select, for all series and targets at once.

    A target is one more series key, so a run over many targets is a single plan. ``extra_backtest`` takes rows
    of a model fitted elsewhere; with ``reference_model`` the choice rests on the origins that model was scored on.
    """
    keys = [*series_cols, TARGET]
    long = series.select_targets(weekly, series_cols, period_col, targets)
    ready = series.drop_undefined(
        series.trim_leading_empty(long, keys, period_col, "value"), keys, period_col, "value"
    ).drop("period_index")
    ready = materialise(ready, "targets")
    grid = dict(min_train=min_train, horizon=horizon, step=step, max_origins=max_origins)
    window_models = [m for m in models if m in bt_ops.WINDOW_MODELS]
    parts = []
    if window_models:
        parts.append(bt_ops.backtest(ready, keys, period_col, "value", models=window_models, **grid))
    if "exponential_smoothing" in models and min_train >= bt_ops.MIN_SMOOTHING:
        parts.append(forecasters.smoothing_backtest(ready, keys, period_col, "value", **grid))
    if "ridge_event" in models and calendar is not None and min_train >= bt_ops.MIN_RIDGE:
        parts.append(forecasters.ridge_backtest(ready, calendar, keys, period_col, "value", **grid))
    if extra_backtest is not None:
        parts.append(extra_backtest)
    if not parts:
        raise ValueError("no model to run")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    backtest = materialise(rows, "backtest")
    monitoring = compare.monitoring_table(backtest, keys)
    flags = materialise(compare.bias_flags(monitoring, keys), "flags")
    scale = compare.naive_scale(ready, keys, period_col, "value")
    comparison = compare.comparison_table(backtest, flags, keys, scale)
    out = {
        "observed": ready,
        "backtest": backtest,
        "monitoring": monitoring,
        "flags": flags,
        "comparison": comparison,
    }
    basis = comparison
    if reference_model is not None:
        matched = compare.matched_origins(backtest, reference_model, keys)
        out["matched_comparison"] = compare.comparison_table(matched, flags, keys, scale)
        out["sensitivity"] = compare.ranking_sensitivity(backtest, reference_model, keys)
        basis = out["matched_comparison"]
    out["selection"] = compare.select_model(basis, flags, keys)
    # A model that was backtested here goes on from its fitted state; rows of ``extra_backtest`` have none.
    fitted = [m for m in models if m != "ridge_event" or calendar is not None]
    out["states"] = states.fitted_states(ready, keys, period_col, "value", fitted, calendar)
    out["forecast"] = materialise(states.roll_forward(out["states"], keys, period_col, calendar=calendar), "forecast")
    out["selected_forecast"] = states.selected_forecast(out["forecast"], out["selection"], keys)
    out["profile"] = series.series_profile(ready, keys, "value", series.target_kind(F.col(TARGET)))
    return out


def write_outputs(outputs: Mapping[str, DataFrame], path: str, partition_cols: Sequence[str] = (TARGET,)) -> dict[str, str]:
    """Each table of a run as parquet, partitioned by target."""
    written = {}
    for name, frame in outputs.items():
        written[name] = f"{path.rstrip('/')}/{name}"
        frame.write.mode("overwrite").partitionBy(*partition_cols).parquet(written[name])
    return written


def run_experiment(
    weekly: DataFrame, path: str, targets: Sequence[str] = series.DEFAULT_TARGETS, demo: bool = False, **options
) -> dict[str, str]:
    """Run every available target and write the output set; sample-only input needs ``demo``."""
    require_columns(weekly, ["period_start"])
    if not demo and "sample_only" in weekly.columns and weekly.filter("sample_only").limit(1).count():
        raise ValueError("the weekly table is a sample; run with demo=True")
    chosen = series.available_targets(weekly, targets)
    if not chosen:
        raise ValueError(f"none of {list(targets)} is in the table")
    return write_outputs(run_targets(weekly, chosen, **options), path)
