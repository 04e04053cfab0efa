"""Forecast errors, monitoring, ranking sensitivity and model choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions import scoring
from pulseframe.operators.backtest import COMPLEXITY
from pulseframe.operators.series import in_order
from pulseframe.session import materialise

# --- fixed values -------------------------------------------------------------
EPSILON = 1e-9
ROLLING_WINDOW = 4
CONSECUTIVE_PERIODS = 4
TOLERANCE_FRACTION = 0.10
INTERVAL_LEVEL = 0.8
MIN_FORECASTS = 12
MAX_COVERAGE_GAP = 0.25
OTHER_COMPLEXITY = 5
MAX_GAP_SHARE = 0.5


def _finite(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        value = F.col(c).cast("double")
        ok = ok & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return ok


def forecast_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error measures of finite pairs and interval quality per key, in one aggregation."""
    pair = _finite("actual", "forecast")
    error = F.when(pair, F.col("forecast") - F.col("actual"))
    actual = F.when(pair, F.abs("actual"))
    bounds = _finite("lower", "upper")
    inside = F.when(_finite("actual", "lower", "upper"), F.col("actual").between(F.col("lower"), F.col("upper")).cast("double"))
    total = F.sum(actual)
    scale = F.avg(actual)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(total > EPSILON, F.sum(F.abs(error)) / total).alias("wape"),
        F.avg(error).alias("bias"),
        F.when(scale > EPSILON, F.avg(error) / scale).alias("relative_bias"),
        F.avg(inside).alias("interval_coverage"),
        F.avg(F.when(bounds, F.col("upper") - F.col("lower"))).alias("mean_interval_width"),
    )


def naive_scale(series_df: DataFrame, series_cols: Sequence[str], period_col: str, target: str, seasonality: int = 1) -> DataFrame:
    """In-sample mean absolute naive error per series, null when degenerate."""
    step = F.abs(F.col(target) - F.lag(target, seasonality).over(in_order(series_cols, period_col)))
    scale = series_df.filter(_finite(target)).select(*series_cols, step.alias("_step")).groupBy(*series_cols).agg(F.avg("_step").alias("_scale"))
    return scale.select(*series_cols, F.when(F.col("_scale") > EPSILON, F.col("_scale")).alias("naive_scale"))


def with_mase(metrics: DataFrame, scale: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    """Mean absolute error against the naive scale of the series."""
    return metrics.join(scale, list(series_cols), "left").withColumn("mase", F.try_divide("mae", "naive_scale")).drop("naive_scale")


def _per_model(series_cols: Sequence[str]):
    return Window.partitionBy(*series_cols, "model").orderBy("origin", "horizon_step")


def monitoring_table(bt: DataFrame, series_cols: Sequence[str] = (), window: int = ROLLING_WINDOW) -> DataFrame:
    """Signed error, interval hit and rolling error per forecast."""
    recent = _per_model(series_cols).rowsBetween(-(max(1, window) - 1), 0)
    rolling_actual = F.abs(F.sum("actual").over(recent))
    return bt.withColumn("signed_error", F.col("forecast") - F.col("actual")).withColumn(
        "absolute_error", F.abs("signed_error")
    ).withColumns(
        {
            "interval_hit": F.col("actual").between(F.col("lower"), F.col("upper")).cast("int"),
            "interval_width": F.col("upper") - F.col("lower"),
            "rolling_mae": F.avg("absolute_error").over(recent),
            "rolling_bias": F.avg("signed_error").over(recent),
            "rolling_wape": F.when(rolling_actual > 0, F.sum("absolute_error").over(recent) / rolling_actual),
        }
    )


def bias_runs(
    monitoring: DataFrame, series_cols: Sequence[str] = (), tolerance: float = TOLERANCE_FRACTION, minimum: int = CONSECUTIVE_PERIODS
) -> DataFrame:
    """E5: longest run of material same-signed errors per direction, the earliest of equals."""
    order = _per_model(series_cols)
    whole = Window.partitionBy(*series_cols, "model")
    material = F.abs("signed_error") > F.avg(F.abs("actual")).over(whole) * tolerance
    signed = monitoring.withColumns(
        {"_sign": F.when(material, F.signum("signed_error")).otherwise(0.0), "_pos": F.row_number().over(order)}
    )
    starts = F.coalesce(F.col("_sign") != F.lag("_sign").over(order), F.lit(True)).cast("int")
    islands = signed.withColumn("_new", starts).withColumn(
        "_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    runs = (
        islands.filter(F.col("_sign") != 0)
        .groupBy(*series_cols, "model", "_sign", "_island")
        .agg(
            F.count("*").alias("length"), F.min("_pos").alias("_first"),
            F.max_by("origin", "_pos").alias("ends_at_origin"), F.avg("signed_error").alias("mean_signed_error"),
        )
        .filter(F.col("length") >= minimum)
    )
    direction = F.when(F.col("_sign") > 0, "over_forecasting").otherwise("under_forecasting")
    best = F.max_by(F.struct("length", "ends_at_origin", "mean_signed_error"), F.struct(F.col("length"), -F.col("_first")))
    return runs.groupBy(*series_cols, "model", direction.alias("direction")).agg(best.alias("_run")).select(
        *series_cols, "model", "direction", "_run.*"
    )


def bias_flags(
    monitoring: DataFrame, series_cols: Sequence[str] = (), tolerance: float = TOLERANCE_FRACTION,
    minimum: int = CONSECUTIVE_PERIODS, interval_level: float = INTERVAL_LEVEL, evidence: int = MIN_FORECASTS,
) -> DataFrame:
    """Evidence, bias and calibration verdicts per model; too few forecasts withhold the verdict."""
    keys = [*series_cols, "model"]
    runs = bias_runs(monitoring, series_cols, tolerance, minimum).groupBy(*keys).agg(
        F.max("length").alias("longest_bias_run"), F.count("*").alias("_runs")
    )
    stats = monitoring.groupBy(*keys).agg(
        F.count("*").alias("n_forecasts"),
        F.avg("signed_error").alias("mean_signed_error"),
        (F.avg(F.abs("actual")) * tolerance).alias("materiality_threshold"),
        F.avg("interval_hit").alias("interval_coverage"),
    )
    sufficient = F.col("n_forecasts") >= evidence
    return stats.join(runs, keys, "left").withColumns(
        {
            "sufficient_evidence": sufficient,
            "persistent_bias": F.when(sufficient, F.col("_runs").isNotNull()),
            "coverage_gap_vs_nominal": F.col("interval_coverage") - interval_level,
            "interval_calibration": F.when(sufficient, scoring.coverage_wording(F.col("interval_coverage"), interval_level)).otherwise("insufficient evidence"),
        }
    ).fillna(0, ["longest_bias_run"]).drop("_runs")


def complexity_of(model: Column) -> Column:
    pairs = [F.lit(x) for item in COMPLEXITY.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[model], F.lit(OTHER_COMPLEXITY))


def comparison_table(bt: DataFrame, flags: DataFrame, series_cols: Sequence[str] = (), scale: DataFrame | None = None) -> DataFrame:
    """Metrics, complexity, verdicts and number of origins per model."""
    keys = [*series_cols, "model"]
    metrics = forecast_metrics(bt, keys)
    if scale is not None:
        metrics = with_mase(metrics, scale, series_cols)
    origins = bt.groupBy(*keys).agg(F.count_distinct("origin").alias("origins"))
    verdicts = flags.select(
        *keys,
        F.coalesce(F.col("persistent_bias").cast("string"), F.lit("unknown")).alias("persistent_bias"),
        "interval_calibration", F.col("n_forecasts").alias("bias_evidence_forecasts"),
    )
    return metrics.join(origins, keys).join(verdicts, keys, "left").withColumn("complexity", complexity_of(F.col("model")))


def matched_origins(bt: DataFrame, reference_model: str, series_cols: Sequence[str] = ()) -> DataFrame:
    """Rows on the origins of the reference model, for models scored on every one of them."""
    keys = list(series_cols)
    origins = bt.filter(F.col("model") == reference_model).select(*keys, "origin").distinct()
    subset = bt.join(origins, [*keys, "origin"], "left_semi")
    per_model = subset.groupBy(*keys, "model").agg(F.count_distinct("origin").alias("_have"))
    wanted = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    # The reference model has all origins, so the maximum is their number.
    complete = per_model.withColumn("_all", F.max("_have").over(wanted)).filter("_have = _all")
    return subset.join(complete.select(*keys, "model"), [*keys, "model"], "left_semi")


def per_origin_errors(bt: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """Absolute error, actual level and WAPE per (origin, model)."""
    return bt.groupBy(*series_cols, "origin", "model").agg(
        F.count("*").alias("n"),
        F.sum(F.abs("actual")).alias("actual_sum"),
        F.sum(F.abs(F.col("actual") - F.col("forecast"))).alias("abs_error_sum"),
    ).withColumn("wape", _ratio(F.col("abs_error_sum"), F.col("actual_sum")))


def _ratio(error: Column, actual: Column) -> Column:
    return F.when(actual > 0, error / actual)


def _leader(value: str = "wape") -> Column:
    return F.min(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("model").alias("m")))).getField("m")


def leave_one_origin_out(per_origin: DataFrame, series_cols: Sequence[str] = ()) -> DataFrame:
    """WAPE of each model without each origin, as total minus own sums, and the leader of that run."""
    keys = list(series_cols)
    model = Window.partitionBy(*keys, "model")
    dropped = per_origin.select(
        *keys, F.col("origin").alias("dropped_origin"), "model",
        (F.sum("n").over(model) - F.col("n")).alias("_rest"),
        _ratio(
            F.sum("abs_error_sum").over(model) - F.col("abs_error_sum"),
            F.round(F.sum("actual_sum").over(model) - F.col("actual_sum"), 9),
        ).alias("wape"),
    ).filter("_rest > 0").drop("_rest")
    leaders = dropped.groupBy(*keys, "dropped_origin").agg(_leader().alias("leader"))
    return dropped.join(leaders, [*keys, "dropped_origin"])


def ranking_sensitivity(bt: DataFrame, reference_model: str, series_cols: Sequence[str] = (), evidence: int = MIN_FORECASTS) -> DataFrame:
    """Leader, runner-up, the origin behind their gap and whether the ranking is fragile."""
    keys = list(series_cols)
    series_key = keys or [F.lit("all").alias("_one")]
    subset = matched_origins(bt, reference_model, keys)
    # One row per (origin, model); written once because five steps below read it.
    origin_table = materialise(per_origin_errors(subset, keys), "origins")
    models = origin_table.groupBy(*series_key, "model").agg(
        F.sum("n").alias("_n"), _ratio(F.sum("abs_error_sum"), F.sum("actual_sum")).alias("wape")
    )
    join_on = keys or ["_one"]
    ranked = F.array_sort(F.collect_list(F.when(F.col("wape").isNotNull(), F.struct(F.col("wape"), F.col("model")))))
    overall = models.groupBy(*join_on).agg(
        ranked.alias("_ranked"),  # one entry per model
        F.min("_n").alias("n_forecasts_per_model"),
        F.bool_or(F.col("model") == reference_model).alias("_has_reference"),
    )
    at = lambda i, field: F.get("_ranked", F.lit(i)).getField(field)
    overall = overall.select(
        *join_on, "n_forecasts_per_model", at(0, "model").alias("leader"), at(0, "wape").alias("leader_wape"),
        at(1, "model").alias("runner_up"), "_has_reference",
    )
    challenger = F.when((F.col("leader") != reference_model) & F.col("_has_reference"), F.lit(reference_model)).otherwise(F.col("runner_up"))
    overall = overall.withColumn("challenger", challenger)
    errors = origin_table.select(*series_key, "origin", "model", "abs_error_sum").join(overall, join_on)
    side = F.when(F.col("model") == F.col("challenger"), F.col("abs_error_sum")).when(
        F.col("model") == F.col("leader"), -F.col("abs_error_sum")
    )
    gaps = errors.groupBy(*join_on, "origin").agg(F.sum(side).alias("_gap"))
    dominant = gaps.groupBy(*join_on).agg(
        F.count("*").alias("n_origins"), F.sum("_gap").alias("_total"), F.max("_gap").alias("_largest"),
        F.max_by("origin", F.struct("_gap", (-F.col("origin")).alias("o"))).alias("_where"),
    )
    loo = leave_one_origin_out(origin_table, keys).select(*series_key, "dropped_origin", F.col("leader").alias("_loo")).distinct()
    stable = loo.join(overall.select(*join_on, "leader"), join_on).groupBy(*join_on).agg(
        F.bool_and(F.coalesce(F.col("_loo") == F.col("leader"), F.lit(False))).alias("leader_stable")
    )
    share = F.when(F.col("_total") > 0, F.col("_largest") / F.col("_total"))
    out = overall.join(dominant, join_on).join(stable, join_on, "left").select(
        *keys, "n_forecasts_per_model", "n_origins", "leader", "runner_up", F.col("challenger").alias("gap_compared_against"),
        F.coalesce("leader_stable", F.lit(False)).alias("leader_stable_under_leave_one_out"),
        F.when(F.col("_total") > 0, F.col("_where")).alias("dominant_origin"),
        share.alias("dominant_origin_gap_share"),
    )
    fragile = (
        (F.col("n_forecasts_per_model") < evidence)
        | ~F.col("leader_stable_under_leave_one_out")
        | F.coalesce(F.col("dominant_origin_gap_share") > MAX_GAP_SHARE, F.lit(False))
    )
    return out.withColumn("fragile", fragile)


def select_model(comparison: DataFrame, flags: DataFrame, series_cols: Sequence[str] = (), interval_level: float = INTERVAL_LEVEL) -> DataFrame:
    """chosen model per series with the reasons.

    Order: WAPE, MAE, complexity. Unproven models are never promoted; biased or badly calibrated ones give way
    to the next proven model; without a sound model the best proven one is reported, else the overall leader.
    """
    keys = list(series_cols)
    judged = comparison.select(*keys, "model", "wape", "mae", "complexity").join(
        flags.select(
            *keys, "model", "sufficient_evidence", "interval_coverage", F.col("persistent_bias").alias("_biased")
        ), [*keys, "model"], "left",
    )
    proven = F.coalesce("sufficient_evidence", F.lit(True))
    unsound = proven & (
        F.coalesce("_biased", F.lit(False))
        | F.coalesce(F.abs(F.col("interval_coverage") - interval_level) > MAX_COVERAGE_GAP, F.lit(False))
    )
    tier = F.when(proven & ~unsound, 0).when(proven, 1).otherwise(2)
    last = F.lit(float("inf"))
    rank = F.struct(F.coalesce("wape", last), F.coalesce("mae", last), F.col("complexity"), F.col("model"))
    summary = judged.withColumns({"_tier": tier, "_rank": rank}).groupBy(*keys).agg(
        F.min_by("model", "_rank").alias("leader"),
        F.min("wape").alias("leader_wape"),
        F.min_by("model", F.struct("_tier", "_rank")).alias("selected"),
        F.min("_tier").alias("_best_tier"),
        F.array_sort(F.collect_list(F.when(F.col("_tier") == 2, F.col("model")))).alias("_unproven"),
    )
    moved = F.col("selected") != F.col("leader")
    reason = F.array_compact(
        F.array(
            F.concat(F.lit("Lowest WAPE: "), "leader", F.lit(" ("), F.format_number("leader_wape", 3), F.lit(").")),
            F.when(F.size("_unproven") > 0, F.concat(F.lit("Too few forecasts to judge: "), F.array_join("_unproven", ", "), F.lit("."))),
            F.when(F.col("_best_tier") == 2, F.lit("No model has enough forecasts; the lowest WAPE is reported without a recommendation."))
            .when(F.col("_best_tier") == 1, F.lit("Every proven model is biased or badly calibrated; the lowest error is reported."))
            .when(moved, F.concat("leader", F.lit(" gave way to "), "selected", F.lit(".")))
            .otherwise(F.concat("selected", F.lit(" also passes the bias and calibration checks."))),
        )
    )
    return summary.select(*keys, "selected", "leader", F.col("_best_tier").alias("tier"), reason.alias("reasoning"))


def forecast_summary(bt: DataFrame, flags: DataFrame, selection: DataFrame, series_cols: Sequence[str]) -> DataFrame:
    """One JSON document per series: models with metrics and verdicts, and the selection."""
    keys = list(series_cols)
    metrics = forecast_metrics(bt, [*keys, "model"]).join(flags.select(*keys, "model", "sufficient_evidence", "persistent_bias"), [*keys, "model"])
    # One struct per model.
    models = F.array_sort(F.collect_list(F.struct("model", "n", F.round("wape", 6).alias("wape"), "sufficient_evidence", "persistent_bias")))
    nested = metrics.groupBy(*keys).agg(models.alias("models")).join(selection.select(*keys, "selected"), keys)
    return nested.select(*keys, F.to_json(F.struct("selected", "models")).alias("document"))
