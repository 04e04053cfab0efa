"""Forecast draws as long rows: summaries, checks and behavioural scenarios."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import scoring
from pulseframe.session import side_by_side

# --- fixed values -------------------------------------------------------------
MAX_DRAWS = 1000
TOLERANCE = 1.5
LARGE_SHIFT, SMALL_SHIFT = 3.0, 0.33
NARROW, WIDE, ZERO_GAP = 0.7, 1.5, 0.1


def thin(draws: DataFrame, total: int, max_draws: int = MAX_DRAWS) -> DataFrame:
    """Every n-th draw so that at most ``max_draws`` remain."""
    step = max(1, -(-total // max_draws))
    return draws.filter(F.col("draw") % step == 0)


def write_thinned(draws: DataFrame, path: str, run_id: str, total: int, max_draws: int = MAX_DRAWS) -> None:
    """Thinned draws stamped with their run."""
    thin(draws, total, max_draws).withColumns({"run_id": F.lit(run_id), "source_draws": F.lit(total)}).write.mode("overwrite").partitionBy("run_id").parquet(path)


def read_thinned(spark, path: str, run_id: str) -> DataFrame:
    """Draws of the expected run; a file of another run is refused."""
    draws = spark.read.parquet(path)
    if draws.filter(F.col("run_id") != run_id).limit(1).count() or not draws.limit(1).count():
        raise ValueError(f"{path} was not produced by run {run_id!r}")
    return draws


def quantile(column: str | Column, q: float) -> Column:
    return F.percentile(column, F.lit(q))


def summarise_draws(draws: DataFrame, keys: Sequence[str], value: str = "value", level: float = 0.8) -> DataFrame:
    """Mean and central interval per key."""
    tail = round((1.0 - level) / 2.0, 12)
    return draws.groupBy(*keys).agg(
        F.avg(value).alias("mean"), quantile(value, tail).alias("lower"), quantile(value, 1.0 - tail).alias("upper")
    )


def predictive_check(observed: DataFrame, draws: DataFrame, level: float = 0.9, step: str = "step") -> DataFrame:
    """Spread, zero share and interval coverage of replicated observations against the observed ones."""
    bounds = summarise_draws(draws, [step], "value", level)
    inside = F.col("observed").between(F.col("lower"), F.col("upper")).cast("double")
    coverage = observed.join(bounds, step).agg(F.avg(inside).alias("ppc_interval_coverage"))
    seen = observed.agg(
        F.avg("observed").alias("observed_mean"), F.stddev_pop("observed").alias("observed_std"),
        F.avg((F.col("observed") <= 0).cast("double")).alias("observed_zero_share"),
    )
    made = draws.agg(
        F.avg("value").alias("predicted_mean"), F.stddev_pop("value").alias("predicted_std"),
        F.avg((F.col("value") <= 0).cast("double")).alias("predicted_zero_share"), F.count_distinct("draw").alias("draws"),
    )
    return side_by_side(seen, made, coverage)


def dispersion_notes(check: DataFrame) -> DataFrame:
    """Visible failures of the predictive check."""
    ratio = F.when((F.col("observed_std") > 0) & (F.col("predicted_std") > 0), F.col("predicted_std") / F.col("observed_std"))
    gap = F.abs(F.col("observed_zero_share") - F.col("predicted_zero_share"))
    notes = F.array_compact(
        F.array(
            F.when(ratio < NARROW, "less_variable_than_data").when(ratio > WIDE, "more_variable_than_data"),
            F.when(gap > ZERO_GAP, "zero_share_misfit"),
        )
    )
    return check.withColumns({"dispersion_ratio": ratio, "notes": notes})


@dataclass(frozen=True)
class BehaviouralScenario:
    """Hypothetical change of future demand."""

    level_shift: float = 1.0
    event_pulse: float = 1.0
    pulse_periods: int = 1
    trajectory: float = 1.0
    label: str = "scenario"

    def __post_init__(self):
        if min(self.level_shift, self.event_pulse, self.trajectory) <= 0:
            raise ValueError("Scenario multipliers must be positive")
        if self.pulse_periods < 0:
            raise ValueError("pulse_periods cannot be negative")


def with_scenario(draws: DataFrame, scenario: BehaviouralScenario) -> DataFrame:
    """Baseline, scenario and difference per draw and step (steps from 1)."""
    multiplier = scoring.scenario_multiplier(
        F.col("step"), scenario.level_shift, scenario.trajectory, scenario.event_pulse, scenario.pulse_periods
    )
    return draws.withColumnRenamed("value", "baseline").withColumn("scenario", F.col("baseline") * multiplier).withColumn(
        "difference", F.col("scenario") - F.col("baseline")
    )


def scenario_by_step(draws: DataFrame, scenario: BehaviouralScenario, keys: Sequence[str] = (), level: float = 0.8) -> DataFrame:
    """L1: mean and interval of baseline, scenario and difference per step."""
    tail = round((1.0 - level) / 2.0, 12)
    aggregates = []
    for name in ("baseline", "scenario", "difference"):
        aggregates += [
            F.avg(name).alias(f"{name}_mean"), quantile(name, tail).alias(f"{name}_lower"), quantile(name, 1.0 - tail).alias(f"{name}_upper"),
        ]
    return with_scenario(draws, scenario).groupBy(*keys, "step").agg(*aggregates)


def scenario_total(draws: DataFrame, scenario: BehaviouralScenario, keys: Sequence[str] = (), level: float = 0.8) -> DataFrame:
    """L1: the same for the sum over steps, summed per draw first so that the uncertainty is kept."""
    tail = round((1.0 - level) / 2.0, 12)
    totals = with_scenario(draws, scenario).groupBy(*keys, "draw").agg(*[F.sum(c).alias(c) for c in ("baseline", "scenario", "difference")])
    return totals.groupBy(*keys).agg(
        F.avg("baseline").alias("total_baseline"), F.avg("scenario").alias("total_scenario"), F.avg("difference").alias("total_difference_mean"),
        quantile("difference", tail).alias("total_difference_lower"), quantile("difference", 1.0 - tail).alias("total_difference_upper"),
    )


def guardrails(by_step: DataFrame, observed: DataFrame, scenario: BehaviouralScenario, keys: Sequence[str] = (), tolerance: float = TOLERANCE) -> DataFrame:
    """L2: warnings when the scenario leaves what the history can speak to. ``observed (keys, observed)``."""
    peak = by_step.groupBy(*keys).agg(F.max("scenario_mean").alias("scenario_peak"))
    history = observed.groupBy(*keys).agg(F.max("observed").alias("observed_max"))
    joined = peak.join(history, list(keys), "left") if keys else side_by_side(peak, history)
    top = F.col("observed_max")
    fixed = [
        F.lit(f"{name} is a large behavioural change")
        for name in ("level_shift", "event_pulse")
        if not SMALL_SHIFT <= getattr(scenario, name) <= LARGE_SHIFT
    ]
    seen = F.array_compact(F.array(F.when((top > 0) & (F.col("scenario_peak") > top * tolerance), "peak exceeds the observed range"), *fixed))
    return joined.withColumn("warnings", F.when(top.isNull(), F.array(F.lit("no observed history"))).otherwise(seen))
