"""Score weights, ratios and closed-form maths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
INTENT_WEIGHTS = {
    "high_intent": 2.0,
    "nostalgia_reactivation": 1.5,
    "new_customer_interest": 1.2,
    "frustrated_demand": 1.0,
    "content_drought_fatigue": 0.6,
    "confusion_barrier": -1.0,
    "expectation_decay": -1.5,
    "general_discussion": 0.1,
}
SENTIMENT_WEIGHTS = {"positive": 1.0, "neutral": 0.3, "negative": -0.5}
RISK_INTENTS = (
    "frustrated_demand",
    "confusion_barrier",
    "content_drought_fatigue",
    "expectation_decay",
)
ACTIVATION_INTENTS = ("high_intent", "nostalgia_reactivation", "new_customer_interest")
COVERAGE_TOLERANCE = 0.10


def weight(label: Column, weights: dict[str, float]) -> Column:
    """Weight of a label, 0 for unknown or null labels."""
    pairs = [F.lit(x) for item in weights.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[label], F.lit(0.0))


def demand_score(intent: Column, sentiment: Column, engagement: Column) -> Column:
    """(intent + sentiment weight) lifted by log engagement; unusable engagement counts as 0."""
    base = weight(intent, INTENT_WEIGHTS) + weight(sentiment, SENTIMENT_WEIGHTS)
    return base * (F.lit(1.0) + engagement_weight(engagement) / F.lit(5.0))


def engagement_weight(engagement: Column) -> Column:
    usable = F.coalesce(engagement.cast("string").try_cast("double"), F.lit(0.0))
    usable = F.when(F.isnan(usable), F.lit(0.0)).otherwise(usable)
    return F.log1p(F.greatest(usable, F.lit(0.0)))


def rate(numerator: Column, denominator: Column) -> Column:
    """Share, null when the denominator is not positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """I16: Wilson interval of a proportion; null for n = 0."""
    total = F.when(n > 0, n.cast("double"))
    p = successes.cast("double") / total
    denominator = F.lit(1.0) + F.lit(z * z) / total
    centre = (p + F.lit(z * z) / (F.lit(2.0) * total)) / denominator
    spread = F.sqrt(p * (F.lit(1.0) - p) / total + F.lit(z * z) / (F.lit(4.0) * total * total))
    half = F.lit(z) * spread / denominator
    return centre - half, centre + half


def hill(x: Column, alpha: Column, theta: Column) -> Column:
    """Saturation x^a / (x^a + theta^a); 0 at x = 0."""
    powered = F.pow(x, alpha)
    return powered / (powered + F.pow(theta, alpha))


def scenario_multiplier(
    step: Column,
    level: float = 1.0,
    trajectory: float = 1.0,
    pulse: float = 1.0,
    pulse_periods: int = 1,
) -> Column:
    """Level x trajectory^(step-1), times the pulse in the first periods (steps from 1)."""
    base = F.lit(float(level)) * F.pow(F.lit(float(trajectory)), step - 1)
    return F.when(step <= pulse_periods, base * F.lit(float(pulse))).otherwise(base)


def coverage_wording(coverage: Column, nominal: float, tolerance: float = COVERAGE_TOLERANCE) -> Column:
    """Interval calibration in words."""
    gap = coverage - F.lit(float(nominal))
    return (
        F.when(coverage.isNull(), "unknown")
        .when(F.abs(gap) <= tolerance, "close to nominal")
        .when(gap < 0, "too narrow (overconfident)")
        .otherwise("too wide (underconfident)")
    )


def uncertainty(probability: Column, threshold: Column) -> Column:
    """1 at the threshold, falling with distance; 0.5 without a probability."""
    return F.coalesce(F.lit(1.0) - F.abs(probability - threshold), F.lit(0.5))


def near_threshold(probability: Column, threshold: Column, band: float = 0.10) -> Column:
    return F.coalesce(F.abs(probability - threshold) < band, F.lit(False))
