"""Row scores and parent-level aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import intent, scoring
from pulseframe.session import require_columns


def score_signals(df: DataFrame) -> DataFrame:
    """Weights, demand score and risk/activation flags per row."""
    require_columns(df, ["intent_label", "sentiment_label", "engagement"])
    label, sentiment, engagement = F.col("intent_label"), F.col("sentiment_label"), F.col("engagement")
    return df.withColumns(
        {
            "intent_weight": scoring.weight(label, scoring.INTENT_WEIGHTS),
            "sentiment_weight": scoring.weight(sentiment, scoring.SENTIMENT_WEIGHTS),
            "engagement_weight": scoring.engagement_weight(engagement),
            "demand_score": scoring.demand_score(label, sentiment, engagement),
            "risk_score": F.coalesce(label.isin(*scoring.RISK_INTENTS), F.lit(False)).cast("int"),
            "activation_score": F.coalesce(label.isin(*scoring.ACTIVATION_INTENTS), F.lit(False)).cast("int"),
        }
    )


def share(condition: Column) -> Column:
    """Share of rows that meet a condition; null conditions count as not met."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def dominant_label(df: DataFrame, keys: Sequence[str], label_col: str, name: str) -> DataFrame:
    """Most frequent label per key, ties to the alphabetically first one."""
    counted = df.groupBy(*keys, F.coalesce(F.col(label_col), F.lit("nan")).alias("_label")).agg(
        F.count("*").alias("_n")
    )
    # min over (-count, label): the highest count first, then the first label.
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_label").alias("label")))
    return counted.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.label").alias(name))


def parent_scores(scored: DataFrame) -> DataFrame:
    """D1 with D2: one row per parent, null parents form a group of their own.

    Counting per (parent, label) first means a hot parent reaches the second shuffle as a handful of rows.
    """
    require_columns(scored, ["parent_id"])
    label = F.coalesce(F.col("intent_label"), F.lit("nan"))
    partial = scored.groupBy("parent_id", label.alias("_label")).agg(
        F.count("*").alias("_n"),
        F.sum("demand_score").alias("_demand"),
        F.count("demand_score").alias("_demand_n"),
        F.sum("risk_score").alias("_risk"),
        F.sum("activation_score").alias("_activation"),
        F.count_if(F.col("sentiment_label") == "positive").alias("_positive"),
        F.count_if(F.col("sentiment_label") == "negative").alias("_negative"),
    )
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_label").alias("label")))
    return (
        partial.groupBy("parent_id")
        .agg(
            F.sum("_n").alias("total_signals"),
            F.try_divide(F.sum("_demand"), F.sum("_demand_n")).alias("mean_demand_score"),
            F.sum("_risk").alias("total_risk_score"),
            F.sum("_activation").alias("total_activation_score"),
            best.alias("_best"),
            (F.sum("_positive") / F.sum("_n")).alias("positive_share"),
            (F.sum("_negative") / F.sum("_n")).alias("negative_share"),
        )
        .select(
            "parent_id",
            "total_signals",
            "mean_demand_score",
            "total_risk_score",
            "total_activation_score",
            F.col("_best.label").alias("dominant_intent"),
            "positive_share",
            "negative_share",
        )
    )


def headline(scored: DataFrame) -> DataFrame:
    """Totals and shares over all rows."""
    return scored.agg(
        F.count("*").alias("total_signals"),
        F.coalesce(share(F.col("sentiment_label") == "positive"), F.lit(0.0)).alias("positive_share"),
        F.coalesce(share(F.col("sentiment_label") == "negative"), F.lit(0.0)).alias("negative_share"),
        F.coalesce(F.sum("activation_score"), F.lit(0)).alias("activation_signals"),
        F.coalesce(F.sum("risk_score"), F.lit(0)).alias("risk_signals"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def sentiment_vs_intent(df: DataFrame, label_col: str = "intent_label") -> DataFrame:
    """How often tone and intent point apart."""
    positive = F.col("sentiment_label") == "positive"
    negative = F.col("sentiment_label") == "negative"
    general = F.col(label_col) == intent.GENERAL
    return df.agg(
        F.count_if(positive).alias("positive"),
        F.count_if(positive & general).alias("positive_general"),
        F.count_if(negative).alias("negative"),
        F.count_if(negative & ~F.coalesce(general, F.lit(False))).alias("negative_actionable"),
    )


def top_rows(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    """the ``n`` highest rows, ties broken by an id."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie)).limit(n)


def top_risk_rows(scored: DataFrame, tie: str, n: int = 25) -> DataFrame:
    """Highest demand among the risk rows."""
    return top_rows(scored.filter(F.col("risk_score") > 0), "demand_score", tie, n)
