"""Period aggregates of signals and the coverage audit (C4-C6 inputs, D4-D10, D13, I24, K16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import intent, scoring, timing
from pulseframe.operators import calendar as cal_ops
from pulseframe.operators import series
from pulseframe.session import materialise, require_columns, side_by_side

# --- fixed values -------------------------------------------------------------
PLATFORMS = ("youtube", "reddit")
TRACKED_LABELS = ("high_intent", "frustrated_demand", "nostalgia_reactivation")
UNAVAILABLE = "unavailable"
STATUS_DEMO, STATUS_SEED_CAPPED, STATUS_FULL = "demo_only", "seed_capped_dataset", "full_dataset"


def period_counts(
    df: DataFrame, ts_col: str = "timestamp", freq: str = "W-MON", series_cols: Sequence[str] = ()
) -> DataFrame:
    """C4: rows per period on the gap-free index; rows without a time are left out."""
    counted = (
        df.filter(F.col(ts_col).isNotNull())
        .groupBy(*series_cols, timing.period_start(F.col(ts_col), freq).alias("period_start"))
        .agg(F.count("*").alias("total_comments"))
    )
    return series.fill_spine(counted, series_cols, "period_start", ["total_comments"], freq)


def aggregate_periods(
    df: DataFrame,
    freq: str = "W-MON",
    series_cols: Sequence[str] = (),
    calendar: DataFrame | None = None,
    platforms: Sequence[str] = PLATFORMS,
    window_weeks: float = timing.EVENT_WINDOW_WEEKS,
    half_life_weeks: float = timing.EVENT_HALF_LIFE_WEEKS,
) -> DataFrame:
    """D4-D7 with C4 and C5: one row per period, only columns the input supports.

    One scan and one shuffle: every count is a conditional aggregate. Empty periods have zero counts and a
    zero proxy sum; their rates and means stay null.
    """
    require_columns(df, ["timestamp", *series_cols])
    have = set(df.columns)
    aggregates = [F.count("*").alias("total_comments")]
    zero = ["total_comments"]
    rates: dict[str, str] = {}

    def count(name, condition):
        aggregates.append(F.count_if(condition).alias(name))
        zero.append(name)

    if "source" in have:
        for platform in platforms:
            count(f"{platform}_comments", F.lower(F.col("source").cast("string")).contains(platform))
    if "intent_label" in have:
        count("actionable_count", F.col("intent_label").isin(*intent.ACTIONABLE_CLASSES))
        rates["actionable_rate"] = "actionable_count"
        for label in TRACKED_LABELS:
            count(f"{label}_count", F.col("intent_label") == label)
            rates[f"{label}_rate"] = f"{label}_count"
    if "actionable_probability" in have:
        usable = F.col("actionable_probability").isNotNull()
        if "probability_source" in have:
            usable = usable & (F.coalesce("probability_source", F.lit("")) != UNAVAILABLE)
        p = F.when(usable, F.col("actionable_probability"))
        aggregates += [
            F.sum(p).alias("actionable_probability_mass"),
            F.avg(p).alias("mean_actionable_probability"),
        ]
        zero.append("actionable_probability_mass")
        count("n_with_probability", usable)
        rates["probability_coverage"] = "n_with_probability"
    if "vader_compound" in have:
        aggregates.append(F.avg("vader_compound").alias("mean_sentiment"))
    if "demand_score" in have:
        aggregates.append(F.avg("demand_score").alias("mean_demand_score"))

    grouped = (
        df.filter(F.col("timestamp").isNotNull())
        .groupBy(*series_cols, timing.period_start(F.col("timestamp"), freq).alias("period_start"))
        .agg(*aggregates)
    )
    out = series.fill_spine(grouped, series_cols, "period_start", zero, freq)
    if rates:
        total = F.col("total_comments")
        out = out.withColumns({name: scoring.rate(F.col(src), total) for name, src in rates.items()})
    if calendar is not None:
        out = cal_ops.event_features(out, calendar, "period_start", None, window_weeks, half_life_weeks)
        out = out.withColumn("event_annotation", F.lit("retrospective"))
    return out


def partial_periods(df: DataFrame, platforms: Sequence[str] = PLATFORMS, freq: str = "W-MON") -> DataFrame:
    """Counts and sums of D4-D7 per period, which add up over parts of the input (see ``merged_periods``).

    Needs timestamp, source, intent_label, actionable_probability, probability_source, vader_compound, demand_score.
    """
    usable = F.col("actionable_probability").isNotNull() & (F.coalesce("probability_source", F.lit("")) != UNAVAILABLE)
    counts = {"total_comments": F.lit(True), **{f"{p}_comments": F.lower(F.col("source").cast("string")).contains(p) for p in platforms},
              "actionable_count": F.col("intent_label").isin(*intent.ACTIONABLE_CLASSES),
              **{f"{c}_count": F.col("intent_label") == c for c in TRACKED_LABELS}, "n_with_probability": usable}
    sums = {"actionable_probability_mass": F.when(usable, F.col("actionable_probability")), "_sentiment": F.col("vader_compound"), "_score": F.col("demand_score")}
    return df.filter(F.col("timestamp").isNotNull()).groupBy(timing.period_start(F.col("timestamp"), freq).alias("period_start")).agg(
        *[F.count_if(c).alias(n) for n, c in counts.items()], *[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in sums.items()],
        F.count("vader_compound").alias("_sentiment_n"), F.count("demand_score").alias("_score_n"))


def merged_periods(parts: DataFrame) -> DataFrame:
    """D4-D7 of periods with rows, from the parts of ``partial_periods``."""
    values = [c for c in parts.columns if c != "period_start"]
    whole = parts.groupBy("period_start").agg(*[F.sum(c).alias(c) for c in values])
    counted = [c for c in values if c.endswith("_count")]
    total = F.col("total_comments")
    return whole.withColumns({
        **{c.removesuffix("_count") + "_rate": scoring.rate(F.col(c), total) for c in counted},
        "probability_coverage": scoring.rate(F.col("n_with_probability"), total),
        "mean_actionable_probability": F.try_divide("actionable_probability_mass", "n_with_probability"),
        "mean_sentiment": F.try_divide("_sentiment", "_sentiment_n"), "mean_demand_score": F.try_divide("_score", "_score_n"),
    }).drop("_sentiment", "_sentiment_n", "_score", "_score_n")


def count_quantiles(periods: DataFrame, count_col: str = "total_comments", series_cols: Sequence[str] = ()) -> DataFrame:
    """Exact linear quantiles of the period counts."""
    c = F.col(count_col).cast("double")
    return periods.groupBy(*series_cols).agg(
        F.min(c).alias("min"),
        F.percentile(c, F.lit(0.25)).alias("p25"),
        F.median(c).alias("median"),
        F.percentile(c, F.lit(0.75)).alias("p75"),
        F.max(c).alias("max"),
        F.avg(c).alias("mean"),
    )


def periods_per_source(df: DataFrame, freq: str = "W-MON") -> DataFrame:
    """Number of periods with at least one row per source."""
    period = timing.period_start(F.col("timestamp"), freq)
    return df.filter(F.col("timestamp").isNotNull()).groupBy("source").agg(F.count_distinct(period).alias("periods"))


def daily_sentiment(df: DataFrame) -> DataFrame:
    """Mean compound score per day with data."""
    return (
        df.filter(F.col("timestamp").isNotNull() & F.col("vader_compound").isNotNull())
        .groupBy(F.date_trunc("day", "timestamp").alias("day"))
        .agg(F.avg("vader_compound").alias("mean_sentiment"))
    )


def coverage_audit(
    df: DataFrame, freq: str = "W-MON", calendar: DataFrame | None = None, min_event_periods: int = 2
) -> DataFrame:
    """One row with range, period counts and their quantiles, longest dense run, gaps and usable events.

    What has as many entries as there are sources, gaps or events is in ``coverage_details``.
    """
    periods = period_counts(df, "timestamp", freq)
    rows = df.agg(
        F.min("timestamp").alias("earliest"),
        F.max("timestamp").alias("latest"),
        F.count("timestamp").alias("rows_with_timestamp"),
        F.count_if(F.col("timestamp").isNull()).alias("rows_without_timestamp"),
    )
    shape = periods.agg(
        F.count("*").alias("observed_periods"),
        F.count_if(F.col("total_comments") > 0).alias("non_empty_periods"),
    ).withColumn("complexity_tier", series.complexity_tier(F.col("non_empty_periods")))
    dense = series.longest_dense_run(periods, [], "period_start", "total_comments").agg(
        F.coalesce(F.max("longest_dense_run"), F.lit(0).cast("bigint")).alias("longest_dense_run")
    )
    gaps = series.gap_runs(periods, [], "period_start", "total_comments").agg(F.count("*").alias("gaps"))
    spread = count_quantiles(periods).select([F.col(c).alias(f"comments_per_period_{c}") for c in ("min", "p25", "median", "p75", "max", "mean")])
    parts = [rows, shape, dense, gaps, spread]
    if calendar is not None:
        usable = cal_ops.event_usability(periods, calendar, "period_start", min_event_periods)
        parts.append(usable.agg(F.count_if("usable").alias("usable_event_periods")))
    return side_by_side(*parts)


def coverage_details(
    df: DataFrame, freq: str = "W-MON", calendar: DataFrame | None = None, min_event_periods: int = 2, min_gap: int = 2
) -> DataFrame:
    """The lists of the audit record as rows (section, item, start, end, periods, periods_before, periods_after, usable).

    Sections are ``source`` (periods with rows of it), ``gap`` (runs of empty periods, with their first and last) and
    ``event`` (date, periods before and after, usable). Without timestamps there are no rows, as there is no period.
    """
    periods = materialise(period_counts(df, "timestamp", freq), "periods")
    found = periods_per_source(df, freq).select(F.lit("source").alias("section"), F.col("source").cast("string").alias("item"), "periods")
    gaps = series.gap_runs(periods, [], "period_start", "total_comments", min_gap).select(F.lit("gap").alias("section"), "start", "end", "periods")
    out = found.unionByName(gaps, allowMissingColumns=True)
    if calendar is not None and not periods.isEmpty():
        judged = cal_ops.event_usability(periods, calendar, "period_start", min_event_periods)
        out = out.unionByName(judged.select(
            F.lit("event").alias("section"), F.col("event_name").alias("item"), F.col("event_date").alias("start"), "periods_before", "periods_after", "usable"
        ), allowMissingColumns=True)
    else:
        kinds = {"periods_before": "bigint", "periods_after": "bigint", "usable": "boolean"}
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})
    return out.select("section", "item", "start", "end", "periods", "periods_before", "periods_after", "usable")


def evaluation_status(demo: bool, seed_capped: bool) -> str:
    return STATUS_DEMO if demo else STATUS_SEED_CAPPED if seed_capped else STATUS_FULL


def weekly_dataset(
    signals: DataFrame,
    calendar: DataFrame | None = None,
    freq: str = "W-MON",
    series_cols: Sequence[str] = (),
    demo: bool = False,
    seed_capped: bool = False,
) -> DataFrame:
    """Period table stamped with its evaluation status and whether volumes are representative."""
    return aggregate_periods(signals, freq, series_cols, calendar).withColumns(
        {
            "evaluation_status": F.lit(evaluation_status(demo, seed_capped)),
            "volume_representative": F.lit(not demo and not seed_capped),
            "sample_only": F.lit(demo),
        }
    )
