"""Announcement calendar, as-of annotation and window summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions import text, timing
from pulseframe.operators import ordered
from pulseframe.session import materialise, require_columns

# --- fixed values -------------------------------------------------------------
PRE_EVENT = "pre_announcement"
MAJOR_TYPES = ("trailer", "announcement", "showcase", "release_date", "release")
TRAILER_TYPES = ("trailer", "showcase")

#: Slices a hot day is cut into.
DAY_SLICES = 8


def prepare_calendar(raw: DataFrame) -> DataFrame:
    """A10: parse dates, drop unusable ones, add window slug, flags and the announcement default."""
    require_columns(raw, ["event_date", "event_name"])
    columns = raw.columns
    kind = F.lower(F.trim(F.col("event_type").cast("string"))) if "event_type" in columns else F.lit("")
    announced = (
        F.try_to_timestamp(F.col("announced_date").cast("string"))
        if "announced_date" in columns
        else F.lit(None).cast("timestamp")
    )
    return (
        raw.withColumn("event_date", F.try_to_timestamp(F.col("event_date").cast("string")))
        .filter(F.col("event_date").isNotNull())
        .withColumns(
            {
                "event_window": F.concat(F.lit("post_"), text.slug(F.col("event_name"))),
                "major_announcement_flag": F.coalesce(kind.isin(*MAJOR_TYPES), F.lit(False)).cast("int"),
                "trailer_flag": F.coalesce(kind.isin(*TRAILER_TYPES), F.lit(False)).cast("int"),
                "announced_date": F.coalesce(announced, F.col("event_date")),
            }
        )
    )


def _latest_per_date(calendar: DataFrame) -> DataFrame:
    """One event per date: of several on one date the last by name counts."""
    payload = [c for c in calendar.columns if c != "event_date"]
    best = F.max_by(F.struct(*payload), F.col("event_name"))
    return calendar.groupBy("event_date").agg(best.alias("e")).select("event_date", "e.*")


def event_intervals(calendar: DataFrame) -> DataFrame:
    """Disjoint intervals ``[event_date, next_date)``; the last one is open."""
    # The window runs over the distinct event dates only.
    order = Window.partitionBy(F.lit(1)).orderBy("event_date")
    return _latest_per_date(calendar).withColumn("next_date", F.lead("event_date").over(order))


def annotate_events(
    signals: DataFrame, calendar: DataFrame, ts_col: str = "timestamp", salt_col: str | None = None
) -> DataFrame:
    """Nearest event at or before each signal; rows without a time are kept.

    Each interval between two events is cut into days and joined on (day, slice), so a hot day is many tasks; the last
    event, whose interval is open, is one row and enters as literals. The signals may be a stream.
    """
    require_columns(signals, [ts_col])
    spans = event_intervals(calendar).select(
        F.col("event_date").alias("_from"),
        F.col("next_date").alias("_to"),
        F.col("event_name").alias("last_event_name"),
        "event_window",
    )
    signals = signals.drop("last_event_name", "event_window", "days_since_event")
    joined = _annotate_by_day(signals, spans.filter(F.col("_to").isNotNull()), ts_col, salt_col)
    last = spans.filter(F.col("_to").isNull()).select(F.unix_micros("_from"), "last_event_name", "event_window").first()
    if last is not None:
        after = F.col(ts_col) >= F.timestamp_micros(F.lit(last[0]))
        newest = {"_from": F.timestamp_micros(F.lit(last[0])), "last_event_name": F.lit(last[1]), "event_window": F.lit(last[2])}
        joined = joined.withColumns({c: F.when(after, v).otherwise(F.col(c)) for c, v in newest.items()})
    return joined.withColumns(
        {
            "days_since_event": timing.days_between(F.col(ts_col), F.col("_from")),
            "last_event_name": F.coalesce("last_event_name", F.lit(PRE_EVENT)),
            "event_window": F.coalesce("event_window", F.lit(PRE_EVENT)),
        }
    ).drop("_from", "_to")


def _annotate_by_day(signals, spans, ts_col, salt_col):
    days = spans.withColumn(
        "_day", F.explode(F.sequence(F.to_date("_from"), F.to_date("_to"), F.expr("INTERVAL 1 DAY")))
    ).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(DAY_SLICES - 1))))
    key = F.col(salt_col) if salt_col else F.unix_micros(F.col(ts_col))
    left = signals.withColumns(
        {
            "_day": F.to_date(F.col(ts_col)),
            "_slice": F.pmod(F.xxhash64(key), F.lit(DAY_SLICES)).cast("int"),
        }
    ).alias("l")
    right = days.alias("r")
    condition = (
        (F.col("l._day") == F.col("r._day"))
        & (F.col("l._slice") == F.col("r._slice"))
        & (F.col(f"l.{ts_col}") >= F.col("r._from"))
        & (F.col(f"l.{ts_col}") < F.col("r._to"))
    )
    joined = left.join(right, condition, "left")
    keep = [F.col(f"l.{c}") for c in signals.columns]
    return joined.select(*keep, "r._from", "r._to", "r.last_event_name", "r.event_window")


def _latest(asked: DataFrame, events: DataFrame, period_col: str, keys: list[str]) -> DataFrame:
    """``asked`` with the greatest ``_event`` of its keys dated at or before the period.

    Periods and events are put in one order of time, in which the greatest event so far is carried on.
    """
    both = asked.withColumns({"__at": F.col(period_col), "__kind": F.lit(1)}).unionByName(
        events.select(*keys, F.col("event_date").alias("__at"), F.lit(0).alias("__kind"), F.col("_event").alias("__dated")), allowMissingColumns=True)
    carried = ordered.running(both, keys, [F.asc("__at"), F.asc("__kind")], peaks={"_event": "__dated"})
    return carried.where("__kind = 1").drop("__at", "__kind", "__dated")


def _known_latest(asked: DataFrame, events: DataFrame, period_col: str, origin_col: str) -> DataFrame:
    """(period, origin) with the greatest event dated by the period and announced by the origin.

    Announcements and origins are numbered in order. The numbers below an origin are a union of aligned runs of 1, 2, 4, .. numbers,
    one for each bit of their count; an event belongs to one run of each length. So a row meets about log2(n) runs, and
    in each of them the latest event is carried along the order of dates.
    """
    instants = events.select(F.col("announced_date").alias("__instant")).union(asked.select(origin_col))
    numbers = materialise(ordered.numbered_values(instants, "__instant", "__number"), "instants")
    levels = max(1, (numbers.agg(F.max("__number")).first()[0] or 0) + 1).bit_length()
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("__level")
    node = F.call_function("shiftright", F.col("__number"), F.col("__level")).alias("__node")
    held = events.join(numbers, events["announced_date"] == numbers["__instant"]).select("event_date", "_event", "__number", level)
    held = held.select("event_date", "_event", "__level", node)
    below = asked.join(numbers, asked[origin_col] == numbers["__instant"]).select(period_col, origin_col, (F.col("__number") + 1).alias("__number"), level)
    below = below.select(period_col, origin_col, "__level", node).where("__node % 2 = 1").withColumn("__node", F.col("__node") - 1)
    found = _latest(below, held, period_col, ["__level", "__node"])
    return found.groupBy(period_col, origin_col).agg(F.max("_event").alias("_event"))


def event_features(
    periods: DataFrame,
    calendar: DataFrame,
    period_col: str = "period_start",
    origin_col: str | None = None,
    window_weeks: float = timing.EVENT_WINDOW_WEEKS,
    half_life_weeks: float = timing.EVENT_HALF_LIFE_WEEKS,
) -> DataFrame:
    """Latest event per period; with ``origin_col`` only events announced by that origin count.

    ``periods`` is a period table (not signals); each (origin, period) row keeps exactly one event.
    """
    keys = [period_col] + ([origin_col] if origin_col else [])
    asked = periods.select(*keys).dropna().distinct()
    columns = ["event_name", "event_window", "event_type", "major_announcement_flag", "trailer_flag"]
    events = calendar if "event_type" in calendar.columns else calendar.withColumn("event_type", F.lit(""))
    events = events.select("event_date", "announced_date", F.struct("event_date", *columns).alias("_event"))
    latest = _known_latest(asked, events, period_col, origin_col) if origin_col else _latest(asked, events, period_col, [])
    days = timing.days_between(F.col(period_col), F.col("_event.event_date"))
    features = latest.select(
        *keys,
        F.coalesce("_event.event_name", F.lit(PRE_EVENT)).alias("last_event_name"),
        F.coalesce("_event.event_window", F.lit(PRE_EVENT)).alias("event_window"),
        days.alias("days_since_event"),
        (days / 7.0).alias("weeks_since_event"),
        timing.event_active(days / 7.0, window_weeks).alias("event_active"),
        timing.event_decay(days / 7.0, half_life_weeks).alias("event_decay"),
        F.coalesce("_event.event_type", F.lit("")).alias("event_type"),
        F.coalesce("_event.major_announcement_flag", F.lit(0)).alias("major_announcement_flag"),
        F.coalesce("_event.trailer_flag", F.lit(0)).alias("trailer_flag"),
        F.lit(origin_col is not None).alias("event_known_at_origin"),
    )
    return periods.join(features, keys, "left")


def event_window_summary(annotated: DataFrame) -> DataFrame:
    """D3: size, shares and means per event window with its chronological position."""
    require_columns(annotated, ["event_window", "sentiment_label"])
    aggregates = [
        F.count("*").alias("n_comments"),
        F.avg((F.col("sentiment_label") == "positive").cast("double")).alias("positive_share"),
        F.avg((F.col("sentiment_label") == "negative").cast("double")).alias("negative_share"),
    ]
    if "vader_compound" in annotated.columns:
        aggregates.append(F.avg("vader_compound").alias("mean_vader_compound"))
    if "demand_score" in annotated.columns:
        aggregates.append(F.avg("demand_score").alias("mean_demand_score"))
    if "timestamp" in annotated.columns:
        aggregates.append(F.min("timestamp").alias("first_seen"))
    summary = annotated.groupBy("event_window").agg(*aggregates)
    by_time = F.col("first_seen").asc_nulls_last() if "timestamp" in annotated.columns else F.col("event_window")
    # One row per event window is left here.
    order = Window.partitionBy(F.lit(1)).orderBy(
        F.when(F.col("event_window") == PRE_EVENT, 0).otherwise(1), by_time, F.col("event_window")
    )
    return summary.withColumn("window_order", F.row_number().over(order))


def event_window_deltas(annotated: DataFrame) -> DataFrame:
    """Change of mean sentiment against the previous event window."""
    summary = event_window_summary(annotated)
    if "mean_vader_compound" not in summary.columns:
        return summary
    order = Window.partitionBy(F.lit(1)).orderBy("window_order")
    previous = F.lag("mean_vader_compound").over(order)
    return summary.withColumn("delta_vs_prev_window", F.col("mean_vader_compound") - previous)


def event_usability(spine: DataFrame, calendar: DataFrame, period_col: str = "period_start",
                    min_periods: int = 2) -> DataFrame:
    """Periods before and after each event on the complete period index.

    Events and periods are put in one order, in which the periods are counted; an event comes before a period of its own time.
    """
    periods = spine.select(F.col(period_col).alias("__at")).where(F.col(period_col).isNotNull()).distinct()
    periods = materialise(periods, "periods")
    events = calendar.select("event_name", "event_date").distinct()
    both = events.withColumns({"__at": F.col("event_date"), "__period": F.lit(0).cast("bigint")}).unionByName(
        periods.withColumn("__period", F.lit(1).cast("bigint")), allowMissingColumns=True)
    counted = ordered.running(both, [], [F.asc("__at"), F.asc("__period")], {"periods_before": "__period"})
    counted = counted.where("__period = 0").select(
        "event_name", "event_date", "periods_before", (F.lit(periods.count()) - F.col("periods_before")).alias("periods_after"))
    usable = (F.col("periods_before") >= min_periods) & (F.col("periods_after") >= min_periods)
    return counted.withColumn("usable", usable)
