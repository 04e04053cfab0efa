"""Row-level cleaning, filters and enrichment of signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import text, timing
from pulseframe.session import require_columns

# --- fixed values -------------------------------------------------------------
REMOVED_MARKERS = ("[deleted]", "[removed]")
HIDDEN_COLUMNS = ("metadata", "author", "username", "user", "permalink", "id")
IDENTIFYING_COLUMNS = ("id", "permalink", "author", "scraped_at", "username", "user", "channel_id")
IDENTIFYING_KEYS = (
    "author",
    "author_display_name",
    "author_channel_id",
    "author_channel_url",
    "author_profile_image_url",
    "username",
    "user",
)
RESOLVED, UNRESOLVED, SKIPPED = "resolved", "unresolved", "skipped_source_not_enabled"


def keep_first(df: DataFrame, keys: Sequence[str], order_col: str) -> DataFrame:
    """First row per key by a unique ``order_col``; null keys count as one key.

    The minimum per key is combined before the shuffle and the rows are then matched on the unique
    position, so a key that holds much of the table never meets in one task.
    """
    firsts = df.groupBy(*keys).agg(F.min(order_col).alias(order_col)).select(order_col)
    return df.join(firsts, order_col, "left_semi")


def is_removed(body: Column) -> Column:
    return F.coalesce(text.casefold(text.collapse_spaces(body)).isin(*REMOVED_MARKERS), F.lit(False))


def clean_signals(raw: DataFrame, order_col: str, now: Column | str | None = None) -> DataFrame:
    """B1: drop blank, removed and repeated rows, normalise the text, parse the time.

    Repeats are found on the raw rows, so an id whose first copy is blank loses every copy.
    """
    require_columns(raw, ["id", "text", "timestamp", order_col])
    kept = keep_first(raw, ["id"], order_col).filter(~text.is_blank(F.col("text")) & ~is_removed(F.col("text")))
    cleaned = kept.withColumn("text", text.normalise_text(F.col("text")))
    if dict(raw.dtypes)["timestamp"].startswith("timestamp"):
        return cleaned.withColumn("timestamp_status", timing.timestamp_status(F.col("timestamp")))
    return with_parsed_time(cleaned, "timestamp", now)


def with_parsed_time(df: DataFrame, raw_col: str = "timestamp", now: Column | str | None = None) -> DataFrame:
    """Replace raw text by a UTC timestamp and record its status."""
    parsed = timing.parse_timestamp(F.col(raw_col), now)
    return df.withColumn("_parsed", parsed).withColumns(
        {
            "timestamp_status": timing.timestamp_status(F.col("_parsed"), F.col(raw_col)),
            raw_col: F.col("_parsed"),
        }
    ).drop("_parsed")


def timestamp_report(df: DataFrame, raw_col: str = "timestamp", now: Column | str | None = None) -> DataFrame:
    """How many times are valid, missing or unusable and why, with the valid range."""
    outcome = df.select(timing.timestamp_outcome(F.col(raw_col), now).alias("o")).select("o.*")
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    valid_ts = F.when(F.col("outcome") == "valid", F.col("ts"))
    return outcome.agg(
        F.count("*").alias("total"),
        is_("valid").alias("valid"),
        is_("missing").alias("missing"),
        is_("naive", "unparsed", "epoch_zero", "future").alias("invalid"),
        is_("naive").alias("naive"),
        is_("epoch_zero").alias("epoch_zero"),
        is_("future").alias("future"),
        F.min(valid_ts).alias("earliest"),
        F.max(valid_ts).alias("latest"),
    )


def filter_values(df: DataFrame, selected: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per column an IN list over the text form; an empty list or an absent column filters nothing."""
    for column, values in selected.items():
        if values and column in df.columns:
            df = df.filter(F.col(column).cast("string").isin(*values))
    return df


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values as text."""
    return df.select(F.col(column).cast("string").alias("value")).dropna().distinct()


def drop_columns(df: DataFrame, columns: Sequence[str] = HIDDEN_COLUMNS) -> DataFrame:
    """Drop those of the listed columns that are present."""
    return df.drop(*[c for c in columns if c in df.columns])


def strip_metadata_keys(metadata: Column, keys: Sequence[str] = IDENTIFYING_KEYS) -> Column:
    """Remove identifying keys from a JSON object; anything else stays as it is."""
    # A variant keeps the types of the other values; maps of text would turn numbers into strings.
    parsed = F.try_parse_json(metadata)
    entries = F.from_json(metadata, "map<string,string>")
    has_key = F.arrays_overlap(F.map_keys(entries), F.array(*[F.lit(k) for k in keys]))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    typed = parsed.try_cast("map<string,variant>")
    kept = F.to_json(F.map_filter(typed, lambda k, v: ~k.isin(*keys)))
    return F.when(is_object & F.coalesce(has_key, F.lit(False)), kept).otherwise(metadata)


def anonymise(df: DataFrame, columns: Sequence[str] = IDENTIFYING_COLUMNS) -> DataFrame:
    """B9 with B10."""
    out = drop_columns(df, columns)
    if "metadata" in out.columns:
        out = out.withColumn("metadata", strip_metadata_keys(F.col("metadata")))
    return out


def union_all(*frames: DataFrame) -> DataFrame:
    """G1: rows of all frames; columns a frame lacks are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def enrichment_table(
    signals: DataFrame,
    lookup: DataFrame,
    now: Column | str | None = None,
    resolvable: Sequence[str] = ("youtube", "reddit"),
    skipped: Sequence[str] = (),
) -> DataFrame:
    """One row per signal without a usable time, with what ``lookup (id, raw_timestamp)`` knows.

    ``skipped`` lists sources whose lookup was not allowed; sources outside ``resolvable`` stay unresolved.
    """
    needs = signals.filter(timing.parse_timestamp(F.col("timestamp"), now).isNull()).select(
        F.col("id").cast("string").alias("id"), "source"
    )
    found = lookup.select(F.col("id").cast("string").alias("id"), "raw_timestamp")
    joined = needs.join(found, "id", "left")
    allowed = F.col("source").isin(*resolvable)
    if skipped:
        allowed = allowed & ~F.col("source").isin(*skipped)
    raw = F.when(allowed, F.col("raw_timestamp"))
    status = F.when(allowed & (F.coalesce(raw, F.lit("")) != ""), RESOLVED)
    if skipped:
        status = status.when(F.col("source").isin(*skipped), SKIPPED)
    return joined.select(
        "id",
        "source",
        timing.serialise_timestamp(timing.parse_timestamp(raw, now)).alias("timestamp"),
        status.otherwise(UNRESOLVED).alias("status"),
    )


def apply_enrichment(signals: DataFrame, enrichment: DataFrame, now: Column | str | None = None) -> DataFrame:
    """Fill missing times from the table, never overwrite an observed one.

    The status is judged on the raw text, so recovered, missing and invalid rows stay apart.
    """
    known = enrichment.filter(F.col("timestamp") != "").groupBy("id").agg(
        F.max(timing.parse_timestamp(F.col("timestamp"), now)).alias("_recovered")
    )
    own = timing.parse_timestamp(F.col("timestamp"), now)
    return (
        signals.join(known, "id", "left")
        .withColumn("_own", own)
        .withColumns(
            {
                "timestamp_status": F.when(F.col("_own").isNull() & F.col("_recovered").isNotNull(), "recovered").otherwise(
                    timing.timestamp_status(F.col("_own"), F.col("timestamp"))
                ),
                "timestamp": F.coalesce("_own", "_recovered"),
            }
        )
        .drop("_own", "_recovered")
    )


def signal_profile(df: DataFrame, required: Sequence[str], now: Column | str | None = None) -> DataFrame:
    """Rows, missing columns, rows per source and time quality in one pass."""
    missing = [c for c in required if c not in df.columns]
    outcome = (
        timing.timestamp_status(timing.parse_timestamp(F.col("timestamp"), now), F.col("timestamp"))
        if "timestamp" in df.columns
        else F.lit("missing")
    )
    source = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    return (
        df.groupBy(source.alias("source"))
        .agg(
            F.count("*").alias("rows"),
            F.count_if(outcome == "valid").alias("valid_times"),
            F.count_if(outcome == "missing").alias("missing_times"),
            F.count_if(outcome == "invalid").alias("invalid_times"),
        )
        .withColumn("missing_columns", F.lit(",".join(missing)))
    )
