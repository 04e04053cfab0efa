"""Structured Streaming forms of cleaning, period aggregates and event annotation (M1-M3)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pulseframe.functions import text, timing
from pulseframe.operators import calendar as cal_ops
from pulseframe.operators import cleaning, weekly


def clean_stream(raw: DataFrame, ts_col: str = "timestamp", delay: str = "1 day") -> DataFrame:
    """M1: drop blank and removed rows and ids repeated within the watermark.

    Ids are dropped before the text filter, as in the batch form.
    """
    unique = raw.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(["id"])
    kept = unique.filter(~text.is_blank(F.col("text")) & ~cleaning.is_removed(F.col("text")))
    return kept.withColumn("text", text.normalise_text(F.col("text")))


def weekly_stream(signals: DataFrame, ts_col: str = "timestamp", delay: str = "7 days") -> DataFrame:
    """M2: counts and proxy sums per Monday week; the epoch is a Thursday, so weeks start four days later."""
    week = F.window(F.col(ts_col), "7 days", "7 days", "4 days")
    usable = F.col("probability_source") != "unavailable"
    return (
        signals.withWatermark(ts_col, delay)
        .groupBy(week.alias("w"))
        .agg(F.count("*").alias("total_comments"), F.sum(F.when(usable, F.col("actionable_probability"))).alias("actionable_probability_mass"))
        .select(F.col("w.start").alias("period_start"), "total_comments", "actionable_probability_mass")
    )


def annotate_stream(signals: DataFrame, calendar: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """M3: stream joined to the static calendar intervals by day."""
    return cal_ops.annotate_events(signals, calendar, ts_col)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run on what has arrived and stop; state and progress live in ``checkpoint``."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run on what has arrived in update mode and return the latest row per key, open windows included.

    Each micro-batch overwrites its own folder, so a repeated batch leaves no second copy.
    """

    def put(frame: DataFrame, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    rows = stream.sparkSession.read.option("basePath", path).schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(path)
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return latest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def run_weekly(signals: DataFrame, path: str, checkpoint: str, platforms: tuple[str, ...] = weekly.PLATFORMS, delay: str = "7 days") -> None:
    """M2: weekly counts and sums of every micro-batch below ``path``; late rows are kept apart, not dropped.

    The watermark of a batch is the latest time of the batches before it less ``delay``; a row is late when its week had ended by
    then. Each batch overwrites its own folders, so a batch that is repeated after a failure leaves no second copy, and a run
    goes on where the checkpoint ends.
    """
    spark = signals.sparkSession

    def put(frame: DataFrame, batch: int) -> None:
        before = None if batch == 0 else spark.read.parquet(f"{path}/marks/batch={batch - 1}").first()["latest"]
        ended = timing.period_start(F.col("timestamp"), "W-MON") + F.expr("INTERVAL 7 DAYS")
        limit = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(ended <= limit, F.lit(False))
        frame.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch}")
        weekly.partial_periods(frame.filter(~late), platforms).write.mode("overwrite").parquet(f"{path}/parts/batch={batch}")
        latest = F.greatest(F.max("timestamp"), F.lit(before).cast("timestamp")).alias("latest")
        frame.agg(latest).write.mode("overwrite").parquet(f"{path}/marks/batch={batch}")

    signals.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def late_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that ``run_weekly`` found late, with their batch; None before the first batch."""
    try:
        return spark.read.parquet(f"{path}/late")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def weekly_table(spark: SparkSession, path: str, platforms: tuple[str, ...] = weekly.PLATFORMS, with_late: bool = False) -> DataFrame:
    """M2: the columns of D4-D7 per week with rows, and ``late_rows``, the late rows of the week.

    ``with_late`` adds the late rows to all columns: after all input the table equals that of the batch job.
    """
    parts, late = spark.read.parquet(f"{path}/parts").drop("batch"), late_rows(spark, path).drop("batch")
    counts = late.groupBy(timing.period_start(F.col("timestamp"), "W-MON").alias("period_start")).agg(F.count("*").alias("late_rows"))
    if with_late:
        parts = parts.unionByName(weekly.partial_periods(late, platforms))
    return weekly.merged_periods(parts).join(counts, "period_start", "left").fillna(0, ["late_rows"])
