"""Weekly dataset with the facts about where it comes from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.operators import weekly
from pulseframe.session import materialise, side_by_side
from pulseframe.sources import landing

PRIMARY_TARGET = "actionable_probability_mass"
COLLECTION = ("videos", "rows_fetched", "failed_videos", "max_results_per_video", "cap_hit_videos", "seed_capped")


def build_weekly(
    signals: DataFrame, calendar: DataFrame | None = None, freq: str = "W-MON", demo: bool = False, known: Sequence[DataFrame] = (),
    manifest: DataFrame | None = None, series_cols: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The period table and one row of facts about it.

    A table that equals one of the ``known`` demo extracts is refused unless ``demo`` says so. ``manifest`` is the landing
    manifest of the collection (see ``landing.manifest``): a seed that hit its cap makes the volumes unrepresentative. The
    facts hold the content hash of the signals, the status, the collection's numbers, probabilities and the coverage audit.
    """
    if not demo and known and landing.is_known_extract(signals, known):
        raise ValueError("the signals are a known demo extract; build them with demo=True")
    collection = None
    if manifest is not None:
        collection = materialise(landing.collection_summary(manifest).select(*COLLECTION), "collection")
    capped = bool(collection is not None and collection.first()["seed_capped"])
    table = weekly.weekly_dataset(signals, calendar, freq, series_cols, demo, capped)
    usable = F.col("actionable_probability").isNotNull() & (F.coalesce("probability_source", F.lit("")) != weekly.UNAVAILABLE)
    told = signals.agg(F.count_if(usable).alias("rows_with_probability"), F.count_if(~usable).alias("rows_without_probability"))
    told = told.withColumn("primary_target_available", F.col("rows_with_probability") > 0)
    parts = [landing.content_hash(signals).withColumnRenamed("content_hash", "source_dataset_hash"), told, weekly.coverage_audit(signals, freq, calendar)]
    if collection is not None:
        parts.append(collection)
    facts = side_by_side(*parts).withColumns({
        "generated_freq": F.lit(freq), "sample_only": F.lit(demo), "volume_representative": F.lit(not demo and not capped),
        "evaluation_status": F.lit(weekly.evaluation_status(demo, capped)), "primary_target": F.lit(PRIMARY_TARGET), "manifest_found": F.lit(manifest is not None),
    })
    return table, facts
