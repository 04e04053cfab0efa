"""The signal pipeline as one lineage and its stage tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import intent
from pulseframe.operators import calendar as cal_ops
from pulseframe.operators import cleaning, scores
from pulseframe.operators.lexicon import lexicon_sentiment


def run(
    raw: DataFrame,
    order_col: str,
    calendar: DataFrame | None = None,
    now: Column | str | None = None,
    lexicon: Mapping[str, object] | None = None,
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, frame: frame,
) -> dict[str, DataFrame]:
    """Clean, tone, label, score and annotate; each stage goes on from what ``keep`` returns for the one before.

    ``raw`` carries ``vader_compound``, or ``lexicon`` holds the arguments of ``lexicon_sentiment`` after the text column.
    """
    out = {"clean": keep("clean", cleaning.clean_signals(raw, order_col, now))}
    toned = out["clean"]
    if "vader_compound" not in toned.columns:
        if lexicon is None:
            raise ValueError("signals without vader_compound need a lexicon")
        tone = lexicon_sentiment(toned, "id", "text", **lexicon).withColumnRenamed("compound", "vader_compound")
        toned = toned.join(tone, "id")
    out["sentiment"] = keep("sentiment", toned.withColumn("sentiment_label", intent.sentiment_label(F.col("vader_compound"))))
    labelled = out["sentiment"].withColumn("intent_label", intent.intent_label(F.col("text")))
    out["intent"] = keep("intent", labelled.withColumn("intent_confidence", intent.intent_confidence(F.col("intent_label"))))
    out["scored"] = keep("scored", scores.score_signals(out["intent"]))
    out["parents"] = keep("parents", scores.parent_scores(out["scored"]))
    if calendar is not None:
        out["events"] = keep("events", cal_ops.annotate_events(out["scored"], calendar))
        out["event_deltas"] = keep("event_deltas", cal_ops.event_window_deltas(out["events"]))
    return out


def written(path: str) -> Callable[[str, DataFrame], DataFrame]:
    """A ``keep`` that writes each stage once as Parquet below ``path`` and goes on from the table."""

    def keep(name: str, frame: DataFrame) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
        return frame.sparkSession.read.schema(frame.schema).parquet(f"{path}/{name}")

    return keep
