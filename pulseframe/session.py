"""Session defaults and small plan-time helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "pulseframe", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        # Only a session without a shared folder (tests, local runs) gets here.
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give a written table at least one partition per core; a table with more partitions stays as it is.

    For steps that expand each row many times, where the input is small but the work is not.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_key(df: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Deal rows out by a key before they are expanded, so that grouping what comes of them by the key and more shuffles no expanded row."""
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise with the list of missing columns before any work is planned."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Expected columns {sorted(columns)}; missing {missing}")


def keyed(series_cols: Sequence[str]) -> list:
    """Partition keys of a per-series window; one constant key when there is a single series."""
    return [F.col(c) for c in series_cols] or [F.lit(1)]


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames in one row: union, then the only value of each column."""
    stacked = one_row_frames[0]
    for frame in one_row_frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
