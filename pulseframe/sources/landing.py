"""Landed files and payloads: raw signal tables, seed lists, manifests and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions import text, timing
from pulseframe.session import materialise

# --- fixed values -------------------------------------------------------------
REQUIRED_COLUMNS = ("source", "record_type", "id", "text", "timestamp", "engagement", "permalink", "parent_id", "metadata")
RAW_SCHEMA = ", ".join(f"{c} string" for c in REQUIRED_COLUMNS)
THREADS_SCHEMA = (
    "items array<struct<snippet:struct<totalReplyCount:bigint,topLevelComment:struct<id:string,snippet:struct<"
    "textDisplay:string,authorDisplayName:string,publishedAt:string,likeCount:bigint>>>>>"
)
SUBMISSIONS_SCHEMA = (
    "data array<struct<id:string,title:string,selftext:string,author:string,created_utc:double,score:bigint,permalink:string,num_comments:bigint>>"
)
COMMENTS_SCHEMA = "data array<struct<id:string,body:string,author:string,created_utc:double,score:bigint,permalink:string>>"
BLANK_SEEDS = ("", "nan", "None")
REMOVED = ("[deleted]", "[removed]")
OK, EMPTY, SKIPPED, FAILED = "ok", "empty", "skipped_existing", "failed"


def usable_files(spark: SparkSession, folder: str, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """A2: files below ``folder`` whose header holds every required column.

    The first line comes from the line reader, so no file is loaded whole.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder)
    located = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    heads = located.filter(F.col("at") == 0).groupBy("path").agg(F.first("value").alias("header"))
    names = F.transform(F.split("header", ","), lambda c: F.trim(c, F.lit(' "\r﻿')))
    wanted = F.array(*[F.lit(c) for c in required])
    return heads.withColumns({"names": names, "missing": F.array_except(wanted, names)}).withColumn("usable", F.size("missing") == 0)


def load_raw_signals(spark: SparkSession, folder: str, sources: Sequence[str] = ("reddit", "youtube")) -> DataFrame:
    """A1: rows of every usable file below ``folder/<source>``; raises when there is none.

    Files are read by position in one scan per source, and each row takes its columns from where the header of its
    file has them. No path reaches the driver.
    """
    frames = []
    for source in sources:
        below = f"{folder.rstrip('/')}/{source}"
        files = materialise(usable_files(spark, below).filter("usable").select("path", "names"), "headers")
        widest = files.agg(F.max(F.size("names"))).first()[0]
        if widest is None:
            continue
        places = [f"c{i}" for i in range(widest)]
        # With a schema of its own the reader only skips each file's first line.
        raw = (
            spark.read.schema(", ".join(f"{c} string" for c in places))
            .option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"')
            .option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(below)
        )
        rows = raw.select(F.col("_metadata.file_path").alias("path"), F.array(*places).alias("values")).join(files, "path")
        at = lambda c: F.get("values", F.array_position("names", c).cast("int") - 1).alias(c)
        frames.append(rows.select(*[at(c) for c in REQUIRED_COLUMNS]))
    if not frames:
        raise ValueError(f"no usable raw signal CSV files below {folder}")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def flatten_threads(payloads: DataFrame) -> DataFrame:
    """A3: comment payloads ``(video_id, payload)`` to signal rows; rows without id drop, without time stay."""
    item = F.explode(F.from_json("payload", THREADS_SCHEMA).getField("items"))
    rows = payloads.select("video_id", item.alias("i"))
    comment, snippet = F.col("i.snippet.topLevelComment"), F.col("i.snippet.topLevelComment.snippet")
    ident, published = comment.getField("id"), snippet.getField("publishedAt")
    meta = F.struct(
        F.col("video_id"), snippet.getField("authorDisplayName").alias("author_display_name"),
        F.coalesce(F.col("i.snippet.totalReplyCount"), F.lit(0)).alias("reply_count"), _time_source(published),
    )
    return rows.filter(F.coalesce(ident, F.lit("")) != "").select(
        F.lit("youtube").alias("source"), F.lit("comment").alias("record_type"), ident.alias("id"),
        F.coalesce(snippet.getField("textDisplay"), F.lit("")).alias("text"), snippet.getField("authorDisplayName").alias("author"),
        timing.iso_to_timestamp(published).alias("timestamp"), F.coalesce(snippet.getField("likeCount"), F.lit(0)).alias("engagement"),
        text.video_permalink(F.col("video_id"), ident).alias("permalink"), F.col("video_id").alias("parent_id"), F.to_json(meta).alias("metadata"),
    )


def _time_source(value: Column) -> Column:
    # An empty text and an epoch of 0 are no time.
    given = value.isNotNull() & ~value.cast("string").isin("", "0", "0.0")
    return F.when(given, "api_created").otherwise("missing").alias("timestamp_source")


def flatten_submissions(payloads: DataFrame) -> DataFrame:
    """A4: submission payloads ``(position, subreddit, query, payload)``; the first query that saw an id wins."""
    rows = payloads.select("position", "subreddit", "query", F.posexplode(F.from_json("payload", SUBMISSIONS_SCHEMA).getField("data")).alias("at", "s"))
    seen = rows.filter(F.coalesce("s.id", F.lit("")) != "").groupBy("s.id").agg(F.min(F.struct("position", "at", "subreddit", "query", "s")).alias("r")).select("r.*")
    title, body = F.coalesce("s.title", F.lit("")), F.coalesce("s.selftext", F.lit(""))
    created = F.col("s.created_utc")
    meta = F.struct("subreddit", _time_source(created), title.alias("title"), F.coalesce("s.num_comments", F.lit(0)).alias("num_comments"), "query")
    return seen.select(
        F.lit("reddit").alias("source"), F.lit("post").alias("record_type"), F.col("s.id").alias("id"),
        F.trim(F.concat(title, F.lit("\n\n"), body), F.lit(" \n")).alias("text"), F.col("s.author").alias("author"),
        timing.epoch_to_timestamp(created).alias("timestamp"), F.coalesce("s.score", F.lit(0)).alias("engagement"),
        text.thread_permalink(F.coalesce("s.permalink", F.lit(""))).alias("permalink"), F.lit(None).cast("string").alias("parent_id"), F.to_json(meta).alias("metadata"),
    )


def flatten_comments(payloads: DataFrame) -> DataFrame:
    """A5: comment payloads ``(post_id, subreddit, payload)`` without empty or removed bodies."""
    rows = payloads.select("post_id", "subreddit", F.explode(F.from_json("payload", COMMENTS_SCHEMA).getField("data")).alias("c"))
    body = F.coalesce("c.body", F.lit(""))
    kept = rows.filter((F.coalesce("c.id", F.lit("")) != "") & (body != "") & ~body.isin(*REMOVED))
    created = F.col("c.created_utc")
    return kept.select(
        F.lit("reddit").alias("source"), F.lit("comment").alias("record_type"), F.col("c.id").alias("id"), F.col("c.body").alias("text"),
        F.col("c.author").alias("author"), timing.epoch_to_timestamp(created).alias("timestamp"), F.coalesce("c.score", F.lit(0)).alias("engagement"),
        text.thread_permalink(F.coalesce("c.permalink", F.lit(""))).alias("permalink"), F.col("post_id").alias("parent_id"),
        F.to_json(F.struct("subreddit", _time_source(created))).alias("metadata"),
    )


def seed_list(raw: DataFrame) -> DataFrame:
    """Distinct usable video ids; raises when none is left."""
    seeds = raw.select(F.trim(F.col("video_id").cast("string")).alias("video_id")).filter(~F.col("video_id").isin(*BLANK_SEEDS)).distinct()
    if not seeds.limit(1).count():
        raise ValueError("the seed list holds no usable video_id")
    return seeds


def manifest(seeds: DataFrame, landed: DataFrame, max_results: int, failed: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Rows landed and status per seed; ``failed`` and ``existing`` list video ids."""
    counts = landed.groupBy(F.col("parent_id").alias("video_id")).agg(F.count("*").alias("rows_fetched"))
    out = seeds.join(counts, "video_id", "left").fillna(0, ["rows_fetched"])
    status = F.when(F.col("rows_fetched") > 0, OK).otherwise(EMPTY)
    for frame, name in ((failed, FAILED), (existing, SKIPPED)):
        if frame is not None:
            out = out.join(frame.select("video_id").distinct().withColumn(f"_{name}", F.lit(True)), "video_id", "left")
            status = F.when(F.col(f"_{name}"), name).otherwise(status)
    return out.withColumns({"status": status, "max_results": F.lit(max_results)}).drop(f"_{FAILED}", f"_{SKIPPED}")


def collection_summary(table: DataFrame) -> DataFrame:
    """Videos, rows, failures and whether any seed hit its cap."""
    capped = F.coalesce(F.col("rows_fetched") >= F.col("max_results"), F.lit(False))
    return table.agg(
        F.count("*").alias("videos"), F.coalesce(F.sum("rows_fetched"), F.lit(0)).alias("rows_fetched"),
        F.count_if(F.col("status") == FAILED).alias("failed_videos"), F.max("max_results").alias("max_results_per_video"),
        F.count_if(capped).alias("cap_hit_videos"), F.bool_or(capped).alias("seed_capped"),
    )


def write_signals_csv(signals: DataFrame, path: str) -> None:
    """Signals with JSON metadata, serialised time and the moment of writing."""
    flat = signals.withColumns({"timestamp": timing.serialise_timestamp(F.col("timestamp")), "scraped_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")})
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_weekly(weekly: DataFrame, path: str, facts: DataFrame) -> None:
    """Period table with one metadata document next to it."""
    weekly.write.mode("overwrite").parquet(f"{path}/table")
    facts.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_weekly(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/table"), spark.read.json(f"{path}/meta")


def content_hash(df: DataFrame) -> DataFrame:
    """Order-free hash of a table, 16 hex digits from sums of row hashes."""
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    sums = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x"))
    return sums.select(F.substring(F.sha2(F.concat_ws("-", F.col("n").cast("string"), F.col("s").cast("string"), F.col("x").cast("string")), 256), 1, 16).alias("content_hash"))


def is_known_extract(df: DataFrame, known: Sequence[DataFrame]) -> bool:
    """C17: does the table equal one of the known extracts."""
    mine = content_hash(df).first()[0]
    return any(content_hash(other).first()[0] == mine for other in known)
