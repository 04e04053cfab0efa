"""Landed payloads, files, manifests and sinks built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.base import calendar, events, query, signals, table, with_views
from pulseframe.plans import signals as signal_plan
from pulseframe.session import work_path
from pulseframe.sources import landing


def _csv_tree(spark, d):
    root = work_path(spark, "landing")
    sig = signals(spark, d)
    raw = sig.select(*[F.lit("").alias(c) if c in ("permalink",) else F.col(c).cast("string") for c in landing.REQUIRED_COLUMNS])
    for source, rows in (("youtube", raw.filter("engagement % 2 = 0")), ("reddit", raw.filter("engagement % 2 <> 0"))):
        rows.write.option("header", True).option("escape", '"').csv(f"{root}/{source}/signals")
    sig.select("id", "lang").write.option("header", True).csv(f"{root}/reddit/other")
    return root


@query("a1_raw_signals", with_views("sig", " SELECT id, source, CAST(engagement AS VARCHAR) AS engagement, md5(text) AS text_md5 FROM sig"))
def _(spark, d):
    return landing.load_raw_signals(spark, _csv_tree(spark, d)).select("id", "source", "engagement", F.md5("text").alias("text_md5"))


@query("a2_header_gate", "SELECT true AS usable, 0::INTEGER AS missing UNION ALL SELECT false, 8")
def _(spark, d):
    files = landing.usable_files(spark, f"{_csv_tree(spark, d)}/reddit")
    return files.select("usable", F.size("missing").alias("missing")).distinct()


@query("a3_video_comments", with_views("ev", " SELECT CAST(event_id AS VARCHAR) AS id, event_type AS text, CAST(user_id AS VARCHAR) AS parent_id, k AS engagement, CASE WHEN k < 10 THEN 'missing' ELSE 'api_created' END AS timestamp_source FROM ev WHERE k <> 50"))
def _(spark, d):
    ev = events(spark, d)
    ident = F.when(F.col("k") != 50, F.col("event_id").cast("string"))
    snippet = F.struct(F.col("event_type").alias("textDisplay"), F.when(F.col("k") >= 10, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("publishedAt"), F.col("k").alias("likeCount"))
    item = F.struct(F.struct(F.struct(ident.alias("id"), snippet.alias("snippet")).alias("topLevelComment")).alias("snippet"))
    payload = F.to_json(F.struct(F.array(item).alias("items")))
    out = landing.flatten_threads(ev.select(F.col("user_id").cast("string").alias("video_id"), payload.alias("payload")))
    return out.select("id", "text", "parent_id", "engagement", F.get_json_object("metadata", "$.timestamp_source").alias("timestamp_source"))


def _conversation_payloads(spark, d, first):
    conv = table(spark, d, "conversations")
    return conv.filter("turn = 0" if first else "turn > 0")


@query("a4_submissions", "SELECT 'p' || conv_id AS id, md5(trim('Thread ' || conv_id || chr(10) || chr(10) || text, ' ' || chr(10))) AS text_md5, 'https://reddit.com/t/' || conv_id AS permalink, length(text) AS engagement FROM conversations WHERE turn = 0")
def _(spark, d):
    conv = _conversation_payloads(spark, d, True)
    post = F.struct(F.concat(F.lit("p"), "conv_id").alias("id"), F.concat(F.lit("Thread "), "conv_id").alias("title"), F.col("text").alias("selftext"),
                    F.lit(1.7e9).alias("created_utc"), F.length("text").cast("bigint").alias("score"), F.concat(F.lit("/t/"), "conv_id").alias("permalink"))
    payloads = conv.select(F.lit("s").alias("subreddit"), F.lit("q").alias("query"), F.to_json(F.struct(F.array(post).alias("data"))).alias("payload"))
    # Two queries return every post.
    twice = payloads.withColumn("position", F.lit(0)).unionByName(payloads.withColumn("position", F.lit(1)))
    out = landing.flatten_submissions(twice)
    return out.select("id", F.md5("text").alias("text_md5"), "permalink", F.col("engagement").cast("bigint").alias("engagement"))


@query("a5_comments", "SELECT conv_id || '-' || turn AS id, 'p' || conv_id AS parent_id, md5(text) AS text_md5 FROM conversations WHERE turn > 0 AND role <> 'system' AND text <> ''")
def _(spark, d):
    conv = _conversation_payloads(spark, d, False)
    body = F.when(F.col("role") == "system", "[removed]").otherwise(F.col("text"))
    comment = F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), body.alias("body"))
    payloads = conv.select(F.concat(F.lit("p"), "conv_id").alias("post_id"), F.lit("s").alias("subreddit"), F.to_json(F.struct(F.array(comment).alias("data"))).alias("payload"))
    return landing.flatten_comments(payloads).select("id", "parent_id", F.md5("text").alias("text_md5"))


def _seeds(spark, d):
    docs = table(spark, d, "documents")
    raw = docs.select(F.when(F.col("lang") == "de", " ").otherwise(F.concat(F.lit(" "), "source")).alias("video_id"))
    return landing.seed_list(raw)


_SEED_SQL = "WITH s AS (SELECT DISTINCT source AS video_id FROM documents WHERE lang <> 'de'), c AS (SELECT source AS video_id, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY 1), m AS (SELECT video_id, coalesce(n, 0) AS rows_fetched, CASE WHEN video_id = 'src1' THEN 'failed' WHEN coalesce(n, 0) > 0 THEN 'ok' ELSE 'empty' END AS status, 8 AS max_results FROM s LEFT JOIN c USING (video_id))"


@query("a6_seed_list", "SELECT DISTINCT source AS video_id FROM documents WHERE lang <> 'de'")
def _(spark, d):
    return _seeds(spark, d)


def _manifest(spark, d):
    landed = table(spark, d, "documents").filter("lang = 'fr'").select(F.col("source").alias("parent_id"))
    failed = table(spark, d, "documents").filter("source = 'src1'").select(F.col("source").alias("video_id"))
    return landing.manifest(_seeds(spark, d), landed, 8, failed)


@query("a7_landing_manifest", _SEED_SQL + " SELECT * FROM m")
def _(spark, d):
    return _manifest(spark, d)


@query("a8_collection_summary", _SEED_SQL + " SELECT count(*) AS videos, CAST(sum(rows_fetched) AS BIGINT) AS rows_fetched, count(*) FILTER (status = 'failed') AS failed_videos, 8 AS max_results_per_video, count(*) FILTER (rows_fetched >= 8) AS cap_hit_videos, bool_or(rows_fetched >= 8) AS seed_capped FROM m")
def _(spark, d):
    return landing.collection_summary(_manifest(spark, d))


@query("a9_signal_sink", with_views("sig", " SELECT id, metadata FROM sig"))
def _(spark, d):
    path = work_path(spark, "signals")
    landing.write_signals_csv(signals(spark, d).select("id", "source", "timestamp", "engagement", "metadata"), path)
    return spark.read.option("header", True).option("escape", '"').csv(path).select("id", "metadata")


@query("a11_weekly_table", "SELECT 'demo_only' AS evaluation_status, count(*) AS weeks FROM (SELECT DISTINCT date_trunc('week', o_orderdate) FROM orders)")
def _(spark, d):
    path = work_path(spark, "weekly")
    weeks = table(spark, d, "orders").select(F.date_trunc("week", F.col("o_orderdate").cast("timestamp")).alias("period_start")).distinct()
    landing.write_weekly(weeks, path, spark.createDataFrame([("demo_only",)], "evaluation_status string"))
    weekly, meta = landing.load_weekly(spark, path)
    return weekly.agg(F.count("*").alias("weeks")).withColumn("evaluation_status", meta.select("evaluation_status").scalar())


@query("a12_stage_tables")
def _(spark, d):
    stages = signal_plan.run(signals(spark, d), "doc_id", calendar(spark), keep=signal_plan.written(work_path(spark, "stages")))
    out = None
    for name, frame in stages.items():
        counted = frame.agg(F.lit(name).alias("stage"), F.count("*").alias("rows"))
        out = counted if out is None else out.unionByName(counted)
    return out


@query("c17_known_extract", "SELECT true AS same, false AS other")
def _(spark, d):
    docs = table(spark, d, "documents")
    same = landing.is_known_extract(docs.orderBy("text"), [docs])
    other = landing.is_known_extract(docs, [docs.filter("lang = 'en'")])
    return docs.limit(1).select(F.lit(same).alias("same"), F.lit(other).alias("other"))


@query("d40_content_hash")
def _(spark, d):
    return landing.content_hash(table(spark, d, "documents"))
