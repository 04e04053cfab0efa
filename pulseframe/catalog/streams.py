"""Streaming jobs run over the signals written as files (M1-M3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.base import calendar, query, rnd, rsql, scored_signals, signals, ssql, stamp, with_views
from pulseframe.session import work_path
from pulseframe.streaming import jobs


def _stream(spark, df):
    path = work_path(spark, "arrivals")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _run(spark, stream):
    path = work_path(spark, "out")
    jobs.run_to_table(stream, path, work_path(spark, "progress"))
    return spark.read.schema(stream.schema).parquet(path)


@query("m1_streaming_clean", with_views("sig", " SELECT id FROM sig WHERE k >= 10"))
def _(spark, d):
    sig = signals(spark, d).withColumn("text", F.when(F.col("k") < 10, "[removed]").otherwise(F.col("text"))).select("id", "text", "timestamp")
    return _run(spark, jobs.clean_stream(_stream(spark, sig.unionByName(sig)), delay="60 days")).select("id")


@query("m2_streaming_weeks", with_views("sig", f""" SELECT {ssql("date_trunc('week', timestamp)")} AS period_start, count(*) AS total_comments,
  {rsql("sum(CASE WHEN probability_source <> 'unavailable' THEN actionable_probability END)")} AS actionable_probability_mass FROM sig GROUP BY 1"""))
def _(spark, d):
    sig = signals(spark, d).select("timestamp", "actionable_probability", "probability_source")
    stream = jobs.weekly_stream(_stream(spark, sig))
    out = jobs.run_updates(stream, work_path(spark, "out"), work_path(spark, "progress"), ["period_start"])
    return out.select(stamp("period_start").alias("period_start"), "total_comments", rnd("actionable_probability_mass").alias("actionable_probability_mass"))


@query("m2_streaming_proxy", with_views("sig lsig ssig", f""" SELECT {ssql("date_trunc('week', timestamp)")} AS period_start, count(*) AS total_comments,
  count(*) FILTER (lower(source) LIKE '%src1%') AS src1_comments, count(*) FILTER (intent_label <> 'general_discussion') AS actionable_count,
  {rsql("avg(CASE WHEN intent_label <> 'general_discussion' THEN 1.0 ELSE 0 END)")} AS actionable_rate, count(*) FILTER (intent_label = 'high_intent') AS high_intent_count,
  {rsql("avg(CASE WHEN intent_label = 'frustrated_demand' THEN 1.0 ELSE 0 END)")} AS frustrated_demand_rate, count(*) FILTER (intent_label = 'nostalgia_reactivation') AS nostalgia_reactivation_count,
  {rsql("coalesce(sum(actionable_probability) FILTER (probability_source <> 'unavailable'), 0)")} AS actionable_probability_mass,
  {rsql("avg(actionable_probability) FILTER (probability_source <> 'unavailable')")} AS mean_actionable_probability,
  {rsql("avg(CASE WHEN probability_source <> 'unavailable' THEN 1.0 ELSE 0 END)")} AS probability_coverage,
  {rsql('avg(vader_compound)')} AS mean_sentiment, {rsql('avg(demand_score)')} AS mean_demand_score FROM ssig GROUP BY 1"""))
def _(spark, d):
    columns = ["timestamp", "source", "intent_label", "actionable_probability", "probability_source", "vader_compound", "demand_score"]
    rows = scored_signals(spark, d).select(*columns)
    arrived, path = work_path(spark, "arrivals"), work_path(spark, "weeks")
    rows.repartition(4).write.parquet(arrived)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    jobs.run_weekly(stream, path, work_path(spark, "progress"), ("src1",))
    out = jobs.weekly_table(spark, path, ("src1",), with_late=True)
    names = ["total_comments", "src1_comments", "actionable_count", "high_intent_count", "nostalgia_reactivation_count"]
    rates = ["actionable_rate", "frustrated_demand_rate", "actionable_probability_mass", "mean_actionable_probability", "probability_coverage", "mean_sentiment", "mean_demand_score"]
    return out.select(stamp("period_start").alias("period_start"), *names, *[rnd(c).alias(c) for c in rates])


@query("m3_streaming_events", with_views("sig cal", f" SELECT id, coalesce(c.event_window, 'pre_announcement') AS event_window, {rsql('(epoch_us(s.timestamp) - epoch_us(c.event_date)) / 8.64e10')} AS days_since_event FROM sig s ASOF LEFT JOIN (SELECT event_date, event_window FROM cal) c ON s.timestamp >= c.event_date"))
def _(spark, d):
    sig = signals(spark, d).select("id", "timestamp")
    out = _run(spark, jobs.annotate_stream(_stream(spark, sig), calendar(spark)))
    return out.select("id", "event_window", rnd("days_since_event").alias("days_since_event"))


