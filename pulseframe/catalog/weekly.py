"""Period tables, gaps and coverage (B11-B14, B17-side series ops, C2, C4, C5, C18, D4-D10, D13, D54, D64, E1, E2, E11-E14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.base import (
    ORDER_CALENDAR_ROWS,
    calendar,
    events,
    order_weeks,
    query,
    rnd,
    rsql,
    scored_signals,
    signals,
    ssql,
    stamp,
    with_views,
)
from pulseframe.operators import calendar as cal_ops
from pulseframe.operators import series, weekly
from pulseframe.plans import weekly as weekly_plan
from pulseframe.sources import landing

_PERIOD_SQL = """, g AS (SELECT date_trunc('week', timestamp) AS ps, count(*) AS n,
    count(*) FILTER (lower(source) LIKE '%src1%') AS src1, count(*) FILTER (lower(source) LIKE '%src2%') AS src2,
    count(*) FILTER (intent_label <> 'general_discussion') AS act,
    count(*) FILTER (intent_label = 'high_intent') AS hi, count(*) FILTER (intent_label = 'frustrated_demand') AS fr,
    count(*) FILTER (intent_label = 'nostalgia_reactivation') AS nos,
    sum(actionable_probability) FILTER (probability_source <> 'unavailable') AS mass,
    avg(actionable_probability) FILTER (probability_source <> 'unavailable') AS meanp,
    count(*) FILTER (probability_source <> 'unavailable') AS np, avg(vader_compound) AS ms, avg(demand_score) AS md
  FROM (SELECT * FROM ssig WHERE NOT (timestamp >= TIMESTAMP '2024-01-08' AND timestamp < TIMESTAMP '2024-01-15')) GROUP BY 1),
  sp AS (SELECT unnest(generate_series((SELECT min(ps) FROM g), (SELECT max(ps) FROM g), INTERVAL 7 DAY)) AS ps),
  wk AS (SELECT sp.ps, coalesce(n, 0) AS n, coalesce(src1, 0) AS src1, coalesce(src2, 0) AS src2, coalesce(act, 0) AS act, coalesce(hi, 0) AS hi,
    coalesce(fr, 0) AS fr, coalesce(nos, 0) AS nos, coalesce(mass, 0.0) AS mass, meanp, coalesce(np, 0) AS np, ms, md FROM sp LEFT JOIN g USING (ps))"""

_BASE = "sig lsig ssig"


def _some_signals(spark, d):
    # One week without any row, as the empty week of the gap-free index.
    quiet = (F.col("timestamp") >= "2024-01-08") & (F.col("timestamp") < "2024-01-15")
    return scored_signals(spark, d).filter(~quiet)


def _weekly(spark, d, **kw):
    return weekly.aggregate_periods(_some_signals(spark, d), platforms=("src1", "src2"), **kw)


@query("d4_weekly_totals", with_views(_BASE, _PERIOD_SQL + f" SELECT {ssql('ps')} AS period_start, n AS total_comments, src1 AS src1_comments, src2 AS src2_comments FROM wk"))
def _(spark, d):
    return _weekly(spark, d).select(stamp("period_start").alias("period_start"), "total_comments", "src1_comments", "src2_comments")


@query("d5_weekly_intents", with_views(_BASE, _PERIOD_SQL + f""" SELECT {ssql('ps')} AS period_start, act AS actionable_count,
  {rsql('CASE WHEN n > 0 THEN act / n::DOUBLE END')} AS actionable_rate, hi AS high_intent_count, {rsql('CASE WHEN n > 0 THEN hi / n::DOUBLE END')} AS high_intent_rate,
  fr AS frustrated_demand_count, {rsql('CASE WHEN n > 0 THEN fr / n::DOUBLE END')} AS frustrated_demand_rate,
  nos AS nostalgia_reactivation_count, {rsql('CASE WHEN n > 0 THEN nos / n::DOUBLE END')} AS nostalgia_reactivation_rate FROM wk"""))
def _(spark, d):
    counts = ["actionable_count", "high_intent_count", "frustrated_demand_count", "nostalgia_reactivation_count"]
    rates = ["actionable_rate", "high_intent_rate", "frustrated_demand_rate", "nostalgia_reactivation_rate"]
    return _weekly(spark, d).select(stamp("period_start").alias("period_start"), *counts, *[rnd(c).alias(c) for c in rates])


@query("d6_demand_proxy", with_views(_BASE, _PERIOD_SQL + f""" SELECT {ssql('ps')} AS period_start, {rsql('mass')} AS actionable_probability_mass,
  {rsql('meanp')} AS mean_actionable_probability, np AS n_with_probability, {rsql('CASE WHEN n > 0 THEN np / n::DOUBLE END')} AS probability_coverage FROM wk"""))
def _(spark, d):
    return _weekly(spark, d).select(
        stamp("period_start").alias("period_start"), rnd("actionable_probability_mass").alias("actionable_probability_mass"),
        rnd("mean_actionable_probability").alias("mean_actionable_probability"), "n_with_probability",
        rnd("probability_coverage").alias("probability_coverage"))


@query("d7_weekly_means", with_views(_BASE, _PERIOD_SQL + f" SELECT {ssql('ps')} AS period_start, {rsql('ms')} AS mean_sentiment, {rsql('md')} AS mean_demand_score FROM wk"))
def _(spark, d):
    return _weekly(spark, d).select(stamp("period_start").alias("period_start"), rnd("mean_sentiment").alias("mean_sentiment"), rnd("mean_demand_score").alias("mean_demand_score"))


_FEAT_SQL = """, f AS (SELECT wk.ps, c.event_name, c.event_window, (epoch_us(wk.ps) - epoch_us(c.event_date)) / 8.64e10 AS days,
    c.major_announcement_flag AS mf, c.trailer_flag AS tf FROM wk ASOF LEFT JOIN cal c ON wk.ps >= c.event_date)"""


@query("c5_weekly_with_events", with_views(_BASE + " cal", _PERIOD_SQL + _FEAT_SQL + f""" SELECT {ssql('wk.ps')} AS period_start, n AS total_comments,
  coalesce(event_window, 'pre_announcement') AS event_window, {rsql('days')} AS days_since_event,
  CASE WHEN days / 7 < 4 THEN 1 ELSE 0 END AS event_active, {rsql('coalesce(pow(0.5, days / 7 / 3.0), 0)')} AS event_decay,
  coalesce(tf, 0) AS trailer_flag FROM wk JOIN f ON f.ps = wk.ps"""))
def _(spark, d):
    out = _weekly(spark, d, calendar=calendar(spark))
    return out.select(stamp("period_start").alias("period_start"), "total_comments", "event_window", rnd("days_since_event").alias("days_since_event"),
                      "event_active", rnd("event_decay").alias("event_decay"), "trailer_flag")


@query("k16_weekly_dataset", with_views(_BASE + " cal", _PERIOD_SQL + _FEAT_SQL + f""" SELECT {ssql('wk.ps')} AS period_start, n AS total_comments,
  {rsql('mass')} AS actionable_probability_mass, coalesce(event_window, 'pre_announcement') AS event_window,
  'seed_capped_dataset' AS evaluation_status, false AS volume_representative FROM wk JOIN f ON f.ps = wk.ps"""))
def _(spark, d):
    out = weekly.weekly_dataset(_some_signals(spark, d), calendar(spark), seed_capped=True)
    return out.select(stamp("period_start").alias("period_start"), "total_comments", rnd("actionable_probability_mass").alias("actionable_probability_mass"),
                      "event_window", "evaluation_status", "volume_representative")


_FACTS = ("evaluation_status", "volume_representative", "sample_only", "manifest_found", "primary_target", "primary_target_available", "rows_with_probability",
          "rows_without_probability", "rows_with_timestamp", "observed_periods", "non_empty_periods", "videos", "rows_fetched", "failed_videos", "cap_hit_videos", "seed_capped")


@query("k16_weekly_facts", with_views(_BASE, """, per AS (SELECT parent_id, count(*) AS n FROM ssig WHERE parent_id IS NOT NULL GROUP BY 1),
  pd AS (SELECT min(date_trunc('week', timestamp)) AS lo, max(date_trunc('week', timestamp)) AS hi, count(DISTINCT date_trunc('week', timestamp)) AS k, count(timestamp) AS t FROM ssig),
  pr AS (SELECT count(*) FILTER (actionable_probability IS NOT NULL AND coalesce(probability_source, '') <> 'unavailable') AS w, count(*) AS a FROM ssig),
  co AS (SELECT count(*) AS v, CAST(sum(n) AS BIGINT) AS r, count(*) FILTER (n >= 10) AS h FROM per)
  SELECT CASE WHEN h > 0 THEN 'seed_capped_dataset' ELSE 'full_dataset' END AS evaluation_status, h = 0 AS volume_representative, false AS sample_only, true AS manifest_found,
    'actionable_probability_mass' AS primary_target, w > 0 AS primary_target_available, w AS rows_with_probability, a - w AS rows_without_probability, t AS rows_with_timestamp,
    CAST(date_diff('day', lo, hi) / 7 + 1 AS BIGINT) AS observed_periods, k AS non_empty_periods, v AS videos, r AS rows_fetched, 0::BIGINT AS failed_videos, h AS cap_hit_videos, h > 0 AS seed_capped
  FROM pd, pr, co"""))
def _(spark, d):
    sig = scored_signals(spark, d)
    seeds = sig.select(F.col("parent_id").alias("video_id")).where("video_id is not null").distinct()
    return weekly_plan.build_weekly(sig, calendar(spark), manifest=landing.manifest(seeds, sig, 10))[1].select(*_FACTS)


_SPARSE_SQL = """, c AS (SELECT event_type || '-' || user_id AS series_id, date_trunc('day', ts) AS ps, count(*) AS n FROM ev GROUP BY 1, 2),
  sp AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ps FROM (SELECT series_id, min(ps) AS lo, max(ps) AS hi FROM c GROUP BY 1)),
  dd AS (SELECT sp.series_id, sp.ps, coalesce(n, 0) AS n FROM sp LEFT JOIN c USING (series_id, ps)),
  isl AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ps) - row_number() OVER (PARTITION BY series_id, n = 0 ORDER BY ps) AS grp FROM dd)"""


def sparse_days(spark, d):
    keyed = events(spark, d).withColumn("series_id", F.concat("event_type", F.lit("-"), "user_id"))
    return weekly.period_counts(keyed, "ts", "D", ["series_id"])


@query("c4_spine", with_views("ev", _SPARSE_SQL + f" SELECT series_id, {ssql('ps')} AS period_start, n AS total_comments FROM dd"))
def _(spark, d):
    return sparse_days(spark, d).select("series_id", stamp("period_start").alias("period_start"), "total_comments")


@query("e1_gap_runs", with_views("ev", _SPARSE_SQL + f" SELECT series_id, {ssql('min(ps)')} AS start, {ssql('max(ps)')} AS \"end\", count(*) AS periods FROM isl WHERE n = 0 GROUP BY series_id, grp HAVING count(*) >= 2"))
def _(spark, d):
    out = series.gap_runs(sparse_days(spark, d), ["series_id"], "period_start", "total_comments")
    return out.select("series_id", stamp("start").alias("start"), stamp("end").alias("end"), "periods")


@query("e2_longest_dense_run", with_views("ev", _SPARSE_SQL + " SELECT series_id, max(c) AS longest_dense_run FROM (SELECT series_id, count(*) AS c FROM isl WHERE n > 0 GROUP BY series_id, grp) GROUP BY 1"))
def _(spark, d):
    return series.longest_dense_run(sparse_days(spark, d), ["series_id"], "period_start", "total_comments")


@query("d8_count_quantiles", with_views("ev", _SPARSE_SQL + f""" SELECT series_id, {rsql('min(n)')} AS min, {rsql('quantile_cont(n, 0.25)')} AS p25, {rsql('median(n)')} AS median,
  {rsql('quantile_cont(n, 0.75)')} AS p75, {rsql('max(n)')} AS max, {rsql('avg(n)')} AS mean FROM dd GROUP BY 1"""))
def _(spark, d):
    out = weekly.count_quantiles(sparse_days(spark, d), series_cols=["series_id"])
    return out.select("series_id", *[rnd(c).alias(c) for c in ("min", "p25", "median", "p75", "max", "mean")])


_COVER_SQL = """, q AS (SELECT * REPLACE (CASE WHEN k < 5 THEN NULL ELSE ts END AS ts) FROM ev),
  c AS (SELECT date_trunc('week', ts) AS ps, count(*) AS n FROM q WHERE ts IS NOT NULL GROUP BY 1),
  sp AS (SELECT unnest(generate_series((SELECT min(ps) FROM c), (SELECT max(ps) FROM c), INTERVAL 7 DAY)) AS ps)"""


def _some_times(spark, d):
    return events(spark, d).withColumn("timestamp", F.when(F.col("k") >= 5, F.col("ts")))


@query("d9_coverage_audit", with_views("ev cal", _COVER_SQL + f""" SELECT {ssql('(SELECT min(ts) FROM q)')} AS earliest, {ssql('(SELECT max(ts) FROM q)')} AS latest,
  (SELECT count(ts) FROM q) AS rows_with_timestamp, (SELECT count(*) - count(ts) FROM q) AS rows_without_timestamp,
  (SELECT count(*) FROM sp) AS observed_periods, (SELECT count(*) FROM c) AS non_empty_periods, 'minimal' AS complexity_tier,
  (SELECT count(*) FROM c) AS longest_dense_run, 0::BIGINT AS gaps,
  (SELECT count(*) FROM cal WHERE (SELECT count(*) FROM sp WHERE ps < event_date) >= 2 AND (SELECT count(*) FROM sp WHERE ps >= event_date) >= 2) AS usable_event_periods,
  {', '.join(f"{rsql(v)} AS comments_per_period_{n}" for n, v in (("min", "min(n)"), ("p25", "quantile_cont(n, 0.25)"), ("median", "median(n)"), ("p75", "quantile_cont(n, 0.75)"), ("max", "max(n)"), ("mean", "avg(n)")))}
  FROM (SELECT coalesce(c.n, 0) AS n FROM sp LEFT JOIN c USING (ps))"""))
def _(spark, d):
    out = weekly.coverage_audit(_some_times(spark, d), calendar=calendar(spark))
    return out.withColumns({"earliest": stamp("earliest"), "latest": stamp("latest"), **{c: rnd(c) for c in out.columns if c.startswith("comments_per_period")}})


@query("d9_coverage_details", with_views("ev cal", f""", q AS (SELECT event_type AS source, CASE WHEN day(ts) % 5 < 2 THEN NULL ELSE date_trunc('day', ts) END AS ps FROM ev),
  c AS (SELECT ps, count(*) AS n FROM q WHERE ps IS NOT NULL GROUP BY 1),
  sp AS (SELECT unnest(generate_series((SELECT min(ps) FROM c), (SELECT max(ps) FROM c), INTERVAL 1 DAY)) AS ps),
  g AS (SELECT ps, row_number() OVER (ORDER BY ps) - row_number() OVER (PARTITION BY n IS NULL ORDER BY ps) AS grp, n FROM sp LEFT JOIN c USING (ps)),
  e AS (SELECT event_name, event_date, (SELECT count(*) FROM sp WHERE ps < event_date) AS b, (SELECT count(*) FROM sp WHERE ps >= event_date) AS a FROM cal)
  SELECT 'source' AS section, source AS item, CAST(NULL AS VARCHAR) AS start, CAST(NULL AS VARCHAR) AS "end", count(DISTINCT ps) AS periods, CAST(NULL AS BIGINT) AS periods_before,
    CAST(NULL AS BIGINT) AS periods_after, CAST(NULL AS BOOLEAN) AS usable FROM q WHERE ps IS NOT NULL GROUP BY source
  UNION ALL SELECT 'gap', NULL, {ssql('min(ps)')}, {ssql('max(ps)')}, count(*), NULL, NULL, NULL FROM g WHERE n IS NULL GROUP BY grp HAVING count(*) >= 2
  UNION ALL SELECT 'event', event_name, {ssql('event_date')}, NULL, NULL, b, a, b >= 2 AND a >= 2 FROM e"""))
def _(spark, d):
    rows = events(spark, d).select(F.col("event_type").alias("source"), F.when(F.dayofmonth("ts") % 5 >= 2, F.col("ts")).alias("timestamp"))
    return weekly.coverage_details(rows, "D", calendar(spark)).withColumns({"start": stamp("start"), "end": stamp("end")})


@query("c18_event_usability", with_views("ev cal", _COVER_SQL + """, u AS (SELECT event_name, (SELECT count(*) FROM sp WHERE ps < event_date) AS periods_before,
  (SELECT count(*) FROM sp WHERE ps >= event_date) AS periods_after FROM cal) SELECT *, periods_before >= 2 AND periods_after >= 2 AS usable FROM u"""))
def _(spark, d):
    periods = weekly.period_counts(_some_times(spark, d), "timestamp")
    return cal_ops.event_usability(periods, calendar(spark)).select("event_name", "periods_before", "periods_after", "usable")


@query("d10_periods_per_source", with_views("sig", " SELECT source, count(DISTINCT date_trunc('week', timestamp)) AS periods FROM sig GROUP BY 1"))
def _(spark, d):
    return weekly.periods_per_source(signals(spark, d))


@query("d13_daily_sentiment", with_views("sig", f" SELECT {ssql('''date_trunc('day', timestamp)''')} AS day, {rsql('avg(vader_compound)')} AS mean_sentiment FROM sig GROUP BY 1"))
def _(spark, d):
    return weekly.daily_sentiment(signals(spark, d)).select(stamp("day").alias("day"), rnd("mean_sentiment").alias("mean_sentiment"))


# --- order weeks as long series -------------------------------------------------------

@query("c2_gated_event_features", with_views("ordw ocal", f""", o AS (SELECT DISTINCT period_start AS origin FROM ordw),
  pr AS (SELECT DISTINCT w.period_start, o.origin FROM ordw w JOIN o ON w.period_start <= o.origin),
  l AS (SELECT period_start, origin, max(event_date) AS ed, arg_max(event_name, event_date) AS en, arg_max(event_type, event_date) AS et
    FROM pr LEFT JOIN ocal ON event_date <= period_start AND announced_date <= origin GROUP BY 1, 2)
  SELECT {ssql('period_start')} AS period_start, {ssql('origin')} AS origin, coalesce(en, 'pre_announcement') AS last_event_name,
   {rsql('(epoch_us(period_start) - epoch_us(ed)) / 8.64e10 / 7')} AS weeks_since_event,
   CASE WHEN (epoch_us(period_start) - epoch_us(ed)) / 8.64e10 / 7 < 4 THEN 1 ELSE 0 END AS event_active,
   {rsql('coalesce(pow(0.5, (epoch_us(period_start) - epoch_us(ed)) / 8.64e10 / 7 / 3.0), 0)')} AS event_decay, coalesce(et, '') AS event_type FROM l"""))
def _(spark, d):
    weeks = order_weeks(spark, d)
    origins = weeks.select(F.col("period_start").alias("origin")).distinct()
    last = origins.agg(F.max("origin")).first()[0]
    # Weeks are regular: the origins of a period are the weeks from it to the last one.
    later = F.explode(F.sequence("period_start", F.lit(last).cast("timestamp"), F.expr("INTERVAL 7 DAY")))
    pairs = weeks.select("period_start").distinct().withColumn("origin", later).join(origins, "origin")
    out = cal_ops.event_features(pairs, calendar(spark, ORDER_CALENDAR_ROWS), "period_start", "origin")
    return out.select(stamp("period_start").alias("period_start"), stamp("origin").alias("origin"), "last_event_name",
                      rnd("weeks_since_event").alias("weeks_since_event"), "event_active", rnd("event_decay").alias("event_decay"), "event_type")


@query("i17_event_decay", with_views("ordw ocal", f""", l AS (SELECT DISTINCT period_start, (epoch_us(period_start) - epoch_us(event_date)) / 8.64e10 / 7 AS w FROM ordw ASOF LEFT JOIN ocal ON period_start >= event_date)
  SELECT {ssql('period_start')} AS period_start, {rsql('coalesce(pow(0.5, w / 3.0), 0)')} AS event_decay, CASE WHEN w < 4 THEN 1 ELSE 0 END AS event_active FROM l"""))
def _(spark, d):
    periods = order_weeks(spark, d).select("period_start").distinct()
    out = cal_ops.event_features(periods, calendar(spark, ORDER_CALENDAR_ROWS))
    return out.select(stamp("period_start").alias("period_start"), rnd("event_decay").alias("event_decay"), "event_active")


@query("b11_trim_leading", with_views("ordw", f""", z AS (SELECT *, CASE WHEN idx < 9 OR series_id = '5-LOW' THEN 0.0 ELSE value END AS v FROM ordw),
  m AS (SELECT *, min(CASE WHEN v > 0 THEN idx END) OVER (PARTITION BY series_id) AS f FROM z)
  SELECT series_id, {ssql('period_start')} AS period_start, {rsql('v')} AS v FROM m WHERE f IS NULL OR idx >= f"""))
def _(spark, d):
    zeroed = order_weeks(spark, d).withColumn("v", F.when((F.col("idx") < 9) | (F.col("series_id") == "5-LOW"), 0.0).otherwise(F.col("value")))
    return series.trim_leading_empty(zeroed, ["series_id"], "period_start", "v").select("series_id", stamp("period_start").alias("period_start"), rnd("v").alias("v"))


@query("b12_drop_undefined", with_views("ordw", f""" SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS INTEGER) AS period_index, {rsql('value')} AS v FROM ordw WHERE total_comments % 4 <> 0"""))
def _(spark, d):
    holes = order_weeks(spark, d).withColumn("v", F.when(F.col("total_comments") % 4 != 0, F.col("value")))
    return series.drop_undefined(holes, ["series_id"], "period_start", "v").select("series_id", "period_index", rnd("v").alias("v"))


@query("b13_targets_long", with_views("ordw", f""" SELECT series_id, {ssql('period_start')} AS period_start, 'total_comments' AS target, {rsql('total_comments')} AS value FROM ordw
  UNION ALL SELECT series_id, {ssql('period_start')}, 'value', {rsql('value')} FROM ordw"""))
def _(spark, d):
    out = series.select_targets(order_weeks(spark, d), ["series_id"], "period_start", ["total_comments", "value"])
    return out.select("series_id", stamp("period_start").alias("period_start"), "target", rnd("value").alias("value"))


@query("b14_target_kind", with_views("ordw", " SELECT target, CASE target WHEN 'total_comments' THEN 'count' ELSE 'continuous_nonnegative' END AS kind, count(*) AS n FROM ordw, (VALUES ('total_comments'), ('value')) t(target) GROUP BY 1, 2"))
def _(spark, d):
    out = series.select_targets(order_weeks(spark, d), ["series_id"], "period_start", ["total_comments", "value"])
    return out.groupBy("target", series.target_kind(F.col("target")).alias("kind")).agg(F.count("*").alias("n"))


@query("d54_series_profile", with_views("ordw", f""" SELECT series_id, count(*) AS periods, count(*) FILTER (total_comments > 0) AS non_empty_periods,
  {rsql('avg(CASE WHEN total_comments <= 0 THEN 1.0 ELSE 0.0 END)')} AS zero_period_share, bool_or(total_comments <= 0) AS has_zero,
  {rsql('var_pop(total_comments) / avg(total_comments)')} AS dispersion_ratio,
  CASE WHEN count(*) FILTER (total_comments > 0) < 30 THEN 'minimal' WHEN count(*) FILTER (total_comments > 0) <= 60 THEN 'moderate' ELSE 'rich' END AS complexity_tier,
  'negative_binomial' AS likelihood FROM ordw GROUP BY 1"""))
def _(spark, d):
    out = series.series_profile(order_weeks(spark, d), ["series_id"], "total_comments", F.lit("count"))
    return out.withColumns({c: rnd(c) for c in ("zero_period_share", "dispersion_ratio")})


@query("d64_zero_share", with_views("ordw", f""" SELECT series_id, count(*) FILTER (v > 0) AS non_empty_periods, {rsql('avg(CASE WHEN v <= 0 THEN 1.0 ELSE 0.0 END)')} AS zero_period_share,
  CASE WHEN bool_or(v <= 0) THEN 'hurdle_gamma' ELSE 'gamma' END AS likelihood FROM (SELECT series_id, CASE WHEN value < 400 THEN 0.0 ELSE value END AS v FROM ordw) GROUP BY 1"""))
def _(spark, d):
    sparse = order_weeks(spark, d).withColumn("v", F.when(F.col("value") < 400, 0.0).otherwise(F.col("value")))
    out = series.series_profile(sparse, ["series_id"], "v", F.lit("continuous_nonnegative"))
    return out.select("series_id", "non_empty_periods", rnd("zero_period_share").alias("zero_period_share"), "likelihood")


@query("d55_identifiable_features", with_views("ordw", """, l AS (SELECT series_id, f.feature, CASE f.feature WHEN 'flat' THEN 1.0 ELSE total_comments END AS v FROM ordw, (VALUES ('flat'), ('total_comments')) f(feature))
  SELECT series_id, feature, stddev_pop(v) > 0 AS identifiable FROM l GROUP BY 1, 2"""))
def _(spark, d):
    return series.identifiable_features(order_weeks(spark, d).withColumn("flat", F.lit(1.0)), ["series_id"], ["flat", "total_comments"])


@query("e11_lag_design", with_views("ordw", f", l AS (SELECT *, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2 FROM ordw WINDOW w AS (PARTITION BY series_id ORDER BY idx)) SELECT series_id, {ssql('period_start')} AS period_start, {rsql('value')} AS value, {rsql('l1')} AS lag_1, {rsql('l2')} AS lag_2, total_comments FROM l WHERE l2 IS NOT NULL"))
def _(spark, d):
    out = series.lag_design(order_weeks(spark, d), ["series_id"], "period_start", "value", exog_cols=["total_comments"])
    return out.select("series_id", stamp("period_start").alias("period_start"), *[rnd(c).alias(c) for c in ("value", "lag_1", "lag_2")], "total_comments")


@query("e12_time_terms", with_views("ordw", f", n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM ordw) SELECT series_id, idx, {rsql('(idx - (n - 1) / 2.0) / (n - 1)')} AS time_index, {rsql('sin(2 * pi() * idx / 52.0)')} AS seasonal_sin, {rsql('cos(2 * pi() * idx / 52.0)')} AS seasonal_cos FROM n"))
def _(spark, d):
    out = series.time_terms(order_weeks(spark, d), ["series_id"], "period_start")
    return out.select("series_id", "idx", *[rnd(c).alias(c) for c in ("time_index", "seasonal_sin", "seasonal_cos")])


@query("e13_extended_periods", with_views("ordw", f" SELECT series_id, {ssql('m + to_days(CAST(7 * h AS INTEGER))')} AS period_start FROM (SELECT series_id, max(period_start) AS m FROM ordw GROUP BY 1), generate_series(1, 6) s(h)"))
def _(spark, d):
    return series.extend_periods(order_weeks(spark, d), ["series_id"], "period_start", 6).select("series_id", stamp("period_start").alias("period_start"))


@query("e14_residuals", with_views("ordw", f" SELECT series_id, idx, {rsql('value - lag(value) OVER w')} AS naive_residual, {rsql('value - lag(value, 52) OVER w')} AS seasonal_residual FROM ordw WINDOW w AS (PARTITION BY series_id ORDER BY idx)"))
def _(spark, d):
    out = series.residuals(order_weeks(spark, d), ["series_id"], "period_start", "value")
    return out.select("series_id", "idx", rnd("naive_residual").alias("naive_residual"), rnd("seasonal_residual").alias("seasonal_residual"))


