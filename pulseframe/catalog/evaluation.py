"""Classifier evaluation over event scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.base import events, query, rnd, rsql, with_views
from pulseframe.operators import evaluation as ev_ops

#: Predictions of a fixed rule over the event scores.
_PRED_SQL = ", evp AS (SELECT *, CAST(p > 0.45 AS INTEGER) AS pred, event_type = 'purchase' OR k < 50 AS ok FROM ev)"

_STEP_SQL = """, st AS (SELECT p AS score, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM ev GROUP BY 1),
  cu AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM st WINDOW w AS (ORDER BY score DESC)),
  tot AS (SELECT count(*) AS n, sum(y) AS pos FROM ev)"""


def _edge(i, bins):
    return f"CAST('{i * (1.0 / bins)!r}' AS DOUBLE)"


def _bin_sql(bins):
    return "(" + " + ".join(f"CASE WHEN p >= {_edge(i, bins)} THEN 1 ELSE 0 END" for i in range(1, bins)) + ")"


def predictions(spark, d):
    return events(spark, d).withColumns(
        {"pred": (F.col("p") > 0.45).cast("int"), "ok": (F.col("event_type") == "purchase") | (F.col("k") < 50)})


_CONF = """count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp,
  count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn"""


@query("d25_binary_metrics", with_views("ev", _PRED_SQL + f""", c AS (SELECT {_CONF} FROM evp) SELECT tp, fp, fn, tn,
  tp + fp + fn + tn AS support_total, tp + fn AS support_positive, {rsql('(tp + tn) / (tp + fp + fn + tn)::DOUBLE')} AS accuracy,
  {rsql('tp / (tp + fp)::DOUBLE')} AS precision, {rsql('tp / (tp + fn)::DOUBLE')} AS recall, {rsql('2 * tp / (2 * tp + fp + fn)::DOUBLE')} AS f1 FROM c"""))
def _(spark, d):
    table = ev_ops.score_table(predictions(spark, d), "y", "p", (), "pred")
    return ev_ops.confusion(table).withColumns({c: rnd(c) for c in ("accuracy", "precision", "recall", "f1")})


@query("d26_roc_auc", with_views("ev", _STEP_SQL + f" SELECT {rsql('sum((n - pos) * (cp - pos + pos / 2.0)) / any_value((SELECT pos * (n - pos)::DOUBLE FROM tot))')} AS roc_auc FROM cu"))
def _(spark, d):
    return ev_ops.ranking_areas(ev_ops.score_table(events(spark, d), "y", "p")).select(rnd("roc_auc").alias("roc_auc"))


@query("d27_average_precision", with_views("ev", _STEP_SQL + f" SELECT {rsql('sum(pos * (cp / cn::DOUBLE)) / any_value((SELECT pos::DOUBLE FROM tot))')} AS pr_auc FROM cu"))
def _(spark, d):
    return ev_ops.ranking_areas(ev_ops.score_table(events(spark, d), "y", "p")).select(rnd("pr_auc").alias("pr_auc"))


@query("d28_brier", with_views("ev", f" SELECT {rsql('avg(pow(p - y, 2))')} AS brier_score FROM ev"))
def _(spark, d):
    return ev_ops.brier(ev_ops.score_table(events(spark, d), "y", "p")).select(rnd("brier_score").alias("brier_score"))


@query("d29_calibration_error", with_views("ev", f", b AS (SELECT {_bin_sql(10)} AS bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM ev GROUP BY 1) SELECT {rsql('sum(n * gap) / sum(n)')} AS ece FROM b"))
def _(spark, d):
    return ev_ops.calibration_error(ev_ops.score_table(events(spark, d), "y", "p")).select(rnd("ece").alias("ece"))


@query("d30_calibration_curve", with_views("ev", f" SELECT {_bin_sql(10)} AS bin, count(*) AS n, {rsql('avg(p)')} AS mean_predicted, {rsql('avg(y)')} AS observed_rate FROM ev GROUP BY 1"))
def _(spark, d):
    out = ev_ops.calibration_bins(ev_ops.score_table(events(spark, d), "y", "p"))
    return out.select("bin", "n", rnd("mean_predicted").alias("mean_predicted"), rnd("observed_rate").alias("observed_rate"))


@query("d31_reliability_table", with_views("ev", f""", q AS (SELECT * REPLACE (p * 0.55::DOUBLE AS p) FROM ev),
  b AS (SELECT {_bin_sql(5)} AS bin, count(*)::DOUBLE AS n, avg(p) AS mp, avg(y) AS rate FROM q GROUP BY 1),
  s AS (SELECT * FROM (VALUES (0, '0.0-0.2'), (1, '0.2-0.4'), (2, '0.4-0.6'), (3, '0.6-0.8'), (4, '0.8-1.0')) v(bin, label))
  SELECT label AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n, {rsql('mp')} AS mean_predicted, {rsql('rate')} AS observed_rate,
  {rsql('(p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)')} AS observed_95_low,
  {rsql('(p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)')} AS observed_95_high
  FROM s LEFT JOIN (SELECT *, rate AS p FROM b) b USING (bin)"""))
def _(spark, d):
    table = ev_ops.score_table(events(spark, d).withColumn("p", F.col("p") * 0.55), "y", "p")
    out = ev_ops.reliability_table(spark, table)
    return out.select("bin", "n", *[rnd(c).alias(c) for c in ("mean_predicted", "observed_rate", "observed_95_low", "observed_95_high")])


@query("e7_gains_curve", with_views("ev", f""", r AS (SELECT event_id, row_number() OVER w AS position, sum(y) OVER w AS found,
    count(*) OVER () AS n, sum(y) OVER () AS pos FROM ev WINDOW w AS (ORDER BY p DESC, event_id ROWS UNBOUNDED PRECEDING))
  SELECT event_id, position, {rsql('position / n::DOUBLE')} AS fraction_reviewed, {rsql('found / pos::DOUBLE')} AS gain,
  {rsql('found / position::DOUBLE')} AS precision, {rsql('found / position::DOUBLE / (pos / n::DOUBLE)')} AS lift FROM r"""))
def _(spark, d):
    out = ev_ops.gains_curve(events(spark, d), "y", "p", "event_id")
    return out.select("event_id", "position", *[rnd(c).alias(c) for c in ("fraction_reviewed", "gain", "precision", "lift")])


_AT_SQL = """, r AS (SELECT y, row_number() OVER (ORDER BY p DESC, event_id) AS position FROM ev),
  t AS (SELECT count(*) AS n, sum(y) AS pos FROM ev),
  ks AS (SELECT 'at_' || k AS cutoff, k::BIGINT AS k FROM (VALUES (10), (25), (50), (100)) v(k), t WHERE k <= n
    UNION ALL SELECT name, greatest(1, CAST(round_even(n * q, 0) AS BIGINT)) FROM (VALUES ('at_5pct', 0.05), ('at_10pct', 0.1), ('at_20pct', 0.2)) v(name, q), t),
  h AS (SELECT cutoff, k, CAST(sum(y) FILTER (position <= k) AS BIGINT) AS hits FROM ks, r GROUP BY ALL)"""


@query("e8_ranking_metrics", with_views("ev", _AT_SQL + f""" SELECT cutoff, k, {rsql('hits / k::DOUBLE')} AS precision,
  {rsql('hits / pos::DOUBLE')} AS recall, {rsql('hits / k::DOUBLE / (pos / n::DOUBLE)')} AS lift FROM h, t"""))
def _(spark, d):
    out = ev_ops.ranking_metrics(events(spark, d), "y", "p", "event_id")
    return out.select("cutoff", "k", *[rnd(c).alias(c) for c in ("precision", "recall", "lift")])


_SWEEP_SQL = _STEP_SQL + """, cand AS (SELECT score AS t, cn - n AS picked, cp - pos AS tp FROM cu
    UNION ALL SELECT (SELECT min(score) FROM st) - 1e-9, n, pos FROM tot),
  m AS (SELECT t, CASE WHEN picked > 0 THEN tp / picked::DOUBLE ELSE 0 END AS precision, tp / (SELECT pos FROM tot)::DOUBLE AS recall,
    2 * tp / (picked + (SELECT pos FROM tot))::DOUBLE AS f1 FROM cand)"""


@query("e16_threshold_f1", with_views("ev", _SWEEP_SQL + f" SELECT {rsql('t', 9)} AS selected_threshold, 'f1' AS selection_metric, {rsql('f1')} AS validation_score FROM m ORDER BY f1 DESC, t LIMIT 1"))
def _(spark, d):
    return ev_ops.select_threshold(events(spark, d), "y", "p").withColumns(
        {"selected_threshold": rnd("selected_threshold", 9), "validation_score": rnd("validation_score")})


@query("e16_threshold_min_precision", with_views("ev", _SWEEP_SQL + f" SELECT {rsql('t', 9)} AS selected_threshold, 'min_precision' AS selection_metric, {rsql('recall')} AS validation_score FROM m WHERE precision >= 0.41 ORDER BY recall DESC, t LIMIT 1"))
def _(spark, d):
    return ev_ops.select_threshold(events(spark, d), "y", "p", "min_precision", min_precision=0.41).withColumns(
        {"selected_threshold": rnd("selected_threshold", 9), "validation_score": rnd("validation_score")})


@query("e16_threshold_sweep", with_views("ev", _SWEEP_SQL + f" SELECT {rsql('t', 9)} AS threshold, {rsql('precision')} AS precision, {rsql('recall')} AS recall, {rsql('f1')} AS f1 FROM m"))
def _(spark, d):
    out = ev_ops.threshold_table(ev_ops.score_table(events(spark, d), "y", "p"))
    return out.select(rnd("threshold", 9).alias("threshold"), *[rnd(c).alias(c) for c in ("precision", "recall", "f1")])


@query("d66_scalar_metrics", with_views("ev", _STEP_SQL + _PRED_SQL + _AT_SQL + f""", c AS (SELECT {_CONF} FROM evp),
  b AS (SELECT {_bin_sql(10)} AS bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM ev GROUP BY 1)
  SELECT {rsql('(SELECT sum(pos * (cp / cn::DOUBLE)) FROM cu) / tot.pos')} AS pr_auc,
  {rsql('(SELECT sum((n - pos) * (cp - pos + pos / 2.0)) FROM cu) / (tot.pos * (tot.n - tot.pos)::DOUBLE)')} AS roc_auc,
  {rsql('(SELECT avg(pow(p - y, 2)) FROM ev)')} AS brier, {rsql('(SELECT sum(n * gap) / sum(n) FROM b)')} AS ece,
  {rsql('tp / (tp + fp)::DOUBLE')} AS precision, {rsql('tp / (tp + fn)::DOUBLE')} AS recall, {rsql('2 * tp / (2 * tp + fp + fn)::DOUBLE')} AS f1,
  {rsql('tot.pos / tot.n::DOUBLE')} AS base_rate,
  {rsql("(SELECT hits / k::DOUBLE FROM h WHERE cutoff = 'at_10pct')")} AS precision_at_10pct,
  {rsql("(SELECT hits / k::DOUBLE FROM h WHERE cutoff = 'at_10pct') / (tot.pos / tot.n::DOUBLE)")} AS lift_at_10pct,
  {rsql("(SELECT hits / k::DOUBLE FROM h WHERE cutoff = 'at_20pct') / (tot.pos / tot.n::DOUBLE)")} AS lift_at_20pct FROM c, tot"""))
def _(spark, d):
    out = ev_ops.scalar_metrics(predictions(spark, d), "y", "pred", "p", "event_id")
    return out.select(*[rnd(c).alias(c) for c in out.columns])


@query("d34_error_slices", with_views("ev", _PRED_SQL + f""", long AS (
    SELECT 'event_type' AS dimension, event_type AS value, y, pred, p, ok FROM evp
    UNION ALL SELECT 'tier', CASE WHEN k < 30 THEN 'low' ELSE 'high' END, y, pred, p, ok FROM evp)
  SELECT dimension, value, count(*) AS n, CAST(sum(y) AS BIGINT) AS actionable, {rsql('avg(pred) FILTER (y = 1)')} AS recall,
  {rsql('avg(pred) FILTER (y = 0)')} AS false_positive_rate, {rsql('avg(pow(p - y, 2))')} AS brier,
  {rsql('avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)')} AS e2e_accuracy FROM long GROUP BY 1, 2"""))
def _(spark, d):
    frame = predictions(spark, d).withColumn("tier", F.when(F.col("k") < 30, "low").otherwise("high"))
    out = ev_ops.error_slices(frame, ["event_type", "tier"], "y", "pred", "p", "ok")
    return out.withColumns({c: rnd(c) for c in ("recall", "false_positive_rate", "brier", "e2e_accuracy")})


@query("d35_group_stability", with_views("ev", _PRED_SQL + f""" SELECT user_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS actionable,
  {rsql('avg(y)')} AS observed_rate, {rsql('avg(p)')} AS mean_p_actionable, {rsql('avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END)')} AS stage1_accuracy,
  {rsql('avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)')} AS e2e_accuracy FROM evp GROUP BY 1"""))
def _(spark, d):
    out = ev_ops.group_stability(predictions(spark, d), "user_id", "y", "pred", "p", "ok")
    return out.withColumns({c: rnd(c) for c in ("observed_rate", "mean_p_actionable", "stage1_accuracy", "e2e_accuracy")})


@query("f5_confident_errors", with_views("ev", _PRED_SQL + f""" SELECT event_id, CASE WHEN pred = 1 THEN 'false_positive' ELSE 'false_negative' END AS error_kind,
  {rsql('abs(p - 0.5)')} AS error_confidence FROM evp WHERE pred <> y ORDER BY abs(p - 0.5) DESC, event_id LIMIT 50"""))
def _(spark, d):
    out = ev_ops.confident_errors(predictions(spark, d), "y", "pred", "p", "event_id")
    return out.select("event_id", "error_kind", rnd("error_confidence").alias("error_confidence"))


@query("g2_stage_errors", with_views("ev", _PRED_SQL + " SELECT event_id, CASE WHEN pred = 1 THEN 'false_positive' ELSE 'false_negative' END AS error_kind FROM evp WHERE pred <> y"))
def _(spark, d):
    return ev_ops.stage_errors(predictions(spark, d), "y", "pred").select("event_id", "error_kind")


@query("h11_group_bootstrap")
def _(spark, d):
    out = ev_ops.group_bootstrap(events(spark, d), "user_id", "y", "p")
    return out.select("metric", rnd("low").alias("low"), rnd("high").alias("high"))
