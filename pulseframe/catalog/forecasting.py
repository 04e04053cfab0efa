"""Backtests, monitoring, ranking and model choice over order weeks (A15, A17, C15, D36, D43-D50, D63, E4-E6, F9, F10, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.base import (
    ORDER_CALENDAR_ROWS,
    backtest_rows,
    calendar,
    order_weeks,
    query,
    rnd,
    rsql,
    ssql,
    stamp,
    with_views,
)
from pulseframe.operators import agreement, compare, evaluation, forecasters, states
from pulseframe.operators import backtest as bt_ops
from pulseframe.plans import forecasting as plan
from pulseframe.session import work_path

KEYS = ["series_id"]
BT = "ordw bt"


@query("k1_rolling_origins", with_views("ordw", """, n AS (SELECT series_id, count(*) AS n FROM ordw GROUP BY 1)
  SELECT series_id, CAST(o AS INTEGER) AS origin, CAST(h AS INTEGER) AS horizon_step, CAST(o - 1 AS INTEGER) AS train_end, CAST(o + h - 1 AS INTEGER) AS period_index
  FROM n, generate_series(12, n - 2, 2) g(o), generate_series(1, 2) s(h)"""))
def _(spark, d):
    return bt_ops.rolling_origins(order_weeks(spark, d), KEYS)


@query("k2_no_future", with_views("ordw", """, n AS (SELECT series_id, count(*) AS n FROM ordw GROUP BY 1)
  SELECT series_id, count(*) AS pairs, 0::BIGINT AS leaking FROM n, generate_series(12, n - 2, 2) g(o), generate_series(1, 2) s(h) GROUP BY 1"""))
def _(spark, d):
    rows = bt_ops.rolling_origins(order_weeks(spark, d), KEYS)
    return rows.groupBy("series_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("train_end") >= F.col("period_index")).alias("leaking"))


def _round_rows(df):
    return df.select("series_id", "model", "origin", "horizon_step", "period_index",
                     rnd("actual", 4).alias("actual"), rnd("forecast", 8).alias("forecast"), rnd("lower", 4).alias("lower"), rnd("upper", 4).alias("upper"))


_BT_ROWS = "SELECT series_id, model, origin, horizon_step, period_index, " + ", ".join(f"{rsql(c, n)} AS {c}" for c, n in (("actual", 4), ("forecast", 8), ("lower", 4), ("upper", 4))) + " FROM bt"


@query("k3_backtest", with_views(BT, _BT_ROWS))
def _(spark, d):
    return _round_rows(backtest_rows(spark, d))


for _name, _model in (("k4_naive", "naive"), ("k5_trailing_mean", "mean"), ("k6_seasonal_naive", "seasonal_naive")):
    def _one(spark, d, model=_model):
        rows = bt_ops.backtest(order_weeks(spark, d), KEYS, "period_start", "value", models=(model,), min_train=60)
        return _round_rows(rows)

    query(_name, with_views(BT, _BT_ROWS + f" WHERE model = '{_model}'"))(_one)


@query("k7_exponential_smoothing")
def _(spark, d):
    return _round_rows(forecasters.smoothing_backtest(order_weeks(spark, d), KEYS, "period_start", "value", min_train=60))


@query("k8_ridge_events")
def _(spark, d):
    cal = calendar(spark, ORDER_CALENDAR_ROWS)
    return _round_rows(forecasters.ridge_backtest(order_weeks(spark, d), cal, KEYS, "period_start", "value", min_train=60))


@query("k9_prediction_intervals", with_views(BT, f" SELECT series_id, model, horizon_step, count(*) AS n, {rsql('avg(upper - lower)', 4)} AS mean_width, min(CASE WHEN lower <= forecast AND forecast <= upper AND lower >= 0 THEN 1 ELSE 0 END) AS holds FROM bt GROUP BY ALL"))
def _(spark, d):
    holds = (F.col("lower") <= F.col("forecast")) & (F.col("forecast") <= F.col("upper")) & (F.col("lower") >= 0)
    return backtest_rows(spark, d).groupBy("series_id", "model", "horizon_step").agg(
        F.count("*").alias("n"), rnd(F.avg(F.col("upper") - F.col("lower")), 4).alias("mean_width"), F.min(holds.cast("int")).alias("holds"))


@query("k10_eligible_models", with_views("ordw", """, n AS (SELECT series_id, count(*) AS n FROM ordw GROUP BY 1)
  SELECT series_id, min_train, 'naive,mean' || CASE WHEN n >= 104 AND least(n, min_train) >= 52 THEN ',seasonal_naive' ELSE '' END
   || CASE WHEN least(n, min_train) >= 8 THEN ',exponential_smoothing' ELSE '' END || CASE WHEN least(n, min_train) >= 16 THEN ',ridge_event' ELSE '' END AS models
  FROM n, (VALUES (6), (12), (60)) t(min_train)"""))
def _(spark, d):
    sizes = order_weeks(spark, d).groupBy("series_id").agg(F.count("*").alias("n"))
    parts = [sizes.select("series_id", F.lit(m).alias("min_train"), F.array_join(bt_ops.eligible_models(F.col("n"), m), ",").alias("models")) for m in (6, 12, 60)]
    return parts[0].union(parts[1]).union(parts[2])


@query("k11_exog_blocks", with_views("ordw ocal", f""", n AS (SELECT series_id, count(*) AS n FROM ordw GROUP BY 1),
  o AS (SELECT n.series_id, o AS origin, w.period_start AS known FROM n, generate_series(60, n - 2, 2) g(o) JOIN ordw w ON w.series_id = n.series_id AND w.idx = o - 1),
  r AS (SELECT w.series_id, o.origin, o.known, w.idx, w.period_start FROM ordw w JOIN o ON w.series_id = o.series_id AND w.idx < o.origin + 2),
  l AS (SELECT series_id, origin, idx, any_value(period_start) AS ps, max(event_date) AS ed, arg_max(c.major_announcement_flag, event_date) AS mf
    FROM r LEFT JOIN ocal c ON event_date <= period_start AND announced_date <= known GROUP BY 1, 2, 3)
  SELECT series_id, CAST(origin AS INTEGER) AS origin, idx AS period_index, idx < origin AS in_training,
   CASE WHEN (epoch_us(ps) - epoch_us(ed)) / 8.64e10 / 7 < 4 THEN 1 ELSE 0 END AS event_active,
   {rsql('coalesce(pow(0.5, (epoch_us(ps) - epoch_us(ed)) / 8.64e10 / 7 / 3.0), 0)')} AS event_decay, coalesce(mf, 0) AS major_announcement_flag FROM l"""))
def _(spark, d):
    out = forecasters.exog_blocks(order_weeks(spark, d), calendar(spark, ORDER_CALENDAR_ROWS), KEYS, "period_start", min_train=60)
    return out.select("series_id", "origin", "period_index", "in_training", "event_active", rnd("event_decay").alias("event_decay"), "major_announcement_flag")


@query("k14_bootstrap_draws")
def _(spark, d):
    out = forecasters.bootstrap_draws(order_weeks(spark, d), KEYS, "period_start", "value")
    return out.select("series_id", "draw", "step", rnd("value", 4).alias("value"))


@query("k15_future_forecast", with_views("ordw", f""", e AS (SELECT series_id, max(idx) AS m, max(period_start) AS mp FROM ordw GROUP BY 1),
  r AS (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS r FROM ordw),
  q AS (SELECT series_id, quantile_cont(r, 0.1) AS lo, quantile_cont(r, 0.9) AS hi FROM r GROUP BY 1)
  SELECT e.series_id, {ssql('mp + to_days(CAST(7 * h AS INTEGER))')} AS period_start, CAST(h AS INTEGER) AS horizon_step, 'naive' AS model, {rsql('value', 4)} AS forecast,
    {rsql('greatest(least(value + lo * sqrt(h), value), 0)', 4)} AS lower, {rsql('greatest(value + hi * sqrt(h), value)', 4)} AS upper
  FROM e JOIN ordw w ON w.series_id = e.series_id AND w.idx = e.m JOIN q ON q.series_id = e.series_id, generate_series(1, 4) s(h)"""))
def _(spark, d):
    out = bt_ops.future_forecast(order_weeks(spark, d), KEYS, "period_start", "value", models=("naive",))
    return out.select("series_id", stamp("period_start").alias("period_start"), "horizon_step", "model", *[rnd(c, 4).alias(c) for c in ("forecast", "lower", "upper")])


#: Simple smoothing with a fixed weight of 0.3: the level is linear in the start level, whose best value has a closed form.
_SMOOTH_SQL = """, xs AS (SELECT series_id, idx, value FROM ordw UNION ALL SELECT series_id, max(idx) + 1, NULL FROM ordw GROUP BY 1),
  bs AS (SELECT x.series_id, x.idx, any_value(x.value) AS v, coalesce(sum(0.3 * pow(0.7, x.idx - 1 - o.idx) * o.value), 0) AS base, pow(0.7, x.idx) AS share
    FROM xs x LEFT JOIN ordw o ON o.series_id = x.series_id AND o.idx < x.idx GROUP BY x.series_id, x.idx),
  stt AS (SELECT *, sum(share * (v - base)) OVER w / sum(share * share) OVER w AS start FROM bs
    WINDOW w AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  sm AS (SELECT t.series_id, t.idx AS origin, any_value(t.base + t.share * t.start) AS level,
    quantile_cont(b.v - b.base - b.share * t.start, 0.1) AS lo, quantile_cont(b.v - b.base - b.share * t.start, 0.9) AS hi
    FROM stt t JOIN bs b ON b.series_id = t.series_id AND b.idx < t.idx WHERE t.idx >= 60 GROUP BY t.series_id, t.idx)"""
#: Ridge on two lags by its normal equations, for every origin.
_RIDGE_SQL = """, lg AS (SELECT series_id, idx, value AS y, lag(value) OVER w AS a, lag(value, 2) OVER w AS b FROM ordw WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
  og AS (SELECT series_id, idx + 1 AS origin, y AS l1, a AS l2 FROM lg WHERE idx >= 59),
  mo AS (SELECT o.series_id, o.origin, any_value(l1) AS l1, any_value(l2) AS l2, avg(y) AS my, avg(a) AS ma, avg(b) AS mb,
    var_pop(a) * count(*) + 1 AS aa, var_pop(b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS by_
    FROM og o JOIN lg l ON l.series_id = o.series_id AND l.idx < o.origin AND l.idx >= 2 GROUP BY 1, 2),
  sl AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS p, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM mo),
  rd AS (SELECT s.series_id, s.origin, any_value(my + p * (l1 - ma) + q * (l2 - mb)) AS f1, any_value(columns(s.* EXCLUDE (series_id, origin))),
    quantile_cont(y - my - p * (a - ma) - q * (b - mb), 0.1) AS lo, quantile_cont(y - my - p * (a - ma) - q * (b - mb), 0.9) AS hi
    FROM sl s JOIN lg l ON l.series_id = s.series_id AND l.idx < s.origin AND l.idx >= 2 GROUP BY s.series_id, s.origin),
  rr AS (SELECT *, my + p * (f1 - ma) + q * (l1 - mb) AS f2 FROM rd),
  rs AS (SELECT *, my + p * (f2 - ma) + q * (f1 - mb) AS f3 FROM rr),
  rt AS (SELECT *, my + p * (f3 - ma) + q * (f2 - mb) AS f4 FROM rs),
  ri AS (SELECT series_id, origin, h, CASE h WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 ELSE f4 END AS f, lo, hi FROM rt, (VALUES (1), (2), (3), (4)) t(h))"""


def _steps_sql(model: str, rows: str) -> str:
    """Backtest rows of ``rows (series_id, origin, h, f, lo, hi)`` on the grid of origins."""
    return f""" SELECT r.series_id, '{model}' AS model, CAST(origin AS INTEGER) AS origin, CAST(h AS INTEGER) AS horizon_step, CAST(origin + h - 1 AS INTEGER) AS period_index,
    {rsql('o.value', 4)} AS actual, {rsql('greatest(f, 0)', 4)} AS forecast, {rsql('greatest(least(greatest(f, 0) + lo * sqrt(h), greatest(f, 0)), 0)', 4)} AS lower,
    {rsql('greatest(greatest(f, 0) + hi * sqrt(h), greatest(f, 0))', 4)} AS upper
  FROM ({rows}) r JOIN ordw o ON o.series_id = r.series_id AND o.idx = origin + h - 1
  JOIN (SELECT series_id, count(*) AS n FROM ordw GROUP BY 1) n ON n.series_id = r.series_id
  WHERE origin >= 60 AND (origin - 60) % 2 = 0 AND origin + 2 <= n AND h <= 2"""


def _four_digits(df):
    return _round_rows(df).withColumn("forecast", rnd("forecast", 4))


@query("k7_fixed_smoothing", with_views("ordw", _SMOOTH_SQL + _steps_sql("exponential_smoothing", "SELECT series_id, origin, h, level AS f, lo, hi FROM sm, (VALUES (1), (2)) t(h)")))
def _(spark, d):
    return _four_digits(forecasters.smoothing_backtest(order_weeks(spark, d), KEYS, "period_start", "value", min_train=60, alpha=0.3))


@query("k8_ridge_two_lags", with_views("ordw", _RIDGE_SQL + _steps_sql("ridge_event", "SELECT * FROM ri")))
def _(spark, d):
    return _four_digits(forecasters.ridge_backtest(order_weeks(spark, d), None, KEYS, "period_start", "value", features=(), min_train=60))


@query("k15_future_all_models", with_views("ordw", _SMOOTH_SQL + _RIDGE_SQL + f""",
  en AS (SELECT series_id, max(idx) + 1 AS n, max(period_start) AS mp, arg_max(value, idx) AS last, avg(value) FILTER (idx > m - 8) AS mean,
      quantile_cont(value, 0.1) AS vlo, quantile_cont(value, 0.9) AS vhi
    FROM (SELECT *, max(idx) OVER (PARTITION BY series_id) AS m FROM ordw) GROUP BY 1),
  rq AS (SELECT series_id, quantile_cont(r, 0.1) AS lo, quantile_cont(r, 0.9) AS hi, quantile_cont(s, 0.1) AS slo, quantile_cont(s, 0.9) AS shi FROM
    (SELECT series_id, value - lag(value) OVER w AS r, value - lag(value, 52) OVER w AS s FROM ordw WINDOW w AS (PARTITION BY series_id ORDER BY idx)) GROUP BY 1),
  al AS (SELECT en.series_id, 'naive' AS model, h, last AS f, lo, hi FROM en JOIN rq USING (series_id), generate_series(1, 4) s(h)
    UNION ALL SELECT series_id, 'mean', h, mean, vlo - mean, vhi - mean FROM en, generate_series(1, 4) s(h)
    UNION ALL SELECT en.series_id, 'seasonal_naive', h, value, slo, shi FROM en JOIN rq USING (series_id), generate_series(1, 4) s(h), ordw o WHERE o.series_id = en.series_id AND o.idx = n - 53 + h AND n >= 104
    UNION ALL SELECT en.series_id, 'exponential_smoothing', h, level, lo, hi FROM en JOIN sm ON sm.series_id = en.series_id AND origin = n, generate_series(1, 4) s(h)
    UNION ALL SELECT en.series_id, 'ridge_event', h, f, lo, hi FROM en JOIN ri ON ri.series_id = en.series_id AND origin = n)
  SELECT series_id, {ssql('mp + to_days(CAST(7 * h AS INTEGER))')} AS period_start, CAST(h AS INTEGER) AS horizon_step, model, {rsql('greatest(f, 0)', 4)} AS forecast,
    {rsql('greatest(least(greatest(f, 0) + lo * sqrt(h), greatest(f, 0)), 0)', 4)} AS lower, {rsql('greatest(greatest(f, 0) + hi * sqrt(h), greatest(f, 0))', 4)} AS upper
  FROM al JOIN en USING (series_id)"""))
def _(spark, d):
    made = states.fitted_states(order_weeks(spark, d), KEYS, "period_start", "value", features=(), alpha=0.3)
    out = states.roll_forward(made, KEYS, "period_start", features=())
    return out.select("series_id", stamp("period_start").alias("period_start"), "horizon_step", "model", *[rnd(c, 4).alias(c) for c in ("forecast", "lower", "upper")])


@query("k13_selected_forecast")
def _(spark, d):
    written = plan.run_experiment(
        order_weeks(spark, d), work_path(spark, "experiment"), ("total_comments",), series_cols=KEYS, calendar=calendar(spark, ORDER_CALENDAR_ROWS),
        models=tuple(bt_ops.COMPLEXITY), min_train=60)
    out = spark.read.parquet(written["selected_forecast"])
    return out.select("series_id", "target", stamp("period_start").alias("period_start"), "horizon_step", "model", *[rnd(c, 4).alias(c) for c in ("forecast", "lower", "upper")])


# --- errors, monitoring and flags ------------------------------------------------------

_METRIC = f"""count(*) AS n, {rsql('avg(abs(forecast - actual))', 4)} AS mae, {rsql('sqrt(avg(pow(forecast - actual, 2)))', 4)} AS rmse,
  {rsql('sum(abs(forecast - actual)) / sum(abs(actual))')} AS wape, {rsql('avg(forecast - actual)', 4)} AS bias, {rsql('avg(forecast - actual) / avg(abs(actual))')} AS relative_bias,
  {rsql('avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END)')} AS interval_coverage, {rsql('avg(upper - lower)', 4)} AS mean_interval_width"""


def _round_metrics(df):
    four = {c: rnd(c, 4) for c in ("mae", "rmse", "bias", "mean_interval_width")}
    return df.withColumns({**four, **{c: rnd(c) for c in ("wape", "relative_bias", "interval_coverage")}})


@query("d43_forecast_metrics", with_views(BT, f" SELECT series_id, model, {_METRIC} FROM bt GROUP BY 1, 2"))
def _(spark, d):
    return _round_metrics(compare.forecast_metrics(backtest_rows(spark, d), ["series_id", "model"]))


@query("d44_mase", with_views(BT, f""", sc AS (SELECT series_id, avg(d) AS s FROM (SELECT series_id, abs(value - lag(value) OVER (PARTITION BY series_id ORDER BY idx)) AS d FROM ordw) GROUP BY 1)
  SELECT bt.series_id, model, {rsql('avg(abs(forecast - actual)) / any_value(s)')} AS mase FROM bt JOIN sc USING (series_id) GROUP BY 1, 2"""))
def _(spark, d):
    metrics = compare.forecast_metrics(backtest_rows(spark, d), ["series_id", "model"])
    scale = compare.naive_scale(order_weeks(spark, d), KEYS, "period_start", "value")
    return compare.with_mase(metrics, scale, KEYS).select("series_id", "model", rnd("mase").alias("mase"))


@query("d45_interval_quality", with_views(BT, f""" SELECT model, horizon_step, {rsql('avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END)')} AS interval_coverage,
  {rsql('avg(upper - lower)', 4)} AS mean_interval_width FROM bt GROUP BY 1, 2"""))
def _(spark, d):
    out = _round_metrics(compare.forecast_metrics(backtest_rows(spark, d), ["model", "horizon_step"]))
    return out.select("model", "horizon_step", "interval_coverage", "mean_interval_width")


_MON_SQL = """, mon AS (SELECT *, forecast - actual AS e, abs(forecast - actual) AS ae, CASE WHEN actual BETWEEN lower AND upper THEN 1 ELSE 0 END AS hit,
    row_number() OVER (PARTITION BY series_id, model ORDER BY origin, horizon_step) AS pos FROM bt)"""


@query("e4_monitoring_table", with_views(BT, _MON_SQL + f""" SELECT series_id, model, origin, horizon_step, {rsql('e', 8)} AS signed_error, {rsql('avg(ae) OVER w', 8)} AS rolling_mae,
  {rsql('avg(e) OVER w', 8)} AS rolling_bias, {rsql('sum(ae) OVER w / abs(sum(actual) OVER w)')} AS rolling_wape FROM mon
  WINDOW w AS (PARTITION BY series_id, model ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"""))
def _(spark, d):
    out = compare.monitoring_table(backtest_rows(spark, d), KEYS)
    return out.select("series_id", "model", "origin", "horizon_step", rnd("signed_error", 8).alias("signed_error"),
                      rnd("rolling_mae", 8).alias("rolling_mae"), rnd("rolling_bias", 8).alias("rolling_bias"), rnd("rolling_wape").alias("rolling_wape"))


@query("e6_error_columns", with_views(BT, _MON_SQL + f" SELECT series_id, model, origin, horizon_step, {rsql('ae', 8)} AS absolute_error, hit AS interval_hit, {rsql('upper - lower', 4)} AS interval_width FROM mon"))
def _(spark, d):
    out = compare.monitoring_table(backtest_rows(spark, d), KEYS)
    return out.select("series_id", "model", "origin", "horizon_step", rnd("absolute_error", 8).alias("absolute_error"), "interval_hit", rnd("interval_width", 4).alias("interval_width"))


_RUN_SQL = _MON_SQL + """, sg AS (SELECT *, CASE WHEN ae > avg(abs(actual)) OVER (PARTITION BY series_id, model) * 0.1 THEN sign(e) ELSE 0 END AS sg FROM mon),
  ch AS (SELECT *, CASE WHEN sg = lag(sg) OVER (PARTITION BY series_id, model ORDER BY pos) THEN 0 ELSE 1 END AS c FROM sg),
  il AS (SELECT *, sum(c) OVER (PARTITION BY series_id, model ORDER BY pos) AS island FROM ch),
  rn AS (SELECT series_id, model, sg, island, count(*) AS length, min(pos) AS f, arg_max(origin, pos) AS ends_at_origin, avg(e) AS me FROM il WHERE sg <> 0 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 4),
  br AS (SELECT series_id, model, CASE WHEN sg > 0 THEN 'over_forecasting' ELSE 'under_forecasting' END AS direction, length, ends_at_origin, me,
    row_number() OVER (PARTITION BY series_id, model, sg ORDER BY length DESC, f) AS r FROM rn)"""


@query("e5_bias_runs", with_views(BT, _RUN_SQL + f" SELECT series_id, model, direction, length, ends_at_origin, {rsql('me', 4)} AS mean_signed_error FROM br WHERE r = 1"))
def _(spark, d):
    return compare.bias_runs(compare.monitoring_table(backtest_rows(spark, d), KEYS), KEYS).withColumn("mean_signed_error", rnd("mean_signed_error", 4))


_FLAG_SQL = _RUN_SQL + """, fl AS (SELECT m.series_id, m.model, count(*) AS n, avg(e) AS me, avg(abs(actual)) * 0.1 AS mt, avg(hit) AS cov FROM mon m GROUP BY 1, 2),
  lr AS (SELECT series_id, model, max(length) AS l FROM br GROUP BY 1, 2),
  fg AS (SELECT fl.*, coalesce(l, 0) AS longest, n >= 12 AS suff, CASE WHEN n >= 12 THEN l IS NOT NULL END AS pb,
    CASE WHEN n < 12 THEN 'insufficient evidence' WHEN abs(cov - 0.8) <= 0.1 THEN 'close to nominal' WHEN cov < 0.8 THEN 'too narrow (overconfident)' ELSE 'too wide (underconfident)' END AS words
    FROM fl LEFT JOIN lr USING (series_id, model))"""


@query("d50_bias_flags", with_views(BT, _FLAG_SQL + f""" SELECT series_id, model, n AS n_forecasts, {rsql('me', 4)} AS mean_signed_error, {rsql('mt', 4)} AS materiality_threshold, {rsql('cov')} AS interval_coverage,
  longest AS longest_bias_run, suff AS sufficient_evidence, pb AS persistent_bias, {rsql('cov - 0.8')} AS coverage_gap_vs_nominal, words AS interval_calibration FROM fg"""))
def _(spark, d):
    out = compare.bias_flags(compare.monitoring_table(backtest_rows(spark, d), KEYS), KEYS)
    return out.withColumns({"mean_signed_error": rnd("mean_signed_error", 4), "materiality_threshold": rnd("materiality_threshold", 4),
                            "interval_coverage": rnd("interval_coverage"), "coverage_gap_vs_nominal": rnd("coverage_gap_vs_nominal")})


@query("i21_coverage_wording", with_views(BT, _FLAG_SQL + " SELECT series_id, model, words AS interval_calibration FROM fg"))
def _(spark, d):
    return compare.bias_flags(compare.monitoring_table(backtest_rows(spark, d), KEYS), KEYS).select("series_id", "model", "interval_calibration")


_CMP_SQL = _FLAG_SQL + f""", cm AS (SELECT series_id, model, {_METRIC}, count(DISTINCT origin) AS origins,
  CASE model WHEN 'seasonal_naive' THEN 2 ELSE 1 END AS complexity FROM bt GROUP BY 1, 2)"""


@query("d46_comparison_table", with_views(BT, _CMP_SQL + """ SELECT cm.*, pb::VARCHAR AS persistent_bias, words AS interval_calibration, fg.n AS bias_evidence_forecasts FROM cm JOIN fg USING (series_id, model)"""))
def _(spark, d):
    bt = backtest_rows(spark, d)
    flags = compare.bias_flags(compare.monitoring_table(bt, KEYS), KEYS)
    return _round_metrics(compare.comparison_table(bt, flags, KEYS))


@query("f10_model_selection", with_views(BT, _CMP_SQL + """, j AS (SELECT cm.series_id, cm.model, cm.wape, cm.mae, cm.complexity,
    CASE WHEN suff AND NOT (pb OR abs(cov - 0.8) > 0.25) THEN 0 WHEN suff THEN 1 ELSE 2 END AS tier FROM cm JOIN fg USING (series_id, model))
  SELECT series_id, arg_min(model, (tier, wape, mae, complexity, model)) AS selected, arg_min(model, (wape, mae, complexity, model)) AS leader, min(tier) AS tier FROM j GROUP BY 1"""))
def _(spark, d):
    bt = backtest_rows(spark, d)
    flags = compare.bias_flags(compare.monitoring_table(bt, KEYS), KEYS)
    return compare.select_model(compare.comparison_table(bt, flags, KEYS), flags, KEYS).drop("reasoning")


@query("a15_forecast_summary", with_views(BT, _CMP_SQL + """, j AS (SELECT cm.series_id, cm.model, cm.wape, cm.mae, cm.complexity, cm.n, suff, pb,
    CASE WHEN suff AND NOT (pb OR abs(cov - 0.8) > 0.25) THEN 0 WHEN suff THEN 1 ELSE 2 END AS tier FROM cm JOIN fg USING (series_id, model))
  SELECT series_id, count(*) AS models, arg_min(model, (tier, wape, mae, complexity, model)) AS selected, string_agg(model, ',' ORDER BY model) AS names, CAST(sum(n) AS BIGINT) AS forecasts FROM j GROUP BY 1"""))
def _(spark, d):
    bt = backtest_rows(spark, d)
    flags = compare.bias_flags(compare.monitoring_table(bt, KEYS), KEYS)
    chosen = compare.select_model(compare.comparison_table(bt, flags, KEYS), flags, KEYS)
    doc = compare.forecast_summary(bt, flags, chosen, KEYS)
    parsed = doc.withColumn("p", F.from_json("document", "struct<selected:string,models:array<struct<model:string,n:bigint>>>"))
    return parsed.select("series_id", F.size("p.models").cast("bigint").alias("models"), F.col("p.selected").alias("selected"),
                         F.array_join("p.models.model", ",").alias("names"),
                         F.aggregate("p.models.n", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("forecasts"))


_PO_SQL = """, po AS (SELECT series_id, origin, model, count(*) AS n, sum(abs(actual)) AS a, sum(abs(actual - forecast)) AS s FROM mt GROUP BY 1, 2, 3)"""
#: Origins of seasonal naive, which has the shortest history to score on.
_MT_SQL = """, mt AS (SELECT * FROM bt WHERE (series_id, origin) IN (SELECT series_id, origin FROM bt WHERE model = 'seasonal_naive'))"""


@query("c15_matched_origins", with_views(BT, _MT_SQL + " SELECT series_id, model, origin, horizon_step FROM mt"))
def _(spark, d):
    return compare.matched_origins(backtest_rows(spark, d), "seasonal_naive", KEYS).select("series_id", "model", "origin", "horizon_step")


@query("d47_per_origin_wape", with_views(BT, _MT_SQL + _PO_SQL + f" SELECT series_id, origin, model, n, {rsql('a', 4)} AS actual_sum, {rsql('s', 8)} AS abs_error_sum, {rsql('s / a')} AS wape FROM po"))
def _(spark, d):
    out = compare.per_origin_errors(compare.matched_origins(backtest_rows(spark, d), "seasonal_naive", KEYS), KEYS)
    return out.withColumns({"actual_sum": rnd("actual_sum", 4), "abs_error_sum": rnd("abs_error_sum", 8), "wape": rnd("wape")})


_LOO_SQL = _MT_SQL + _PO_SQL + """, lo AS (SELECT o.series_id, o.origin AS dropped_origin, p.model, sum(s) / sum(a) AS wape FROM (SELECT DISTINCT series_id, origin FROM po) o
    JOIN po p ON p.series_id = o.series_id AND p.origin <> o.origin GROUP BY 1, 2, 3),
  ll AS (SELECT *, first_value(model) OVER (PARTITION BY series_id, dropped_origin ORDER BY wape, model) AS leader FROM lo)"""


@query("d48_leave_one_origin_out", with_views(BT, _LOO_SQL + f" SELECT series_id, dropped_origin, model, {rsql('wape')} AS wape, leader FROM ll"))
def _(spark, d):
    table = compare.per_origin_errors(compare.matched_origins(backtest_rows(spark, d), "seasonal_naive", KEYS), KEYS)
    return compare.leave_one_origin_out(table, KEYS).withColumn("wape", rnd("wape"))


@query("d49_ranking_sensitivity", with_views(BT, _LOO_SQL + f""", ov AS (SELECT series_id, model, sum(n) AS n, sum(s) / sum(a) AS w, row_number() OVER (PARTITION BY series_id ORDER BY sum(s) / sum(a), model) AS r FROM po GROUP BY 1, 2),
  ld AS (SELECT series_id, CAST(min(n) AS BIGINT) AS n, max(model) FILTER (r = 1) AS leader, max(model) FILTER (r = 2) AS runner_up FROM ov GROUP BY 1),
  cl AS (SELECT *, CASE WHEN leader <> 'seasonal_naive' THEN 'seasonal_naive' ELSE runner_up END AS ch FROM ld),
  gp AS (SELECT po.series_id, origin, sum(CASE WHEN model = ch THEN s WHEN model = leader THEN -s ELSE 0 END) AS g FROM po JOIN cl USING (series_id) GROUP BY 1, 2),
  dm AS (SELECT series_id, count(*) AS k, sum(g) AS t, max(g) AS mx, arg_max(origin, g) AS o FROM gp GROUP BY 1),
  st AS (SELECT ll.series_id, bool_and(ll.leader = cl.leader) AS stable FROM ll JOIN cl USING (series_id) GROUP BY 1)
  SELECT series_id, n AS n_forecasts_per_model, k AS n_origins, leader, runner_up, ch AS gap_compared_against, stable AS leader_stable_under_leave_one_out,
    o AS dominant_origin, {rsql('mx / t')} AS dominant_origin_gap_share, n < 12 OR NOT stable OR mx / t > 0.5 AS fragile FROM cl JOIN dm USING (series_id) JOIN st USING (series_id)"""))
def _(spark, d):
    out = compare.ranking_sensitivity(backtest_rows(spark, d), "seasonal_naive", KEYS)
    return out.withColumn("dominant_origin_gap_share", rnd("dominant_origin_gap_share"))


@query("f9_leader_runner_up", with_views(BT, f""", w AS (SELECT series_id, model, sum(abs(forecast - actual)) / sum(actual) AS w, avg(upper - lower) AS width FROM bt GROUP BY 1, 2)
  SELECT series_id, arg_min(model, w) AS leader, arg_min(model, w) FILTER (r = 2) AS runner_up, arg_max(model, width) AS widest
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY w) AS r FROM w) GROUP BY 1"""))
def _(spark, d):
    metrics = compare.forecast_metrics(backtest_rows(spark, d), ["series_id", "model"])
    # One struct per model.
    ranked = F.array_sort(F.collect_list(F.struct("wape", "model")))
    return metrics.groupBy("series_id").agg(ranked.alias("r"), F.max_by("model", "mean_interval_width").alias("widest")).select(
        "series_id", F.get("r", F.lit(0)).getField("model").alias("leader"), F.get("r", F.lit(1)).getField("model").alias("runner_up"), "widest")


@query("d36_seeds_summary", with_views(BT, f""", o AS (SELECT model, origin, sum(abs(forecast - actual)) / sum(actual) AS wape FROM bt GROUP BY 1, 2)
  SELECT model, count(*) AS n_seeds, {rsql('avg(wape)')} AS wape_mean, {rsql('CASE WHEN count(*) > 1 THEN stddev_samp(wape) ELSE 0 END')} AS wape_std, {rsql('median(wape)')} AS wape_median FROM o GROUP BY 1"""))
def _(spark, d):
    per = compare.per_origin_errors(backtest_rows(spark, d))
    out = evaluation.seeds_summary(per, ["model"], ["wape"])
    return out.withColumns({c: rnd(c) for c in ("wape_mean", "wape_std", "wape_median")})


@query("d63_best_model", with_views(BT, f""", o AS (SELECT model, origin, -sum(abs(forecast - actual)) / sum(actual) AS s FROM bt GROUP BY 1, 2)
  SELECT model, {rsql('avg(s)')} AS mean_metric FROM o GROUP BY 1 ORDER BY avg(s) DESC, model LIMIT 1"""))
def _(spark, d):
    per = compare.per_origin_errors(backtest_rows(spark, d)).withColumn("score", -F.col("wape"))
    return agreement.best_model(per, "model", "score").withColumn("mean_metric", rnd("mean_metric"))


@query("k12_target_run", with_views("ordw", f""", lg AS (SELECT series_id, 'total_comments' AS target, idx, total_comments::DOUBLE AS v FROM ordw UNION ALL SELECT series_id, 'value', idx, value FROM ordw),
  st AS (SELECT *, idx + 1 AS origin, count(*) OVER (PARTITION BY series_id, target) AS n, avg(v) OVER (PARTITION BY series_id, target ORDER BY idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS m8 FROM lg),
  og AS (SELECT * FROM st WHERE origin >= 12 AND (origin - 12) % 2 = 0 AND origin + 2 <= n),
  r AS (SELECT series_id, target, 'naive' AS model, origin, h, v AS f FROM og, (VALUES (1), (2)) s(h) UNION ALL SELECT series_id, target, 'mean', origin, h, m8 FROM og, (VALUES (1), (2)) s(h))
  SELECT r.series_id, r.target, model, count(*) AS n, {rsql('sum(abs(f - l.v)) / sum(l.v)')} AS wape FROM r JOIN lg l ON l.series_id = r.series_id AND l.target = r.target AND l.idx = origin + h - 1 GROUP BY 1, 2, 3"""))
def _(spark, d):
    out = plan.run_targets(order_weeks(spark, d), ["total_comments", "value"], KEYS, models=("naive", "mean"))
    return out["comparison"].select("series_id", "target", "model", "n", rnd("wape").alias("wape"))


@query("k13_experiment")
def _(spark, d):
    weeks = order_weeks(spark, d)
    written = plan.run_experiment(
        weeks, work_path(spark, "experiment"), ("total_comments", "actionable_count"), series_cols=KEYS,
        models=("naive", "mean", "seasonal_naive", "exponential_smoothing"), min_train=60, reference_model="exponential_smoothing")
    return spark.read.parquet(written["selection"]).select("series_id", "target", "selected", "leader", "tier")


@query("a17_experiment_outputs")
def _(spark, d):
    weeks = order_weeks(spark, d)
    written = plan.run_experiment(weeks, work_path(spark, "experiment"), ("total_comments",), series_cols=KEYS, models=("naive", "mean"))
    counts = [spark.read.parquet(p).groupBy("target").agg(F.count("*").alias("rows")).withColumn("table", F.lit(n)) for n, p in written.items()]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out
