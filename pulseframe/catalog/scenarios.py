"""Draw scenarios over event series and media plans over lineitem weeks (A13, B17, C19, C20, D51-D53, D56-D61, E9, E10, I19, I20, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.base import order_weeks, query, rnd, rsql, table, with_views
from pulseframe.functions import scoring
from pulseframe.operators import draws as dr
from pulseframe.operators import media as md
from pulseframe.session import work_path

CHANNELS = ["a_spend", "n_spend", "r_spend"]

# --- draws: each order week of a priority is one draw, its four quarters of the cycle are the steps -------------

_DR = """, dr AS (SELECT series_id, idx // 4 AS draw, idx % 4 + 1 AS step, value FROM ordw)"""


def draws(spark, d):
    w = order_weeks(spark, d)
    return w.select("series_id", F.floor(F.col("idx") / 4).alias("draw"), (F.col("idx") % 4 + 1).alias("step"), "value")


_SCEN = dr.BehaviouralScenario(level_shift=1.2, event_pulse=1.5, pulse_periods=2, trajectory=1.05)
_MULT = "1.2 * pow(1.05, step - 1) * CASE WHEN step <= 2 THEN 1.5 ELSE 1.0 END"
_SC_SQL = _DR + f", sc AS (SELECT series_id, draw, step, value AS b, value * {_MULT} AS s, value * {_MULT} - value AS f FROM dr)"


@query("a13_thinned_draws", with_views("ordw", _DR + " SELECT series_id, draw, CAST(step AS INTEGER) AS step FROM dr WHERE draw % 5 = 0"))
def _(spark, d):
    path = work_path(spark, "draws")
    dr.write_thinned(draws(spark, d), path, "run-1", total=87, max_draws=20)
    return dr.read_thinned(spark, path, "run-1").select("series_id", "draw", F.col("step").cast("int").alias("step"))


@query("i20_scenario_multiplier", with_views("ordw", _DR + f" SELECT DISTINCT CAST(step AS INTEGER) AS step, {rsql(_MULT)} AS multiplier FROM dr"))
def _(spark, d):
    m = scoring.scenario_multiplier(F.col("step"), 1.2, 1.05, 1.5, 2)
    return draws(spark, d).select(F.col("step").cast("int").alias("step"), rnd(m).alias("multiplier")).distinct()


@query("c19_draw_scenarios", with_views("ordw", _SC_SQL + f" SELECT series_id, draw, CAST(step AS INTEGER) AS step, {rsql('s', 8)} AS scenario, {rsql('f', 8)} AS difference FROM sc"))
def _(spark, d):
    out = dr.with_scenario(draws(spark, d), _SCEN)
    return out.select("series_id", "draw", F.col("step").cast("int").alias("step"), rnd("scenario", 8).alias("scenario"), rnd("difference", 8).alias("difference"))


@query("d51_draw_summaries", with_views("ordw", _DR + f" SELECT series_id, CAST(step AS INTEGER) AS step, {rsql('avg(value)')} AS mean, {rsql('quantile_cont(value, 0.1)')} AS lower, {rsql('quantile_cont(value, 0.9)')} AS upper FROM dr GROUP BY 1, 2"))
def _(spark, d):
    out = dr.summarise_draws(draws(spark, d), ["series_id", "step"])
    return out.select("series_id", F.col("step").cast("int").alias("step"), *[rnd(c).alias(c) for c in ("mean", "lower", "upper")])


@query("d56_effect_summary", with_views("ordw", _DR + f" SELECT series_id AS param, {rsql('avg(value)')} AS mean, {rsql('quantile_cont(value, 0.05)')} AS lower, {rsql('quantile_cont(value, 0.95)')} AS upper FROM dr GROUP BY 1"))
def _(spark, d):
    out = dr.summarise_draws(draws(spark, d).withColumnRenamed("series_id", "param"), ["param"], level=0.9)
    return out.select("param", *[rnd(c).alias(c) for c in ("mean", "lower", "upper")])


_PPC = _DR + """, ob AS (SELECT CAST(step AS INTEGER) AS step, max(value) AS observed FROM dr GROUP BY 1), bd AS (SELECT step, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM dr GROUP BY 1),
  pc AS (SELECT (SELECT avg(observed) FROM ob) AS observed_mean, (SELECT stddev_pop(observed) FROM ob) AS observed_std, (SELECT avg(value) FROM dr) AS predicted_mean, (SELECT stddev_pop(value) FROM dr) AS predicted_std,
    (SELECT avg(CASE WHEN observed BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) FROM ob JOIN bd USING (step)) AS coverage, (SELECT avg(CASE WHEN value <= 0 THEN 1.0 ELSE 0.0 END) FROM dr) AS pz)"""


def _check(spark, d):
    rows = draws(spark, d)
    observed = rows.groupBy("step").agg(F.max("value").alias("observed"))
    return dr.predictive_check(observed, rows)


@query("d52_predictive_check", with_views("ordw", _PPC + f" SELECT {rsql('observed_mean')} AS observed_mean, {rsql('observed_std')} AS observed_std, {rsql('predicted_mean')} AS predicted_mean, {rsql('predicted_std')} AS predicted_std, {rsql('coverage')} AS ppc_interval_coverage, {rsql('pz')} AS predicted_zero_share FROM pc"))
def _(spark, d):
    out = _check(spark, d)
    return out.select(*[rnd(c).alias(c) for c in ("observed_mean", "observed_std", "predicted_mean", "predicted_std", "ppc_interval_coverage", "predicted_zero_share")])


@query("d53_dispersion_notes", with_views("ordw", _PPC + f" SELECT {rsql('predicted_std / observed_std')} AS dispersion_ratio, CASE WHEN predicted_std / observed_std > 1.5 THEN 'more_variable_than_data' WHEN predicted_std / observed_std < 0.7 THEN 'less_variable_than_data' ELSE '' END AS notes FROM pc"))
def _(spark, d):
    out = dr.dispersion_notes(_check(spark, d))
    return out.select(rnd("dispersion_ratio").alias("dispersion_ratio"), F.array_join("notes", ",").alias("notes"))


_STEP_COLS = [f"{n}_{p}" for n in ("baseline", "scenario", "difference") for p in ("mean", "lower", "upper")]
_STEP_SQL = ", ".join(
    f"{rsql(e, 9)} AS {n}_{p}" for n, v in (("baseline", "b"), ("scenario", "s"), ("difference", "f"))
    for p, e in (("mean", f"avg({v})"), ("lower", f"quantile_cont({v}, 0.1)"), ("upper", f"quantile_cont({v}, 0.9)")))


@query("l1_scenario_by_step", with_views("ordw", _SC_SQL + f" SELECT series_id, CAST(step AS INTEGER) AS step, {_STEP_SQL} FROM sc GROUP BY 1, 2"))
def _(spark, d):
    out = dr.scenario_by_step(draws(spark, d), _SCEN, ["series_id"])
    return out.select("series_id", F.col("step").cast("int").alias("step"), *[rnd(c, 9).alias(c) for c in _STEP_COLS])


@query("l1_scenario_total", with_views("ordw", _SC_SQL + f""", tt AS (SELECT series_id, draw, sum(b) AS b, sum(s) AS s, sum(f) AS f FROM sc GROUP BY 1, 2)
  SELECT series_id, {rsql('avg(b)', 9)} AS total_baseline, {rsql('avg(s)', 9)} AS total_scenario, {rsql('avg(f)', 9)} AS total_difference_mean, {rsql('quantile_cont(f, 0.1)', 9)} AS total_difference_lower, {rsql('quantile_cont(f, 0.9)', 9)} AS total_difference_upper FROM tt GROUP BY 1"""))
def _(spark, d):
    out = dr.scenario_total(draws(spark, d), _SCEN, ["series_id"])
    return out.select("series_id", *[rnd(c, 9).alias(c) for c in out.columns if c != "series_id"])


@query("l2_guardrails", with_views("ordw", _SC_SQL + f""", pk AS (SELECT series_id, max(m) AS scenario_peak FROM (SELECT series_id, step, avg(s) AS m FROM sc GROUP BY 1, 2) GROUP BY 1), mx AS (SELECT series_id, max(value) / 2 AS observed_max FROM dr GROUP BY 1)
  SELECT series_id, {rsql('scenario_peak', 5)} AS scenario_peak, {rsql('observed_max', 5)} AS observed_max, CASE WHEN scenario_peak > observed_max * 1.5 THEN 'peak exceeds the observed range' ELSE '' END AS warnings FROM pk JOIN mx USING (series_id)"""))
def _(spark, d):
    rows = draws(spark, d)
    observed = rows.groupBy("series_id").agg((F.max("value") / 2).alias("observed"))
    out = dr.guardrails(dr.scenario_by_step(rows, _SCEN, ["series_id"]), observed, _SCEN, ["series_id"])
    return out.select("series_id", rnd("scenario_peak", 5).alias("scenario_peak"), rnd("observed_max", 5).alias("observed_max"), F.array_join("warnings", ",").alias("warnings"))


# --- media plan: weekly price by return flag ------------------------------------------------------------------------

_LI = """WITH pl AS (SELECT date_trunc('week', l_shipdate) AS week, coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'A'), 0) / 1000 AS a_spend,
    coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'N'), 0) / 1000 AS n_spend, coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0) / 1000 AS r_spend,
    avg(l_extendedprice / l_quantity) AS price, CASE WHEN avg(l_discount) > 0.05 THEN 1.0 ELSE 0.0 END AS promotion FROM lineitem GROUP BY 1),
  pn AS (SELECT row_number() OVER (ORDER BY week) - 1 AS t, a_spend, n_spend, r_spend, price, promotion, CASE WHEN month(week) = 11 THEN 1.0 ELSE 0.0 END AS event FROM pl),
  lg AS (SELECT t, 'a_spend' AS channel, a_spend AS spend FROM pn UNION ALL SELECT t, 'n_spend', n_spend FROM pn UNION ALL SELECT t, 'r_spend', r_spend FROM pn),
  sc AS (SELECT channel, avg(spend) AS spend_scale FROM lg GROUP BY 1),
  st AS (SELECT s_suppkey AS draw, channel, CASE channel WHEN 'a_spend' THEN 0.2 WHEN 'n_spend' THEN 0.4 ELSE 0.6 END + (s_suppkey % 7) * 0.01 AS decay, 1.2 + (s_suppkey % 5) * 0.05 AS alpha,
    0.8 + (s_suppkey % 3) * 0.1 AS theta, CASE channel WHEN 'a_spend' THEN 30.0 WHEN 'n_spend' THEN 50.0 ELSE 20.0 END + s_suppkey % 11 AS beta FROM supplier, (VALUES ('a_spend'), ('n_spend'), ('r_spend')) c(channel))"""


def plan(spark, d):
    li = table(spark, d, "lineitem")
    week = F.date_trunc("week", F.col("l_shipdate").cast("timestamp"))
    spend = lambda flag: F.coalesce(F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_extendedprice"))), F.lit(0.0)) / 1000
    weekly = li.groupBy(week.alias("week")).agg(
        spend("A").alias("a_spend"), spend("N").alias("n_spend"), spend("R").alias("r_spend"),
        F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.when(F.avg("l_discount") > 0.05, 1.0).otherwise(0.0).alias("promotion"))
    from pyspark.sql import Window  # one row per week
    numbered = weekly.withColumn("t", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("week")) - 1)
    return numbered.withColumn("event", F.when(F.month("week") == 11, 1.0).otherwise(0.0)).drop("week")


def media_draws(spark, d):
    """One draw per supplier: parameters are fixed functions of the supplier key."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("draw"))
    rows = s.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in CHANNELS])))
    ch, k = F.col("channel"), F.col("draw")
    base = lambda a, n, r: F.when(ch == "a_spend", a).when(ch == "n_spend", n).otherwise(r)
    return rows.select("draw", "channel", (base(0.2, 0.4, 0.6) + (k % 7) * 0.01).alias("decay"), (F.lit(1.2) + (k % 5) * 0.05).alias("alpha"),
                       (F.lit(0.8) + (k % 3) * 0.1).alias("theta"), (base(30.0, 50.0, 20.0) + k % 11).alias("beta"))


def scales(p):
    return md.plan_long(p, ["t"], CHANNELS).groupBy("channel").agg(F.avg("spend").alias("spend_scale"))


@query("b17_data_type_guard", _LI + " SELECT count(*) AS weeks FROM pn")
def _(spark, d):
    return md.require_data_type(plan(spark, d).withColumn("data_type", F.lit("synthetic"))).agg(F.count("*").alias("weeks"))


_ADS = """, ad AS (SELECT a.channel, a.t, sum(b.spend * pow(0.5, a.t - b.t)) AS adstock FROM lg a JOIN lg b ON a.channel = b.channel AND b.t <= a.t GROUP BY 1, 2)"""


@query("e9_adstock", _LI + _ADS + f" SELECT t, {rsql('adstock', 4)} AS adstock FROM ad WHERE channel = 'a_spend'")
def _(spark, d):
    one = plan(spark, d).select("t", F.col("a_spend").alias("spend"), F.lit("a_spend").alias("channel"))
    return md.adstock(one, ["channel"], "t", F.lit(0.5)).select("t", rnd("adstock", 4).alias("adstock"))


@query("e10_channel_adstock", _LI + _ADS + f" SELECT channel, t, {rsql('adstock', 4)} AS adstock FROM ad")
def _(spark, d):
    return md.adstock(md.plan_long(plan(spark, d), ["t"], CHANNELS), ["channel"], "t", F.lit(0.5)).select("channel", "t", rnd("adstock", 4).alias("adstock"))


@query("i19_media_response", _LI + _ADS + f" SELECT channel, t, {rsql('pow(adstock * 0.5, 1.3) / (pow(adstock * 0.5, 1.3) + pow(2000.0, 1.3))')} AS response FROM ad")
def _(spark, d):
    out = md.response(md.plan_long(plan(spark, d), ["t"], CHANNELS), ["channel"], "t", F.lit(0.5), F.lit(1.3), F.lit(2000.0))
    return out.select("channel", "t", rnd("response").alias("response"))


@query("d58_training_ranges", _LI + f", rg AS (SELECT channel AS name, spend AS v FROM lg UNION ALL SELECT 'price', price FROM pn) SELECT name, {rsql('min(v)', 4)} AS min, {rsql('max(v)', 4)} AS max, {rsql('avg(v)', 4)} AS mean FROM rg GROUP BY 1")
def _(spark, d):
    out = md.training_ranges(plan(spark, d), [*CHANNELS, "price"])
    return out.select("name", *[rnd(c, 4).alias(c) for c in ("min", "max", "mean")])


@query("d60_rank_correlation", """WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS b FROM part) SELECT p_brand, """ + rsql("corr(a, b)") + " AS rank_correlation FROM r GROUP BY 1")
def _(spark, d):
    return md.rank_correlation(table(spark, d, "part"), "p_size", "p_retailprice", ["p_brand"]).withColumn("rank_correlation", rnd("rank_correlation"))


_EDIT = md.PlanScenario(budget_changes={"a_spend": 1.5}, reallocations=(("n_spend", "r_spend", 0.2),), price_change=-100.0, promotion=True)
_EDIT_SQL = ", ed AS (SELECT t, a_spend * 1.5 AS a_spend, n_spend * 0.8 AS n_spend, r_spend + n_spend * 0.2 AS r_spend, greatest(price - 100, 0.01) AS price, 1.0 AS promotion, event FROM pn)"


@query("l4_plan_edit", _LI + _EDIT_SQL + f" SELECT t, {rsql('a_spend', 7)} AS a_spend, {rsql('n_spend', 7)} AS n_spend, {rsql('r_spend', 7)} AS r_spend, {rsql('price', 7)} AS price, promotion::DOUBLE AS promotion FROM ed")
def _(spark, d):
    out = md.apply_scenario(plan(spark, d), _EDIT, CHANNELS)
    return out.select("t", *[rnd(c, 7).alias(c) for c in (*CHANNELS, "price")], "promotion")


@query("l10_reallocation", _LI + f" SELECT t, {rsql('n_spend * 0.75', 7)} AS n_spend, {rsql('r_spend + n_spend * 0.25', 7)} AS r_spend FROM pn")
def _(spark, d):
    out = md.apply_scenario(plan(spark, d), md.reallocation("n_spend", "r_spend", 0.25), CHANNELS)
    return out.select("t", rnd("n_spend", 7).alias("n_spend"), rnd("r_spend", 7).alias("r_spend"))


@query("l8_plan_warnings", _LI + _EDIT_SQL + """, w AS (SELECT 'a_spend' AS name, max(e.a_spend) > max(p.a_spend) * 1.25 AS f FROM ed e JOIN pn p USING (t) UNION ALL SELECT 'n_spend', max(e.n_spend) > max(p.n_spend) * 1.25 FROM ed e JOIN pn p USING (t)
    UNION ALL SELECT 'r_spend', max(e.r_spend) > max(p.r_spend) * 1.25 FROM ed e JOIN pn p USING (t)) SELECT name, 'spend beyond the training range' AS warning FROM w WHERE f
    UNION ALL SELECT 'price', 'price outside the observed range' FROM ed HAVING avg(price) < (SELECT min(price) FROM pn) * 0.8 OR avg(price) > (SELECT max(price) FROM pn) * 1.2""")
def _(spark, d):
    base = plan(spark, d)
    return md.plan_warnings(md.apply_scenario(base, _EDIT, CHANNELS), md.training_ranges(base, [*CHANNELS, "price"]), CHANNELS).select("name", "warning")


def _media_sql(source: str, tag: str) -> str:
    """Media effect of a plan by expanding the carry-over as a weighted sum."""
    return f""", lg{tag} AS (SELECT t, 'a_spend' AS channel, a_spend AS spend FROM {source} UNION ALL SELECT t, 'n_spend', n_spend FROM {source} UNION ALL SELECT t, 'r_spend', r_spend FROM {source}),
  dc{tag} AS (SELECT DISTINCT channel, decay FROM st),
  ad{tag} AS (SELECT d.channel, d.decay, a.t, sum(b.spend / spend_scale * pow(d.decay, a.t - b.t)) * (1 - d.decay) AS x FROM dc{tag} d JOIN sc USING (channel) JOIN lg{tag} a ON a.channel = d.channel JOIN lg{tag} b ON b.channel = d.channel AND b.t <= a.t GROUP BY 1, 2, 3),
  me{tag} AS (SELECT draw, st.channel, t, beta * pow(x, alpha) / (pow(x, alpha) + pow(theta, alpha)) AS effect FROM st JOIN ad{tag} a ON a.channel = st.channel AND a.decay = st.decay)"""


@query("l6_channel_contributions", _LI + _media_sql("pn", "0") + f" SELECT channel, {rsql('avg(s)', 3)} AS contribution_mean FROM (SELECT draw, channel, sum(effect) AS s FROM me0 GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    p = plan(spark, d)
    return md.channel_contributions(md.media_by_draw(p, CHANNELS, media_draws(spark, d), scales(p))).withColumn("contribution_mean", rnd("contribution_mean", 3))


_CON = _media_sql("pn", "0") + """, cn AS (SELECT channel, avg(s) AS cm, quantile_cont(s, 0.05) AS c5, quantile_cont(s, 0.95) AS c95 FROM (SELECT draw, channel, sum(effect) AS s FROM me0 GROUP BY 1, 2) GROUP BY 1)"""


@query("d57_contribution_table", _LI + _CON + f", tt AS (SELECT sum(a_spend) AS s FROM pn) SELECT channel, {rsql('cm', 3)} AS contribution_mean, {rsql('c5', 3)} AS contribution_hdi_5, {rsql('c95', 3)} AS contribution_hdi_95, {rsql('cm / s')} AS contribution_share_mean FROM cn, tt")
def _(spark, d):
    p = plan(spark, d)
    total = p.agg(F.sum("a_spend")).scalar()
    out = md.contribution_table(md.media_by_draw(p, CHANNELS, media_draws(spark, d), scales(p)), total)
    return out.select("channel", *[rnd(c, 3).alias(c) for c in ("contribution_mean", "contribution_hdi_5", "contribution_hdi_95")], rnd("contribution_share_mean").alias("contribution_share_mean"))


_TRUE = ", tr AS (SELECT * FROM (VALUES ('a_spend', 5000.0), ('n_spend', 9000.0), ('r_spend', 3700.0)) v(channel, tc))"


def _matched(spark, d, p, draws_):
    truth = spark.createDataFrame([("a_spend", 5000.0), ("n_spend", 9000.0), ("r_spend", 3700.0)], "channel string, true_contribution double")
    return md.true_vs_estimated(md.contribution_table(md.media_by_draw(p, CHANNELS, draws_, scales(p)), F.lit(1.0)), truth)


@query("c20_true_vs_estimated", _LI + _CON + _TRUE + f" SELECT channel, {rsql('cm', 3)} AS contribution_mean, tc::DOUBLE AS true_contribution, tc BETWEEN c5 AND c95 AS in_interval FROM cn JOIN tr USING (channel)")
def _(spark, d):
    out = _matched(spark, d, plan(spark, d), media_draws(spark, d))
    return out.select("channel", rnd("contribution_mean", 3).alias("contribution_mean"), "true_contribution", "in_interval")


@query("d61_attribution", _LI + _CON + _TRUE + f" SELECT arg_max(channel, c95 - c5) AS widest_channel, {rsql('max(c95 - c5)', 3)} AS width, sum(cm) < sum(tc) * 0.85 AS under_attributed FROM cn JOIN tr USING (channel)")
def _(spark, d):
    return md.attribution(_matched(spark, d, plan(spark, d), media_draws(spark, d))).withColumn("width", rnd("width", 3))


_EFF = ", ef AS (SELECT s_suppkey AS draw, 10.0 + s_suppkey % 3 AS baseline, 2.0 AS trend, -0.01 - (s_suppkey % 4) * 0.001 AS pc, 5.0 AS pr, 3.0 AS evc, 1.5 AS ss, 0.5 AS sc2 FROM supplier)"
_CONST = {"sales_mean": 100.0, "week_mean": 170.0, "week_scale": 170.0, "price_mean": 1500.0}


def _effects(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        k.alias("draw"), (F.lit(10.0) + k % 3).alias("baseline"), F.lit(2.0).alias("trend"), (F.lit(-0.01) - (k % 4) * 0.001).alias("price_coefficient"),
        F.lit(5.0).alias("promotion_coefficient"), F.lit(3.0).alias("event_coefficient"), F.lit(1.5).alias("season_sin"), F.lit(0.5).alias("season_cos"))


def _out_sql(source, tag):
    return f""", ex{tag} AS (SELECT m.draw, t, 100.0 + baseline + trend * (t - 170) / 170.0 + m.media + pc * (price - 1500) + pr * promotion + evc * event + ss * sin(2 * pi() * t / 52.0) + sc2 * cos(2 * pi() * t / 52.0) AS e
    FROM (SELECT draw, t, sum(effect) AS media FROM me{tag} GROUP BY 1, 2) m JOIN {source} USING (t) JOIN ef ON ef.draw = m.draw)"""


def _outcome(spark, d, p, base):
    media = md.media_by_draw(p, CHANNELS, media_draws(spark, d), scales(base))
    return md.expected_outcome(p, media, _effects(spark, d), _CONST)


@query("l5_expected_outcome", _LI + _media_sql("pn", "0") + _EFF + _out_sql("pn", "0") + f" SELECT t, {rsql('avg(e)', 4)} AS expected FROM ex0 GROUP BY 1")
def _(spark, d):
    p = plan(spark, d)
    return _outcome(spark, d, p, p).groupBy("t").agg(rnd(F.avg("expected"), 4).alias("expected"))


@query("l7_scenario_comparison", _LI + _EDIT_SQL + _media_sql("pn", "0") + _media_sql("ed", "1") + _EFF + _out_sql("pn", "0") + _out_sql("ed", "1") + f""", bb AS (SELECT draw, sum(e) AS b FROM ex0 GROUP BY 1), oo AS (SELECT draw, sum(e) AS o FROM ex1 GROUP BY 1), df AS (SELECT b, o, o - b AS d FROM bb JOIN oo USING (draw))
  SELECT {rsql('avg(b)', 3)} AS baseline_expected, {rsql('avg(o)', 3)} AS scenario_expected, {rsql('avg(d)', 3)} AS difference_mean, {rsql('quantile_cont(d, 0.05)', 3)} AS difference_lower, {rsql('quantile_cont(d, 0.95)', 3)} AS difference_upper,
  {rsql('avg(d) / avg(b) * 100')} AS difference_percent, {rsql('avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END)')} AS probability_of_increase FROM df""")
def _(spark, d):
    p = plan(spark, d)
    out = md.compare_outcomes(_outcome(spark, d, p, p), _outcome(spark, d, md.apply_scenario(p, _EDIT, CHANNELS), p))
    return out.select(*[rnd(c, 3).alias(c) for c in ("baseline_expected", "scenario_expected", "difference_mean", "difference_lower", "difference_upper")],
                      rnd("difference_percent").alias("difference_percent"), rnd("probability_of_increase").alias("probability_of_increase"))


@query("l7_spend_change", _LI + _EDIT_SQL + f" SELECT {rsql('(SELECT sum(a_spend + n_spend + r_spend) FROM pn)', 3)} AS baseline_total_spend, {rsql('sum(a_spend + n_spend + r_spend)', 3)} AS scenario_total_spend, {rsql('sum(a_spend + n_spend + r_spend) - (SELECT sum(a_spend + n_spend + r_spend) FROM pn)', 3)} AS spend_change FROM ed")
def _(spark, d):
    p = plan(spark, d)
    out = md.spend_change(p, md.apply_scenario(p, _EDIT, CHANNELS), CHANNELS)
    return out.select(*[rnd(c, 3).alias(c) for c in out.columns])


_CURVE = """, sh AS (SELECT channel, avg(alpha) AS a, avg(theta) AS th FROM st GROUP BY 1), gd AS (SELECT channel, max(spend) * 1.2 AS top FROM lg GROUP BY 1),
  lv AS (SELECT channel, CAST(i AS INTEGER) AS point, top * i / 24.0 AS spend, pow(top * i / 24.0 / spend_scale, a) / (pow(top * i / 24.0 / spend_scale, a) + pow(th, a)) AS s FROM gd JOIN sc USING (channel) JOIN sh USING (channel), generate_series(0, 24) g(i)),
  cv AS (SELECT lv.channel, point, spend, avg(beta * s) AS rm, quantile_cont(beta * s, 0.05) AS r5, quantile_cont(beta * s, 0.95) AS r95 FROM lv JOIN st USING (channel) GROUP BY 1, 2, 3)"""


@query("l9_response_curves", _LI + _CURVE + f" SELECT channel, point, {rsql('spend', 3)} AS spend, {rsql('rm', 5)} AS response_mean, {rsql('r5', 5)} AS response_hdi_5, {rsql('r95', 5)} AS response_hdi_95 FROM cv")
def _(spark, d):
    p = plan(spark, d)
    out = md.response_curves(p, CHANNELS, media_draws(spark, d), scales(p))
    return out.select("channel", "point", rnd("spend", 3).alias("spend"), *[rnd(c, 5).alias(c) for c in ("response_mean", "response_hdi_5", "response_hdi_95")])


@query("l3_curve_shape", _LI + _CURVE + """, dd AS (SELECT channel, point, rm - lag(rm) OVER (PARTITION BY channel ORDER BY point) AS d FROM cv)
  SELECT channel, bool_and(d >= -1e-9) AS monotone, max(d) FILTER (point = 24) <= max(d) FILTER (point = 13) + 1e-12 AS saturating FROM dd WHERE d IS NOT NULL GROUP BY 1""")
def _(spark, d):
    p = plan(spark, d)
    return md.curve_shape(md.response_curves(p, CHANNELS, media_draws(spark, d), scales(p)))


@query("d59_recovery_checks")
def _(spark, d):
    p, draws_ = plan(spark, d), media_draws(spark, d)
    decays = spark.createDataFrame([("a_spend", 0.22), ("n_spend", 0.43), ("r_spend", 0.9)], "channel string, true_decay double")
    shapes = md.curve_shape(md.response_curves(p, CHANNELS, draws_, scales(p)))
    return md.recovery_checks(_matched(spark, d, p, draws_), _effects(spark, d), draws_, shapes, decays)
