import math

import pytest
from pyspark.sql import functions as F

from pulseframe.functions import intent, text, timing
from pulseframe.operators import backtest, calendar, cleaning, compare, evaluation, media, ordered, scores, series, splits, vectors, weekly
from pulseframe.plans import signals as signal_plan
from pulseframe.plans import weekly as weekly_plan
from pulseframe.sources import landing


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_intent_rules_first_match_wins(spark):
    cases = [
        ("I lost interest, not buying it", "expectation_decay"), ("Bought on day one", "high_intent"),
        ("I never played before", "new_customer_interest"), ("this is CONFUSING", "confusion_barrier"),
        ("pure copium", "content_drought_fatigue"), ("it has been 3 years", "frustrated_demand"),
        ("I grew up with it", "nostalgia_reactivation"), ("éday oneé", "general_discussion"), ("100% done", "general_discussion"),
    ]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    got = [r[0] for r in df.select(intent.intent_label(F.col("t"))).collect()]
    assert got == [label for _, label in cases]


def test_timestamps_are_not_guessed(spark):
    raw = ["2024-01-01T10:00:00Z", "1704103200", "2024-01-01T10:00:00", "0", "", "nan", "2999-01-01T00:00:00Z", "soon"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, timestamp string")
    got = rows(cleaning.with_parsed_time(df, now="2024-06-01").select("i", "timestamp_status"), "i")
    assert [s for _, s in got] == ["valid", "valid", "invalid", "invalid", "missing", "missing", "invalid", "invalid"]


def test_clean_drops_every_copy_of_an_id_with_blank_first_copy(spark):
    data = [(0, "a", " ", "2024-01-01T00:00:00Z"), (1, "a", "text", "2024-01-01T00:00:00Z"), (2, "b", "see https://x.y/z now", ""),
            (3, None, "one", ""), (4, None, "two", ""), (5, "c", "[Removed]", "")]
    df = spark.createDataFrame(data, "pos int, id string, text string, timestamp string")
    assert rows(cleaning.clean_signals(df, "pos", "2024-06-01").select("pos", "text"), "pos") == [(2, "see now"), (3, "one")]


def test_demand_score_by_hand(spark):
    df = spark.createDataFrame([("high_intent", "positive", 9.0, "p"), ("confusion_barrier", "negative", -4.0, None)],
                               "intent_label string, sentiment_label string, engagement double, parent_id string")
    scored = scores.score_signals(df)
    got = [r["demand_score"] for r in scored.orderBy(F.desc("demand_score")).collect()]
    assert got[0] == pytest.approx(3.0 * (1 + math.log(10) / 5)) and got[1] == pytest.approx(-1.5)
    assert scores.parent_scores(scored).filter("parent_id IS NULL").count() == 1


def test_empty_week_has_zero_counts_and_null_rates(spark):
    df = spark.createDataFrame([("2024-01-01", "high_intent"), ("2024-01-16", "general_discussion")], "d string, intent_label string")
    out = weekly.aggregate_periods(df.select(F.to_timestamp("d").alias("timestamp"), "intent_label"))
    got = rows(out.select("total_comments", "actionable_rate", "period_start"), "period_start")
    assert [(a, b) for a, b, _ in got] == [(1, 1.0), (0, None), (1, 0.0)]


def test_asof_event_by_day(spark, monkeypatch):
    cal = calendar.prepare_calendar(spark.createDataFrame([("2024-01-10", "B"), ("2024-01-05", "A"), ("bad", "C")], "event_date string, event_name string"))
    sig = spark.createDataFrame([(i, f"2024-01-{i:02d} 12:00:00") for i in range(1, 20)], "i int, t string").select("i", F.to_timestamp("t").alias("timestamp"))
    small = rows(calendar.annotate_events(sig, cal).select("i", "event_window", "days_since_event"), "i")
    monkeypatch.setattr(calendar, "DAY_SLICES", 3)
    assert rows(calendar.annotate_events(sig, cal).select("i", "event_window", "days_since_event"), "i") == small
    assert small[0][1] == "pre_announcement" and small[5][1] == "post_a" and small[18][1] == "post_b"


def test_event_announced_later_is_invisible(spark):
    cal = calendar.prepare_calendar(spark.createDataFrame([("2024-01-01", "A", "2024-02-01")], "event_date string, event_name string, announced_date string"))
    per = spark.createDataFrame([("2024-01-08", "2024-01-15"), ("2024-01-08", "2024-02-05")], "p string, o string").select(
        F.to_timestamp("p").alias("period_start"), F.to_timestamp("o").alias("origin"))
    got = rows(calendar.event_features(per, cal, origin_col="origin").select("origin", "last_event_name"), "origin")
    assert [n for _, n in got] == ["pre_announcement", "A"]


def test_future_change_leaves_earlier_forecasts(spark):
    base = [(i, float((i * 7) % 13)) for i in range(40)]
    frame = lambda data: spark.createDataFrame(data, "i int, v double").withColumn("p", F.expr("timestamp'2024-01-01' + make_dt_interval(i * 7)"))
    pick = lambda df: rows(backtest.backtest(df, [], "p", "v", ("naive", "mean")).filter("origin <= 20").select("model", "origin", "horizon_step", "forecast", "lower", "upper"), "model", "origin", "horizon_step")
    assert pick(frame(base)) == pick(frame(base[:30] + [(i, 999.0) for i in range(30, 40)]))


def test_ranking_metrics_with_ties(spark):
    df = spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)])], "id int, y int, p double")
    areas = evaluation.ranking_areas(evaluation.score_table(df, "y", "p")).first()
    assert areas["roc_auc"] == pytest.approx(0.625)
    best = evaluation.select_threshold(df, "y", "p").first()
    assert best["selected_threshold"] == pytest.approx(0.1) and best["validation_score"] == pytest.approx(0.8)


def test_sliced_order_equals_one_window(spark, monkeypatch):
    df = spark.createDataFrame([(i, (i * 37) % 101 / 10.0, i % 3 % 2) for i in range(500)], "id int, score double, y int")
    table = evaluation.score_table(df, "y", "score")
    plain = rows(ordered.running_totals(table, [], "score", {"c": "n"}).select("score", "c"), "score")
    monkeypatch.setattr(ordered, "SLICES", 1)
    assert rows(ordered.running_totals(table, [], "score", {"c": "n"}).select("score", "c"), "score") == plain
    monkeypatch.setattr(ordered, "SLICES", 7)
    assert rows(ordered.running_totals(table, [], "score", {"c": "n"}).select("score", "c"), "score") == plain
    named = df.withColumn("tie", F.format_string("%05d", F.lit(1000) - F.col("id")))
    order = sorted(df.collect(), key=lambda r: (-r.score, 1000 - r.id))
    want = sorted((r.id, i + 1, sum(q.y for q in order[: i + 1])) for i, r in enumerate(order))
    assert [tuple(r) for r in rows(ordered.ranked_rows(named, "score", "y", "tie").select("id", "position", "found"), "id")] == want


def test_running_totals_of_an_empty_table(spark):
    table = spark.createDataFrame([], "score double, n long")
    assert ordered.running_totals(table, [], "score", {"c": "n"}).count() == 0


def test_bias_run_and_selection(spark):
    data = [("a", o, 1, 10.0, 13.0, 0.0, 20.0) for o in range(12)] + [("b", o, 1, 10.0, 10.0 + (4 if o % 2 else -4), 0.0, 20.0) for o in range(12)]
    bt = spark.createDataFrame(data, "model string, origin int, horizon_step int, actual double, forecast double, lower double, upper double").withColumn("s", F.lit("x"))
    flags = compare.bias_flags(compare.monitoring_table(bt, ["s"]), ["s"])
    assert rows(flags.select("model", "persistent_bias", "longest_bias_run"), "model") == [("a", True, 12), ("b", False, 0)]
    assert compare.select_model(compare.comparison_table(bt, flags, ["s"]), flags, ["s"]).first()["selected"] == "b"


def test_group_split_keeps_groups_whole(spark, monkeypatch):
    df = spark.createDataFrame([(str(i), f"g{i % 40}", f"t{i}") for i in range(400)], "record_id string, parent_id string, text string")
    out = splits.group_split(df)
    assert out.count() == 400 and splits.leakage(out).count() == 0
    assert out.filter("split = 'train'").count() in range(240, 320)
    placed = rows(out.select("record_id", "split"), "record_id")
    monkeypatch.setattr(ordered, "SLICES", 9)
    assert rows(splits.group_split(df).select("record_id", "split"), "record_id") == placed


def test_group_split_refuses_an_empty_split(spark):
    df = spark.createDataFrame([(str(i), "one", "t") for i in range(9)], "record_id string, parent_id string, text string")
    with pytest.raises(ValueError, match="no group falls to"):
        splits.group_split(df)


def test_folds_follow_from_the_key_alone(spark):
    df = spark.createDataFrame([(f"g{i}",) for i in range(300)], "group_key string")
    some = dict(map(tuple, splits.group_folds(df.where("group_key < 'g2'")).collect()))
    every = dict(map(tuple, splits.group_folds(df).collect()))
    assert all(every[g] == f for g, f in some.items()) and set(every.values()) == set(range(5))


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    base = "the quick brown fox jumps over the lazy dog near the river bank"
    texts = [base, base + " today", base.upper(), "completely different words about cooking pasta", base.replace("fox", "cat"), "zebra xylophone quartz"]
    df = spark.createDataFrame([(str(i), t, f"g{i}", "l") for i, t in enumerate(texts)], "record_id string, text string, parent_id string, label string")

    def grams(t):
        out = {}
        for w in t.lower().split():
            w = f" {w} "
            for n in (3, 4, 5):
                for i in range(len(w) - n + 1):
                    out[w[i:i + n]] = out.get(w[i:i + n], 0) + 1
        return out

    vecs = [grams(t) for t in texts]
    n = len(vecs)
    dfreq = {}
    for v in vecs:
        for g in v:
            dfreq[g] = dfreq.get(g, 0) + 1
    unit = []
    for v in vecs:
        w = {g: c * (math.log((1 + n) / (1 + dfreq[g])) + 1) for g, c in v.items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        unit.append({g: x / size for g, x in w.items()})
    want = set()
    for a in range(n):
        for b in range(a + 1, n):
            s = sum(x * unit[b].get(g, 0) for g, x in unit[a].items())
            if s >= 0.8 and texts[a].lower() != texts[b].lower():
                want.add((str(a), str(b)))
    monkeypatch.setattr(vectors, "POSTINGS_PER_BLOCK", 2)
    got = {(r[0], r[1]) for r in vectors.near_duplicate_pairs(df, "record_id", "parent_id", "label").collect()}
    assert got == {p for p in want if "2" not in p}
    assert vectors.copy_groups(df, "record_id").count() == 2


def test_adstock_and_plan_edits(spark):
    df = spark.createDataFrame([(0, 100.0), (1, 0.0), (2, 0.0)], "t int, spend double").withColumn("c", F.lit("x"))
    got = rows(media.adstock(df, ["c"], "t", F.lit(0.5)).select("t", "adstock"), "t")
    assert [v for _, v in got] == [100.0, 50.0, 25.0]
    plan = spark.createDataFrame([(10.0, 20.0, 1.0)], "a double, b double, price double")
    assert media.apply_scenario(plan, media.reallocation("a", "b", 0.25), ["a", "b"]).first()[:2] == (7.5, 22.5)
    with pytest.raises(ValueError):
        media.PlanScenario(budget_changes={"z": 2.0}).validate(["a", "b"])


def test_gap_runs(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([3, 0, 0, 1, 0, 2, 2])], "i int, n int")
    assert [tuple(r)[:3] for r in series.gap_runs(df, [], "i", "n").collect()] == [(1, 2, 2)]
    assert series.longest_dense_run(df, [], "i", "n").first()[0] == 2


def test_text_helpers(spark):
    got = spark.range(1).select(text.slug(F.lit("Big -- Trailer!")), text.text_key(F.lit("  A\tb  C ")), timing.serialise_timestamp(F.lit(None).cast("timestamp"))).first()
    assert tuple(got) == ("big_trailer", "a b c", "")


@pytest.mark.parametrize("pattern, text_, hit", [
    (r"\b[ab]oo\b", "a boo", True), (r"\bi?want\b", "want it", True), (r"\bfoo\b|\bbar\b", "the bar", True), (r"\bfoo\b|\bbar\b", "foobar", False),
    (r"\b(?:new|old) one", "an old one", True), (r"\b(?:a|b)?c", "c here", True), (r"\b\d+ days", "in 12 days", True), ("x+", "axb", True), (r"\bne", "wé née", False),
])
def test_label_regex_takes_patterns_as_they_are(spark, pattern, text_, hit):
    df = spark.createDataFrame([(text_,)], "t string")
    assert df.select(F.col("t").rlike(intent.label_regex([pattern, r"\bnever seen"]))).first()[0] is hit


def test_empty_time_is_missing(spark):
    df = spark.createDataFrame([("",), ("2024-01-01T00:00:00Z",), (None,), ("0",)], "t string")
    assert [r[0] for r in df.select(landing._time_source(F.col("t"))).collect()] == ["missing", "api_created", "missing", "missing"]


def test_signal_stages_need_a_tone(spark, tmp_path):
    columns = "id string, source string, record_type string, text string, author string, timestamp timestamp, engagement int, permalink string, parent_id string, metadata string, place int"
    raw = spark.createDataFrame([("1", "reddit", "comment", "a good day", "x", None, 3, "", "p", "{}", 1), ("2", "reddit", "comment", "bad day", "x", None, 1, "", "p", "{}", 2)], columns)
    with pytest.raises(ValueError, match="lexicon"):
        signal_plan.run(raw, "place")
    words = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], "word string, valence double")
    out = signal_plan.run(raw, "place", lexicon={"lexicon": words, "negations": ["not"], "boosters": {}}, keep=signal_plan.written(str(tmp_path)))
    assert {r.id: r.sentiment_label for r in out["sentiment"].collect()} == {"1": "positive", "2": "negative"}
    assert "intent_confidence" in spark.read.parquet(f"{tmp_path}/intent").columns


def test_media_by_draw_equals_a_loop(spark):
    plan = spark.createDataFrame([(t, float(t % 4 * 10), float(5 + t % 3)) for t in range(12)], "t int, a double, b double")
    draws = [(k, c, 0.1 + 0.05 * (k % 10), 1.0 + 0.1 * (k % 3), 0.5 + 0.1 * (k % 4), 2.0 + k) for k in range(40) for c in "ab"]
    frame = spark.createDataFrame(draws, "draw long, channel string, decay double, alpha double, theta double, beta double")
    scale = spark.createDataFrame([("a", 30.0), ("b", 7.0)], "channel string, spend_scale double")
    got = {(r.draw, r.channel, r.t): r.effect for r in media.media_by_draw(plan, ["a", "b"], frame, scale).collect()}
    assert len(got) == 40 * 2 * 12
    for draw, c, d, alpha, theta, beta in draws:
        carried = 0.0
        for t in range(12):
            carried = (t % 4 * 10 / 30.0 if c == "a" else (5 + t % 3) / 7.0) + d * carried
            x = (carried * (1 - d)) ** alpha
            assert got[draw, c, t] == pytest.approx(beta * x / (x + theta**alpha))
    one = {(r.draw, r.channel, r.t): r.effect for r in media.media_by_draw(plan, ["a", "b"], frame, scale, salts=1).collect()}
    assert one == pytest.approx(got)
    with pytest.raises(Exception, match="decay must be"):
        media.media_by_draw(plan, ["a", "b"], frame.withColumn("decay", F.lit(1.0)), scale).collect()


def test_coverage_details(spark):
    days = [("a", "2024-01-01 05:00:00"), ("b", "2024-01-02 00:00:00"), ("a", "2024-01-06 10:00:00"), (None, "2024-01-06 11:00:00"), ("c", None)]
    df = spark.createDataFrame(days, "source string, timestamp string").withColumn("timestamp", F.to_timestamp("timestamp"))
    plan = calendar.prepare_calendar(spark.createDataFrame([("2024-01-03", "Mid"), ("2024-01-01", "First")], "event_date string, event_name string"))
    got = weekly.coverage_details(df, "D", plan).collect()
    assert sorted((r.item or "", r.periods) for r in got if r.section == "source") == [("", 1), ("a", 2), ("b", 1)]
    assert [(r.start.day, r.end.day, r.periods) for r in got if r.section == "gap"] == [(3, 5, 3)]
    assert sorted((r.item, r.periods_before, r.periods_after, r.usable) for r in got if r.section == "event") == [("First", 0, 6, False), ("Mid", 2, 4, True)]
    assert weekly.coverage_details(df.where("timestamp is null"), "D", plan).count() == 0
    assert {r.section for r in weekly.coverage_details(df, "D").collect()} == {"source", "gap"}


def test_weekly_facts(spark):
    rows_ = [(f"p{i % 3}", "youtube", f"2024-01-{1 + i:02d} 08:00:00", "high_intent" if i % 2 else "nostalgia", 0.5 if i % 4 else None, "model", 0.1, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows_, "parent_id string, source string, timestamp string, intent_label string, actionable_probability double, probability_source string, vader_compound double, demand_score double")
    df = df.withColumn("timestamp", F.to_timestamp("timestamp"))
    with pytest.raises(ValueError, match="demo"):
        weekly_plan.build_weekly(df, known=[df.limit(3), df.repartition(3)])
    seeds = df.select(F.col("parent_id").alias("video_id")).distinct()
    cases = [(dict(known=[df], demo=True), "demo_only", False), (dict(), "full_dataset", True),
             (dict(manifest=landing.manifest(seeds, df, 7)), "seed_capped_dataset", False), (dict(manifest=landing.manifest(seeds, df, 8)), "full_dataset", True)]
    for options, status, representative in cases:
        table, facts = weekly_plan.build_weekly(df, **options)
        fact = facts.first()
        assert (fact.evaluation_status, fact.volume_representative, fact.rows_with_probability, fact.rows_without_probability) == (status, representative, 15, 5)
        assert {r.evaluation_status for r in table.collect()} == {status} and fact.observed_periods == table.count() == 3
        assert fact.source_dataset_hash == landing.content_hash(df).first()[0] and fact.manifest_found == ("manifest" in options)


def test_support_of_all_seeds_equals_each_split(spark):
    data = [(f"r{i}", f"g{i * i % 17}", "high_intent" if i % 3 else "general_discussion") for i in range(200)]
    df = spark.createDataFrame(data, "record_id string, parent_id string, label string")
    got = {r.seed: r for r in splits.split_support(df, [1, 2, 42], "label").collect()}
    for seed in (1, 2, 42):
        part = splits.effective_groups(df).join(splits.assign_groups(splits.effective_groups(df), seed), "group_key").where("split = 'test'").collect()
        r = got[seed]
        assert (r.test_rows, r.test_groups) == (len(part), len({x.group_key for x in part}))
        assert (r.high_intent, r.general_discussion) == (sum(x.label == "high_intent" for x in part), sum(x.label == "general_discussion" for x in part))


def test_isotonic_on_score_counts_equals_rows(spark):
    from pyspark.ml.regression import IsotonicRegression

    data = [(float(i * 7 % 13) / 13, float((i * i + i // 5) % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(data, "raw_score double, label double")
    counts = df.groupBy("raw_score").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    rows_fit = IsotonicRegression(featuresCol="raw_score", labelCol="label").fit(df)
    counts_fit = IsotonicRegression(featuresCol="raw_score", labelCol="label", weightCol="weight").fit(counts)
    for x in [i / 40 for i in range(41)]:
        assert counts_fit.predict(x) == pytest.approx(rows_fit.predict(x))
