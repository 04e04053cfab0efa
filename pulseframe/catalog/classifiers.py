"""Text features and classifiers over the labelled documents."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pulseframe.catalog.base import intent_sql, labelled_docs, query, rnd, rsql, signals, table, with_views
from pulseframe.catalog.evaluation import predictions
from pulseframe.functions import intent
from pulseframe.operators import agreement, evaluation
from pulseframe.operators import vectors as ve
from pulseframe.plans import classifiers as cl
from pulseframe.plans import persistence as ps
from pulseframe.plans import studies as st
from pulseframe.session import materialise, side_by_side, work_path



def corpus(spark, d):
    lab = labelled_docs(spark, d)
    label = F.when(F.col("quality") == 0, intent.GENERAL).when(F.col("sample_strategy") == "en", "high_intent").otherwise("confusion_barrier")
    return lab.select("record_id", "text", "parent_id", F.col("parent_id").alias("source"), label.alias("corrected_label"), (F.col("quality") == 1).alias("actionable"))


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]{2,}')"


def _tfidf_sql(terms: str) -> str:
    return f"""WITH tk AS (SELECT doc_id, unnest({terms}) AS term FROM documents), tf AS (SELECT doc_id, term, 1 + ln(count(*)) AS tf FROM tk GROUP BY 1, 2),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
  rw AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS r FROM tf JOIN df USING (term), n),
  wt AS (SELECT doc_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS w FROM rw)"""


_BIGRAMS = f"list_concat({_WORDS}, list_transform(list_zip(({_WORDS})[:-2], ({_WORDS})[2:]), lambda p: p[1] || ' ' || p[2]))"


def _weights(spark, d, terms):
    docs = table(spark, d, "documents")
    return ve.text_tfidf(docs, "doc_id", terms, docs.count(), sublinear=True)


@query("j1_word_tfidf", _tfidf_sql(_BIGRAMS) + f" SELECT doc_id AS doc, count(*) AS terms, {rsql('sum(w)', 5)} AS total, {rsql('max(w)', 5)} AS largest FROM wt GROUP BY 1")
def _(spark, d):
    out = _weights(spark, d, ve.word_terms(F.col("text"), 2))
    return out.groupBy("doc").agg(F.count("*").alias("terms"), rnd(F.sum("weight"), 5).alias("total"), rnd(F.max("weight"), 5).alias("largest"))


_CHARS = """flatten(list_transform(list_transform(list_filter(string_split(trim(regexp_replace(replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's'), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g')), ' '), lambda w: w <> ''), lambda w: ' ' || w || ' '),
    lambda w: flatten(list_transform([3, 4, 5], lambda n: list_transform(generate_series(1, length(w) - n + 1), lambda i: substr(w, i, n))))))"""


@query("j2_char_tfidf", _tfidf_sql(_CHARS) + f" SELECT doc_id AS doc, count(*) AS terms, {rsql('sum(w)', 5)} AS total, {rsql('max(w)', 5)} AS largest FROM wt GROUP BY 1")
def _(spark, d):
    out = _weights(spark, d, ve.char_grams(F.col("text")))
    return out.groupBy("doc").agg(F.count("*").alias("terms"), rnd(F.sum("weight"), 5).alias("total"), rnd(F.max("weight"), 5).alias("largest"))


_UNION = "WITH lt AS (SELECT doc_id, text FROM documents JOIN labels USING (doc_id)), "


def _block_sql(name: str, terms: str) -> str:
    """Terms, total and largest weight of one block over the labelled documents."""
    inner = _tfidf_sql(terms).removeprefix("WITH ").replace("FROM documents", "FROM lt")
    return f"{name} AS (WITH {inner} SELECT doc_id, count(*) AS terms, sum(w) AS total, max(w) AS largest FROM wt GROUP BY 1)"


@query("j3_feature_union", _UNION + _block_sql("wb", _BIGRAMS) + ", " + _block_sql("cb", _CHARS) + f""" SELECT CAST(lt.doc_id AS VARCHAR) AS record_id,
  CAST(coalesce(wb.terms, 0) + coalesce(cb.terms, 0) AS INTEGER) AS terms, {rsql('coalesce(wb.total, 0) + coalesce(cb.total, 0)', 5)} AS total,
  {rsql('greatest(coalesce(wb.largest, 0), coalesce(cb.largest, 0))', 5)} AS largest FROM lt LEFT JOIN wb USING (doc_id) LEFT JOIN cb USING (doc_id)""")
def _(spark, d):
    rows = corpus(spark, d).withColumn("doc", F.col("record_id"))
    made = cl.TextFeatures(("word", "char")).fit(rows).transform(rows)
    weights = F.unwrap_udt("features")["values"]  # of the row's own terms; a dense array would have the vocabulary's length
    made = made.select("record_id", weights.alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, w: a + w)
    return made.select("record_id", F.size("w").alias("terms"), rnd(total, 5).alias("total"), rnd(F.coalesce(F.array_max("w"), F.lit(0.0)), 5).alias("largest"))


@query("j6_majority_baseline", with_views("lab", f" SELECT record_id, (SELECT label_a FROM lab GROUP BY 1 ORDER BY count(*) DESC, label_a DESC LIMIT 1) AS predicted_label, {rsql('''(SELECT avg(CASE WHEN label_a = 'high_intent' THEN 1.0 ELSE 0.0 END) FROM lab)''')} AS prior FROM lab"))
def _(spark, d):
    lab = labelled_docs(spark, d)
    out = cl.majority_baseline(lab, lab, "label_a")
    prior = F.aggregate("scores", F.lit(0.0), lambda a, c: a + F.when(c.getField("label") == "high_intent", c.getField("score")).otherwise(0.0))
    return out.select("record_id", "predicted_label", rnd(prior).alias("prior"))


_RULE = f", pl AS (SELECT *, {intent_sql('text')[0]} AS plain FROM lab), rl AS (SELECT record_id, {intent_sql('text')[1]} AS r FROM pl)"


@query("j7_rule_baseline", with_views("lab", _RULE + " SELECT record_id, CASE WHEN r = 'general_discussion' THEN r ELSE 'actionable' END AS predicted_label, CASE WHEN r = 'general_discussion' THEN 0.3 ELSE 0.7 END::DOUBLE AS score FROM rl"))
def _(spark, d):
    return cl.rule_baseline(labelled_docs(spark, d), binary=True).select("record_id", "predicted_label", "score")


@query("j8_prediction_records", with_views("lab", _RULE + " SELECT record_id, r AS label, CASE WHEN r = 'general_discussion' THEN 0.3 ELSE 0.7 END::DOUBLE AS score, 'rule_indicator' AS score_type FROM rl"))
def _(spark, d):
    rows = cl.rule_baseline(labelled_docs(spark, d))
    return cl.prediction_record(rows, F.col("predicted_label"), F.col("score"), cl.INDICATOR).select("record_id", "prediction_record.*")


def _split(spark, d, name):
    from pulseframe.operators import splits

    rows = materialise(splits.group_split(corpus(spark, d)).withColumn("doc", F.col("record_id")), "split")
    return cl.with_features(rows, name)


def _stage_rows(spark, d, name, method="sigmoid"):
    rows = _split(spark, d, name)
    stage = cl.train_stage1(name, rows, method=method)
    return stage.scores(rows.filter("split = 'test'")).select("record_id", rnd("score", 4).alias("score"), (F.col("score") > F.lit(stage.threshold)).alias("picked"))


@query("j4_logistic")
def _(spark, d):
    return _stage_rows(spark, d, "logistic")


@query("j5_linear_svm")
def _(spark, d):
    return _stage_rows(spark, d, "linear_svm")


@query("j5_char_word_svm")
def _(spark, d):
    return _stage_rows(spark, d, "char_word_svm")


@query("j9_two_stage")
def _(spark, d):
    rows = _split(spark, d, "logistic")
    out = cl.train_two_stage("logistic", rows).transform(rows.filter("split = 'test'"))
    return out.select("record_id", "is_actionable", "intent_label", rnd("actionable_probability", 4).alias("actionable_probability"), "model_name")


def _event_stage(spark, d):
    """Event scores as the raw scores of a stage without a model of its own."""
    rows = predictions(spark, d).withColumns({"actionable": F.col("y"), "text": F.lit("")})

    class Given(cl.BinaryStage):
        def raw_scores(self, df):
            return df.withColumn("raw_score", F.col("p"))

    return Given("linear_svm"), rows


@query("j10_platt_calibration")
def _(spark, d):
    stage, rows = _event_stage(spark, d)
    return stage.calibrate(rows).scores(rows).groupBy("k").agg(rnd(F.avg("score"), 4).alias("probability"))


@query("j11_isotonic_calibration")
def _(spark, d):
    stage, rows = _event_stage(spark, d)
    return stage.calibrate(rows, method="isotonic").scores(rows).groupBy("k").agg(rnd(F.avg("score"), 4).alias("probability"))


@query("j12_stage1_training")
def _(spark, d):
    rows = _split(spark, d, "linear_svm")
    stage = cl.train_stage1("linear_svm", rows)
    scored = stage.scores(rows.filter("split = 'test'")).withColumn("pred", (F.col("score") > F.lit(stage.threshold)).cast("int"))
    out = evaluation.binary_metrics(scored.withColumn("y", F.col("actionable").cast("int")), "y", "pred", "score")
    return out.select("support_total", *[rnd(c, 4).alias(c) for c in ("accuracy", "f1", "pr_auc", "brier_score")])


@query("j13_embedding_head")
def _(spark, d):
    emb = table(spark, d, "embeddings")
    model = cl.embedding_head(emb, "embedding", "label")
    made = model.transform(emb.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    return made.groupBy("label").agg(F.count("*").alias("rows"), rnd(F.avg((F.col("prediction") == F.col("label")).cast("double")), 4).alias("accuracy"))


@query("j14_out_of_fold")
def _(spark, d):
    return cl.out_of_fold(corpus(spark, d)).select("record_id", "group_key", "fold", rnd("oof_probability", 4).alias("oof_probability"))


@query("j15_build_probabilities")
def _(spark, d):
    sig = signals(spark, d).drop("actionable_probability", "probability_source")
    out = cl.build_probabilities(sig, corpus(spark, d))
    return out.groupBy("probability_source").agg(F.count("*").alias("rows"), F.count("actionable_probability").alias("with_probability"))


@query("j16_batch_scores", with_views("lab", _RULE + " SELECT record_id, r AS intent_label, r <> 'general_discussion' AS is_actionable, 'rules' AS model_name FROM rl"))
def _(spark, d):
    return cl.rule_scores(labelled_docs(spark, d)).select("record_id", "intent_label", "is_actionable", "model_name")


def _saved(spark, d, name="logistic"):
    """A two-stage model of the labelled corpus, written and read again."""
    path = work_path(spark, "model")
    ps.TwoStageTextClassifier(name).fit(corpus(spark, d)).write().save(path)
    return ps.load_model(spark, path, {"seed": 42}), path


@query("j16_model_scores")
def _(spark, d):
    model, _ = _saved(spark, d)
    out = ps.score_rows(table(spark, d, "documents"), model)
    return out.select("doc_id", "is_actionable", "intent_label", rnd("actionable_probability").alias("actionable_probability"), "model_name")


@query("j17_saved_model")
def _(spark, d):
    model, _ = _saved(spark, d)
    made = model.transform(corpus(spark, d).withColumn("doc", F.col("record_id")))
    return made.select("record_id", "is_actionable", "intent_label", rnd("actionable_probability", 4).alias("score"))


@query("j18_train_and_save")
def _(spark, d):
    model, path = _saved(spark, d)
    written = spark.read.parquet(f"{path}/vocabulary").groupBy("block").agg(F.count("*").alias("terms"))
    facts = ps.read_facts(spark, path)
    return written.select("block", "terms", F.round(F.lit(facts["threshold"]), 4).alias("threshold"), F.lit(facts["stage2_model_name"]).alias("stage2"),
                          F.lit(len(facts["stage2_classes"])).alias("classes"), F.lit(ps.is_compatible(facts)).alias("compatible"))


@query("j19_benchmark")
def _(spark, d):
    out = cl.benchmark(corpus(spark, d), models=("majority", "rules", "logistic"))
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.withColumns({c: rnd(c, 4) for c in doubles})


@query("j20_group_cv")
def _(spark, d):
    out = cl.group_cv(corpus(spark, d))
    return out.select("model", "seed", "support_total", *[rnd(c, 4).alias(c) for c in ("accuracy", "f1", "pr_auc", "roc_auc")])


def _digits(df):
    return df.withColumns({c: rnd(c, 4) for c, t in df.dtypes if t == "double"})


@query("j19_benchmark_study")
def _(spark, d):
    # Two seeds of the plan's five: a training is 100 rounds over 200,000 terms, which one machine takes minutes for.
    return _digits(st.benchmark_study(corpus(spark, d), seeds=(42, 43))["per_seed"])


@query("j20_group_cv_study")
def _(spark, d):
    rows = corpus(spark, d).join(labelled_docs(spark, d).select("record_id", "sample_strategy"), "record_id")
    # One model and two seeds of the plan's two and three, for the same reason; all folds.
    tables = st.group_cv_study(rows, ("logistic",), (42, 43))
    kinds = {"per_seed": ["model", "seed"], "per_class": ["model", "seed", "label"], "reliability": ["model", "bin"], "slices": ["model", "dimension", "value"],
             "groups": ["model", "parent_id"], "bootstrap": ["model", "metric"]}
    out = None
    for name, keys in kinds.items():
        frame = tables[name]
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        values = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in frame.columns if c not in keys]
        long = frame.select(F.lit(name).alias("table"), key.alias("key"), F.inline(F.array(*values))).withColumn("value", rnd("value", 4))
        out = long if out is None else out.unionByName(long)
    return out


@query("c10_oof_join", "SELECT CAST(doc_id AS VARCHAR) AS record_id, (doc_id % 100) / 100.0::DOUBLE AS oof_probability FROM labels JOIN documents USING (doc_id)")
def _(spark, d):
    oof = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("record_id"), ((F.col("doc_id") % 100) / F.lit(100.0)).alias("oof_probability"))
    return agreement.align_predictions(corpus(spark, d), oof).select("record_id", "oof_probability")


@query("j21_error_exports", with_views("ev", ", e AS (SELECT *, CAST(p > 0.45 AS INTEGER) AS pred, event_type = 'purchase' OR k < 50 AS ok FROM ev) SELECT 'false_positive' AS kind, count(*) AS rows FROM e WHERE pred = 1 AND y = 0"
       " UNION ALL SELECT 'false_negative', count(*) FROM e WHERE pred = 0 AND y = 1 UNION ALL SELECT 'multiclass', count(*) FROM e WHERE NOT ok"))
def _(spark, d):
    rows = predictions(spark, d)
    stage = evaluation.stage_errors(rows, "y", "pred").groupBy(F.col("error_kind").alias("kind")).agg(F.count("*").alias("rows"))
    return stage.unionByName(rows.filter("NOT ok").agg(F.lit("multiclass").alias("kind"), F.count("*").alias("rows")))


@query("j26_dataset_audit", with_views("lab", f""", g AS (SELECT parent_id, count(*) AS n FROM lab GROUP BY 1) SELECT (SELECT count(*) FROM lab) AS rows, count(*) AS groups, {rsql('(SELECT sum(n) FROM (SELECT n FROM g ORDER BY n DESC LIMIT 3)) / sum(n)')} AS top3_group_share,
  count(*) FILTER (n = 1) AS single_row_groups, {rsql('(SELECT avg(CASE WHEN label_a = label_b THEN 1.0 ELSE 0.0 END) FROM lab)')} AS unchanged_share FROM g"""))
def _(spark, d):
    lab = labelled_docs(spark, d)
    frame = lab.select("parent_id", F.col("parent_id").alias("source"), F.col("label_a").alias("corrected_label"))
    groups = agreement.group_table(frame)
    out = side_by_side(
        groups.agg(F.sum("rows").alias("rows"), F.count("*").alias("groups")), agreement.group_concentration(groups),
        agreement.revision_summary(lab, "label_a", "label_b").select("unchanged_share"))
    return out.withColumns({"top3_group_share": rnd("top3_group_share"), "unchanged_share": rnd("unchanged_share")})
