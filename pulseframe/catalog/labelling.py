"""Labels, agreement, splits, samples, queues, near-duplicates, drift and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.base import (
    TEXT_KEY_SQL,
    labelled_docs,
    labelled_signals,
    query,
    rnd,
    rsql,
    signals,
    events,
    intent_sql,
    table,
    with_views,
)
from pulseframe.functions import intent, scoring
from pulseframe.operators import agreement as ag
from pulseframe.operators import drift
from pulseframe.operators import neighbours as nb
from pulseframe.operators import probabilities as pr
from pulseframe.operators import queue as qu
from pulseframe.operators import splits as sp
from pulseframe.operators import vectors as ve

DOC_TEXT = "replace(replace(replace(lower(trim(text)), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')"


def corpus(spark, d):
    """Labelled corpus in canonical columns."""
    return labelled_docs(spark, d).select(
        "record_id", "text", F.col("label_a").alias("corrected_label"), F.col("label_b").alias("original_rule_label"),
        F.col("parent_id").alias("source"), "parent_id", "sample_strategy", "doc_id")


_PAIR_SQL = """, pc AS (SELECT label_a AS a, label_b AS b, count(*) AS n FROM lab GROUP BY 1, 2),
  lb AS (SELECT label, sum(s) AS support, sum(p) AS predicted, sum(h) AS hits FROM (
    SELECT a AS label, n AS s, 0 AS p, CASE WHEN a = b THEN n ELSE 0 END AS h FROM pc UNION ALL SELECT b, 0, n, 0 FROM pc) GROUP BY 1),
  nn AS (SELECT sum(n)::DOUBLE AS n FROM pc)"""
_PO = "(SELECT sum(hits) FROM lb) / nn.n"
_PE = "(SELECT sum(support * predicted) FROM lb) / (nn.n * nn.n)"


@query("a14_labelled_corpus", """SELECT CAST(doc_id AS VARCHAR) AS record_id, CASE WHEN quality = 1 THEN 'high_intent' ELSE 'general_discussion' END AS corrected_label,
  quality = 1 AS actionable, 'annotator_1' AS annotator_id, CASE WHEN doc_id % 3 = 0 THEN 'yt:video' || (100000 + doc_id % 50) END AS parent_id,
  CASE WHEN doc_id % 3 = 0 THEN 'permalink_derived' ELSE 'missing' END AS group_id_source, lang AS sample_strategy FROM labels JOIN documents USING (doc_id)""")
def _(spark, d):
    docs = labelled_docs(spark, d)
    link = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?v=video"), (F.lit(100000) + F.col("doc_id") % 50).cast("string")))
    raw = docs.select(F.col("record_id").alias("id"), "text", F.col("label_a").alias("corrected_label"), F.col("parent_id").alias("source"),
                      link.alias("permalink"), F.col("sample_strategy").alias("sample_type"))
    return ag.labelled_corpus(raw).select("record_id", "corrected_label", "actionable", "annotator_id", "parent_id", "group_id_source", "sample_strategy")


@query("b16_usable_labels", with_views("lab", " SELECT record_id FROM lab WHERE toxic = 0 AND trim(text) <> ''"))
def _(spark, d):
    rows = labelled_docs(spark, d).withColumn("label", F.when(F.col("toxic") == 0, F.col("label_a")))
    return ag.usable_labels(rows, "label").select("record_id")


@query("d14_validation_report", with_views("lab", f""", c AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'other' ELSE label_a END AS lb, {DOC_TEXT} AS tk FROM lab)
  SELECT count(*) AS total_rows, count(*) FILTER (trim(text) = '') AS missing_text, count(*) FILTER (lb IS NULL) AS missing_labels, count(*) FILTER (lb = 'other') AS unknown_labels,
  0::BIGINT AS missing_parent_ids, 0::BIGINT AS duplicate_ids, count(DISTINCT parent_id) AS unique_groups, count(*) - count(DISTINCT tk) AS duplicate_texts,
  (SELECT count(*) FROM (SELECT tk FROM c GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT lb) > 1)) AS conflicting_labels,
  8 - (SELECT count(DISTINCT lb) FROM c WHERE lb <> 'other') AS empty_classes,
  {rsql('(SELECT max(n) / min(n)::DOUBLE FROM (SELECT count(*) AS n FROM c WHERE lb IS NOT NULL GROUP BY lb))')} AS class_imbalance_ratio, false AS valid FROM c"""))
def _(spark, d):
    label = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 13 == 0, "other").otherwise(F.col("corrected_label"))
    out = ag.validation_report(corpus(spark, d).withColumn("corrected_label", label))
    return out.withColumn("class_imbalance_ratio", rnd("class_imbalance_ratio"))


_LANGS = ("en", "fr", "de", "es")
_TAX = ", ".join(f"('{c}')" for c in intent.TAXONOMY)


@query("d15_class_by_strategy", with_views("lab", f", t AS (SELECT * FROM (VALUES {_TAX}) v(label_b)) SELECT label_b, " + ", ".join(f"count(*) FILTER (sample_strategy = '{c}') AS {c}" for c in _LANGS) + " FROM t LEFT JOIN lab USING (label_b) GROUP BY 1"))
def _(spark, d):
    return ag.cross_table(labelled_docs(spark, d), "label_b", "sample_strategy", intent.TAXONOMY, _LANGS)


@query("d16_group_table", with_views("lab", f" SELECT parent_id, count(*) AS rows, {rsql('''avg(CASE WHEN label_a = 'high_intent' THEN 1.0 ELSE 0.0 END)''')} AS actionable_share, count(DISTINCT label_a) AS classes, min(parent_id) AS source FROM lab GROUP BY 1"))
def _(spark, d):
    return ag.group_table(corpus(spark, d)).withColumn("actionable_share", rnd("actionable_share"))


@query("d16_group_concentration", with_views("lab", f", g AS (SELECT parent_id, count(*) AS n FROM lab GROUP BY 1) SELECT {rsql('(SELECT sum(n) FROM (SELECT n FROM g ORDER BY n DESC LIMIT 3)) / sum(n)')} AS top3_group_share, count(*) FILTER (n = 1) AS single_row_groups FROM g"))
def _(spark, d):
    return ag.group_concentration(ag.group_table(corpus(spark, d))).withColumn("top3_group_share", rnd("top3_group_share"))


@query("d17_rule_agreement", with_views("lab", f" SELECT sample_strategy, {rsql('avg(CASE WHEN label_a = label_b THEN 1.0 ELSE 0.0 END)')} AS agreement FROM lab GROUP BY 1"))
def _(spark, d):
    return ag.rule_agreement(labelled_docs(spark, d), "sample_strategy", "label_b", "label_a").withColumn("agreement", rnd("agreement"))


@query("d18_revisions", with_views("lab", _PAIR_SQL + f" SELECT CAST(nn.n AS BIGINT) AS rows_with_both_passes, 0::BIGINT AS rows_without_first_pass, CAST(nn.n - (SELECT sum(hits) FROM lb) AS BIGINT) AS revised_rows, {rsql(_PO)} AS unchanged_share, {rsql(f'({_PO} - {_PE}) / (1 - {_PE})')} AS first_pass_vs_final_kappa FROM nn"))
def _(spark, d):
    out = ag.revision_summary(labelled_docs(spark, d), "label_a", "label_b")
    return out.withColumns({c: rnd(c) for c in ("unchanged_share", "first_pass_vs_final_kappa")})


@query("d19_raw_agreement", with_views("lab", f" SELECT {rsql('avg(CASE WHEN label_a = label_b THEN 1.0 ELSE 0.0 END)')} AS raw_agreement FROM lab"))
def _(spark, d):
    return ag.agreement(ag.label_pairs(labelled_docs(spark, d), "label_a", "label_b")).select(rnd("raw_agreement").alias("raw_agreement"))


@query("d20_cohens_kappa", with_views("lab", _PAIR_SQL + f" SELECT {rsql(f'({_PO} - {_PE}) / (1 - {_PE})')} AS kappa FROM nn"))
def _(spark, d):
    return ag.agreement(ag.label_pairs(labelled_docs(spark, d), "label_a", "label_b")).select(rnd("kappa").alias("kappa"))


@query("d21_disagreement_table", with_views("lab", " SELECT label_a, count(*) FILTER (label_b = 'high_intent') AS high_intent, count(*) FILTER (label_b = 'confusion_barrier') AS confusion_barrier, count(*) FILTER (label_b = 'general_discussion') AS general_discussion FROM lab GROUP BY 1"))
def _(spark, d):
    return ag.cross_table(labelled_docs(spark, d), "label_a", "label_b", ("high_intent", "general_discussion"), ("high_intent", "confusion_barrier", "general_discussion"))


@query("f8_top_revisions", with_views("lab", " SELECT label_a AS first_pass, label_b AS final, count(*) AS rows FROM lab WHERE label_a <> label_b GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10"))
def _(spark, d):
    return ag.top_revisions(ag.label_pairs(labelled_docs(spark, d), "label_a", "label_b"))


@query("d32_multiclass_metrics", with_views("lab", _PAIR_SQL + f", t AS (SELECT * FROM (VALUES {_TAX}) v(label))" + f""" SELECT label, CAST(coalesce(support, 0) AS BIGINT) AS support, {rsql('CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END')} AS precision,
  {rsql('CASE WHEN support > 0 THEN hits / support ELSE 0 END')} AS recall, {rsql('CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END')} AS f1 FROM t LEFT JOIN lb USING (label)"""))
def _(spark, d):
    out = ag.multiclass_per_class(ag.label_pairs(labelled_docs(spark, d), "label_a", "label_b"), intent.TAXONOMY)
    return out.withColumns({c: rnd(c) for c in ("precision", "recall", "f1")})


@query("d33_macro_f1", with_views("lab", _PAIR_SQL + f""", f AS (SELECT support, 2 * hits / (support + predicted)::DOUBLE AS f1 FROM lb)
  SELECT {rsql('(SELECT sum(f1) FROM f) / 8')} AS macro_f1, {rsql('(SELECT sum(f1 * support) / sum(support) FROM f)')} AS weighted_f1,
  {rsql('(SELECT avg(f1) FROM f WHERE support > 0)')} AS macro_f1_observed, {rsql(_PO)} AS accuracy FROM nn"""))
def _(spark, d):
    out = ag.multiclass_summary(ag.label_pairs(labelled_docs(spark, d), "label_a", "label_b"), intent.TAXONOMY)
    return out.select(*[rnd(c).alias(c) for c in ("macro_f1", "weighted_f1", "macro_f1_observed", "accuracy")])


@query("g3_missing_classes", with_views("lab", f" SELECT * FROM (VALUES {_TAX}) v(label_b) EXCEPT SELECT label_b FROM lab"))
def _(spark, d):
    return ag.missing_classes(labelled_docs(spark, d), "label_b")


_BATCH_SQL = """, cb AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS queue_id, text, CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 11 = 0 THEN 'nonsense' ELSE label_a END AS human_label,
    CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'ann1' END AS annotator_id FROM lab UNION ALL
    SELECT doc_id, CAST(doc_id AS VARCHAR), text, label_b, CASE WHEN doc_id % 17 = 0 THEN 'ann1' ELSE 'ann2' END FROM lab),
  kn AS (SELECT CAST(doc_id AS VARCHAR) AS queue_id, 'pool' AS pool_path FROM documents WHERE source <> 'src3'),
  co AS (SELECT DISTINCT """ + TEXT_KEY_SQL.format("text") + """ AS tk FROM documents WHERE source = 'src5'),
  ck AS (SELECT *, annotator_id = '' AS p1, human_label NOT IN ('high_intent', 'general_discussion', 'confusion_barrier') AS p2, queue_id NOT IN (SELECT queue_id FROM kn) AS p3,
    """ + TEXT_KEY_SQL.format("text") + """ IN (SELECT tk FROM co) AS p4, count(*) OVER (PARTITION BY queue_id, annotator_id) > 1 AS p5 FROM cb WHERE trim(human_label) <> '')"""


def _batch(spark, d):
    lab = labelled_docs(spark, d)
    qid = F.col("doc_id").cast("string").alias("queue_id")
    one = lab.select(qid, "text", F.when(F.col("doc_id") % 7 == 0, " ").when(F.col("doc_id") % 11 == 0, "nonsense").otherwise(F.col("label_a")).alias("human_label"),
                     F.when(F.col("doc_id") % 13 == 0, "").otherwise("ann1").alias("annotator_id"))
    two = lab.select(qid, "text", F.col("label_b").alias("human_label"), F.when(F.col("doc_id") % 17 == 0, "ann1").otherwise("ann2").alias("annotator_id"))
    docs = table(spark, d, "documents")
    provenance = docs.filter("source <> 'src3'").select(qid, F.lit("pool").alias("pool_path"))
    completed = one.unionByName(two)
    return completed, ag.batch_checks(completed, provenance, docs.filter("source = 'src5'"))


@query("d22_batch_summary", with_views("lab", _BATCH_SQL + """ SELECT (SELECT count(*) FROM cb) AS rows_received, (SELECT count(*) FROM cb WHERE trim(human_label) = '') AS unlabelled_rows,
  count(*) FILTER (NOT (p1 OR p2 OR p3 OR p4 OR p5)) AS rows_accepted, count(*) FILTER (p1) AS missing_annotator_id, count(*) FILTER (p2) AS label_not_in_taxonomy, 0::BIGINT AS secondary_not_in_taxonomy,
  count(*) FILTER (p3) AS unknown_queue_id, count(*) FILTER (p4) AS already_in_corpus, count(*) FILTER (p5) AS duplicate_queue_id_per_annotator FROM ck"""))
def _(spark, d):
    return ag.batch_summary(*_batch(spark, d))


@query("d22_accepted_labels", with_views("lab", _BATCH_SQL + " SELECT human_label AS label, count(*) AS n FROM ck WHERE NOT (p1 OR p2 OR p3 OR p4 OR p5) GROUP BY 1"))
def _(spark, d):
    return ag.accepted_counts(_batch(spark, d)[1])


@query("c11_batch_provenance", with_views("lab", _BATCH_SQL + " SELECT ck.queue_id, annotator_id, human_label, pool_path FROM ck LEFT JOIN kn USING (queue_id) WHERE NOT (p1 OR p2 OR p3 OR p4 OR p5)"))
def _(spark, d):
    return _batch(spark, d)[1].filter("NOT rejected").select("queue_id", "annotator_id", "human_label", "pool_path")


@query("d23_annotator_pairs", with_views("lab", _BATCH_SQL + f""", ok AS (SELECT * FROM ck WHERE NOT (p1 OR p2 OR p3 OR p4 OR p5)),
  q AS (SELECT queue_id, max(human_label) FILTER (annotator_id = 'ann1') AS a, max(human_label) FILTER (annotator_id = 'ann2') AS b FROM ok GROUP BY 1 HAVING count(*) = 2)
  SELECT count(*) AS n, {rsql('avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END)')} AS raw_agreement FROM q"""))
def _(spark, d):
    pairs = ag.first_two_annotations(_batch(spark, d)[1].filter("NOT rejected"), "queue_id", "annotator_id", "human_label")
    return ag.agreement(ag.label_pairs(pairs, "label_a", "label_b")).select("n", rnd("raw_agreement").alias("raw_agreement"))


_RULES_SQL = f", pl AS (SELECT *, {intent_sql('text')[0]} AS plain FROM lab), rl AS (SELECT * EXCLUDE (plain), {intent_sql('text')[1]} AS rule_label FROM pl)"


@query("c21_rule_alignment", with_views("lab", _RULES_SQL + " SELECT record_id, label_a AS true_label, label_b AS model_label, rule_label FROM rl"))
def _(spark, d):
    lab = labelled_docs(spark, d)
    rules = lab.select("record_id", intent.intent_label(F.col("text")).alias("rule_label"))
    return ag.align_predictions(lab.select("record_id", F.col("label_a").alias("true_label"), F.col("label_b").alias("model_label")), rules)


@query("d37_rule_model_summary", with_views("lab", _RULES_SQL + f""" SELECT count(*) AS rows, {rsql('avg(CASE WHEN label_b = rule_label THEN 1.0 ELSE 0.0 END)')} AS agreement_rate, {rsql('avg(CASE WHEN label_b <> rule_label THEN 1.0 ELSE 0.0 END)')} AS disagreement_rate,
  count(*) FILTER (rule_label = label_a AND label_b = label_a) AS both_correct, count(*) FILTER (rule_label <> label_a AND label_b <> label_a) AS both_wrong,
  count(*) FILTER (rule_label = label_a AND label_b <> label_a) AS rule_correct_model_wrong, count(*) FILTER (rule_label <> label_a AND label_b = label_a) AS model_correct_rule_wrong FROM rl"""))
def _(spark, d):
    rows = labelled_docs(spark, d).withColumn("rule_label", intent.intent_label(F.col("text")))
    out = ag.rule_model_summary(rows, "label_a", "label_b", "rule_label")
    return out.withColumns({c: rnd(c) for c in ("agreement_rate", "disagreement_rate")})


@query("d37_disagreements_by_class", with_views("lab", _RULES_SQL + " SELECT label_a, count(*) AS n FROM rl WHERE label_b <> rule_label GROUP BY 1"))
def _(spark, d):
    rows = labelled_docs(spark, d).withColumn("rule_label", intent.intent_label(F.col("text")))
    return ag.disagreements_by_class(rows, "label_a", "label_b", "rule_label")


_AUDIT = ", au AS (SELECT label_b AS intent_label, CASE WHEN doc_id % 9 = 0 THEN '' ELSE label_a END AS manual_label, CASE WHEN label_b = 'general_discussion' THEN 'recall' ELSE 'precision' END AS sample_type FROM lab), rv AS (SELECT * FROM au WHERE manual_label <> '')"


def _audit(spark, d):
    return labelled_docs(spark, d).select(
        F.col("label_b").alias("intent_label"), F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("label_a")).alias("manual_label"),
        F.when(F.col("label_b") == "general_discussion", "recall").otherwise("precision").alias("sample_type"))


@query("d38_audit_summary", with_views("lab", _AUDIT + f" SELECT sample_type, count(*) AS total_reviewed_rows, count(*) FILTER (manual_label <> intent_label) AS misclassification_count, {rsql('avg(CASE WHEN manual_label <> intent_label THEN 1.0 ELSE 0.0 END)')} AS misclassification_rate FROM rv GROUP BY 1"))
def _(spark, d):
    return ag.audit_summary(_audit(spark, d)).withColumn("misclassification_rate", rnd("misclassification_rate"))


@query("d38_audit_precision", with_views("lab", _AUDIT + f" SELECT intent_label, count(*) AS total_predictions, count(*) FILTER (manual_label = intent_label) AS correct_predictions, {rsql('avg(CASE WHEN manual_label = intent_label THEN 1.0 ELSE 0.0 END)')} AS precision FROM rv WHERE sample_type = 'precision' GROUP BY 1"))
def _(spark, d):
    return ag.audit_precision(_audit(spark, d)).withColumn("precision", rnd("precision"))


@query("d38_audit_confusion", with_views("lab", _AUDIT + " SELECT sample_type, intent_label AS a, manual_label AS b, count(*) AS n FROM rv GROUP BY 1, 2, 3"))
def _(spark, d):
    return ag.label_pairs(ag.reviewed_rows(_audit(spark, d)), "intent_label", "manual_label", ["sample_type"])


# --- splits and samples ----------------------------------------------------------------

@query("h1_sample_per_class", with_views("sig lsig", " SELECT id, intent_label FROM (SELECT *, row_number() OVER (PARTITION BY intent_label ORDER BY md5(id || '-42'), id) AS r FROM lsig) WHERE r <= 60"))
def _(spark, d):
    return sp.sample_per_class(labelled_signals(spark, d), "intent_label", "id").select("id", "intent_label")


_H2 = ", r AS (SELECT *, row_number() OVER (PARTITION BY intent_label ORDER BY md5(id || '-42'), id) AS r FROM lsig), s AS (SELECT *, CASE WHEN intent_label = 'general_discussion' THEN 80 ELSE 25 END AS q FROM r)"


@query("h2_audit_sample", with_views("sig lsig", _H2 + " SELECT id, intent_label, CASE WHEN intent_label = 'general_discussion' THEN 'recall' ELSE 'precision' END AS sample_type FROM s WHERE r <= q"))
def _(spark, d):
    return sp.audit_sample(labelled_signals(spark, d), "id", 80, 25).select("id", "intent_label", "sample_type")


@query("h2_audit_shortage", with_views("sig lsig", _H2 + " SELECT intent_label, any_value(q) AS requested, count(*) AS available, count(*) FILTER (r <= q) AS selected, any_value(q) > count(*) AS short FROM s GROUP BY 1"))
def _(spark, d):
    rows = labelled_signals(spark, d)
    return sp.audit_shortage(rows, sp.audit_sample(rows, "id", 80, 25), 80, 25)


@query("c22_patch_missing_classes", """WITH s AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'high_intent' ELSE 'general_discussion' END AS intent_label FROM documents)
  SELECT doc_id, intent_label FROM s UNION ALL SELECT doc_id, 'confusion_barrier' FROM labels WHERE toxic = 1""")
def _(spark, d):
    sample = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "high_intent").otherwise("general_discussion").alias("intent_label"))
    audited = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "confusion_barrier").when(F.col("quality") == 1, "high_intent").otherwise("general_discussion").alias("corrected_label"))
    return sp.patch_missing_classes(sample, audited, "intent_label", "corrected_label").select("doc_id", "intent_label")


_GROUP_SQL = """WITH g AS (SELECT source AS group_key, count(*) AS n, md5(source || '-42') AS o FROM documents GROUP BY 1),
  c AS (SELECT group_key, (sum(n) OVER (ORDER BY o) - n / 2.0) / sum(n) OVER () AS m FROM g),
  st AS (SELECT group_key, CASE WHEN m < 0.7 THEN 'train' WHEN m < 0.85 THEN 'validation' ELSE 'test' END AS split FROM c)"""
_FOLD_SQL = "CAST(('0x' || substr(md5(source || '-42'), 1, 8))::BIGINT % 5 AS INTEGER)"


def doc_rows(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("record_id"), F.col("source").alias("parent_id"), "text", "lang", "doc_id")


@query("h3_group_split", _GROUP_SQL + " SELECT CAST(doc_id AS VARCHAR) AS record_id, split FROM documents JOIN st ON st.group_key = source")
def _(spark, d):
    return sp.group_split(doc_rows(spark, d)).select("record_id", "split")


@query("h3_hashed_split", """SELECT doc_id, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT doc_id, ('0x' || substr(md5(source || '-42'), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents)""")
def _(spark, d):
    return sp.hashed_group_split(doc_rows(spark, d), group="parent_id").select("doc_id", "split")


@query("h4_effective_groups", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'row:' || doc_id ELSE source END AS group_key, lang = 'de' AS used_fallback FROM documents")
def _(spark, d):
    rows = doc_rows(spark, d).withColumn("parent_id", F.when(F.col("lang") != "de", F.col("parent_id")))
    return sp.effective_groups(rows).select("doc_id", "group_key", "used_fallback")


@query("h5_temporal_split", with_views("ev", ", r AS (SELECT event_id, row_number() OVER (ORDER BY date_trunc('hour', ts), event_id) - 1 AS p, count(*) OVER () AS n FROM ev) SELECT event_id, CASE WHEN p < floor(n * 0.7) THEN 'train' WHEN p < floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM r"))
def _(spark, d):
    rows = events(spark, d).withColumn("created_at", F.date_trunc("hour", "ts"))
    return sp.temporal_split(rows, "created_at", "event_id").select("event_id", "split")


@query("h6_split_manifest", _GROUP_SQL + " SELECT split, count(*) AS rows, count(DISTINCT source) AS groups, 42 AS seed, 'group_holdout' AS evaluation_mode FROM documents JOIN st ON st.group_key = source GROUP BY 1")
def _(spark, d):
    return sp.split_manifest(sp.group_split(doc_rows(spark, d)))


@query("h7_group_folds", f"SELECT DISTINCT source AS group_key, {_FOLD_SQL} AS fold FROM documents")
def _(spark, d):
    return sp.group_folds(sp.effective_groups(doc_rows(spark, d)))


@query("h8_fold_split", f"""WITH fo AS (SELECT DISTINCT source, {_FOLD_SQL} AS fold FROM documents),
  dd AS (SELECT * FROM documents JOIN fo USING (source)),""" + _GROUP_SQL.removeprefix("WITH ").replace("FROM documents GROUP BY 1", "FROM dd WHERE fold <> 0 GROUP BY 1") + """
  SELECT doc_id, CASE WHEN fold = 0 THEN 'held_out' WHEN split = 'validation' THEN 'validation' ELSE 'train' END AS split FROM dd LEFT JOIN st ON st.group_key = source""")
def _(spark, d):
    rows = sp.effective_groups(doc_rows(spark, d))
    return sp.fold_split(rows.join(sp.group_folds(rows), "group_key"), 0).select("doc_id", "split")


@query("c12_leakage", _GROUP_SQL + f""", w AS (SELECT {DOC_TEXT} AS t, split FROM documents JOIN st ON st.group_key = source), dd AS (SELECT DISTINCT t, split FROM w)
  SELECT 'text' AS kind, a.split AS first, b.split AS second, count(*) AS shared FROM dd a JOIN dd b ON a.t = b.t AND a.split < b.split GROUP BY 1, 2, 3""")
def _(spark, d):
    return sp.leakage(sp.group_split(doc_rows(spark, d)))


@query("d24_split_support", _GROUP_SQL + """ SELECT 42 AS seed, count(*) AS test_rows, count(DISTINCT source) AS test_groups, """ + ", ".join(
    f"count(*) FILTER (lang = '{'en' if c == 'high_intent' else 'fr' if c == 'general_discussion' else '-'}') AS {c}" for c in intent.TAXONOMY) + " FROM documents JOIN st ON st.group_key = source WHERE split = 'test'")
def _(spark, d):
    rows = doc_rows(spark, d).withColumn("label", F.when(F.col("lang") == "en", "high_intent").when(F.col("lang") == "fr", "general_discussion").otherwise("other"))
    return sp.split_support(rows, [42], "label")


@query("d24_zero_support", f"""WITH seeds(seed) AS (VALUES (42), (43), (44)),
  g AS (SELECT seed, source, count(*) AS n, md5(source || '-' || seed) AS o FROM documents, seeds GROUP BY 1, 2),
  c AS (SELECT seed, source, (sum(n) OVER (PARTITION BY seed ORDER BY o) - n / 2.0) / sum(n) OVER (PARTITION BY seed) AS m FROM g),
  k AS (SELECT seed, CASE WHEN lang = 'en' THEN 'high_intent' ELSE 'general_discussion' END AS label, count(*) AS n FROM documents JOIN c USING (source) WHERE m >= 0.85 GROUP BY 1, 2),
  l AS (SELECT unnest({list(intent.TAXONOMY)!r}) AS label)
  SELECT label, count(*) FILTER (n IS NULL) AS seeds_with_zero_support FROM l CROSS JOIN seeds LEFT JOIN k USING (label, seed) GROUP BY 1""")
def _(spark, d):
    rows = doc_rows(spark, d).withColumn("label", F.when(F.col("lang") == "en", "high_intent").otherwise("general_discussion"))
    return sp.zero_support(sp.split_support(rows, [42, 43, 44], "label"))


# --- near-duplicates and drift -------------------------------------------------------------

def _gram_sql(source: str, key: str) -> str:
    """Distinct texts of ``source (doc, text)``, their gram weights and norms."""
    return f""", tx AS (SELECT {key}, min(doc) AS doc, count(*) AS copies, arg_min(text, doc) AS text FROM {source} GROUP BY 1),
  wd AS (SELECT doc, copies, ' ' || unnest(string_split(trim(regexp_replace(replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's'), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')), ' ')) || ' ' AS w FROM tx),
  gr AS (SELECT doc, copies, substr(w, CAST(i AS INTEGER), n) AS g FROM (SELECT *, unnest(generate_series(1, length(w) - n + 1)) AS i FROM wd, (VALUES (3), (4), (5)) s(n) WHERE length(w) >= n AND length(w) > 2)),
  tf AS (SELECT doc, any_value(copies) AS copies, g, count(*) AS tf FROM gr GROUP BY doc, g),
  df AS (SELECT g, sum(copies) AS df FROM tf GROUP BY 1), nd AS (SELECT sum(copies) AS n FROM tx),
  rw AS (SELECT doc, tf.g, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS r FROM tf JOIN df USING (g), nd),
  wt AS (SELECT doc, g, r / sqrt(sum(r * r) OVER (PARTITION BY doc)) AS w FROM rw)"""


_HASH = "sha256(replace(replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')) AS h"


@query("c13_near_duplicates", with_views("lab", ", src AS (SELECT record_id AS doc, text, parent_id, label_a FROM lab)" + _gram_sql("src", _HASH) + """,
  att AS (SELECT min(record_id) AS doc, count(*) AS copies, min(parent_id) AS g0, max(parent_id) AS g1, min(label_a) AS l0, max(label_a) AS l1 FROM (SELECT *, """ + _HASH + """ FROM lab) GROUP BY h),
  cs AS (SELECT a.doc AS da, b.doc AS db, sum(a.w * b.w) AS s FROM wt a JOIN wt b ON a.g = b.g AND a.doc < b.doc GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.8)
  SELECT da AS record_id_a, db AS record_id_b, x.copies AS copies_a, y.copies AS copies_b, round(s, 3) AS similarity,
    NOT (x.g0 = x.g1 AND y.g0 = y.g1 AND x.g0 = y.g0) AS crosses_groups, NOT (x.l0 = x.l1 AND y.l0 = y.l1 AND x.l0 = y.l0) AS labels_differ
  FROM cs JOIN att x ON x.doc = da JOIN att y ON y.doc = db"""))
def _(spark, d):
    return ve.near_duplicate_pairs(corpus(spark, d), "record_id", "parent_id", "corrected_label")


@query("c13_near_duplicate_groups", "WITH RECURSIVE " + with_views("lab", ", src AS (SELECT record_id AS doc, text, parent_id, label_a FROM lab)" + _gram_sql("src", _HASH) + """,
  cs AS (SELECT a.doc AS da, b.doc AS db FROM wt a JOIN wt b ON a.g = b.g AND a.doc < b.doc GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.8),
  ed AS MATERIALIZED (SELECT da AS x, db AS y FROM cs UNION SELECT db, da FROM cs UNION SELECT doc, doc FROM tx),
  rc AS (SELECT x, y FROM ed UNION SELECT rc.x, ed.y FROM rc JOIN ed ON rc.y = ed.x),
  co AS (SELECT x AS doc, min(y) AS root FROM rc GROUP BY 1), hs AS (SELECT *, """ + _HASH + """ FROM lab),
  mb AS (SELECT hs.record_id, hs.parent_id, hs.label_a, co.root FROM hs JOIN tx USING (h) JOIN co ON co.doc = tx.doc),
  st AS (SELECT root, min(record_id) AS group_id, count(*) AS n_rows, count(DISTINCT parent_id) > 1 AS crosses_groups, count(DISTINCT label_a) > 1 AS labels_differ FROM mb GROUP BY 1),
  nt AS (SELECT root, count(*) AS n_texts FROM co GROUP BY 1)
  SELECT record_id, group_id, n_rows, n_texts, crosses_groups, labels_differ FROM mb JOIN st USING (root) JOIN nt USING (root)""").removeprefix("WITH "))
def _(spark, d):
    return nb.near_duplicate_groups(corpus(spark, d), "record_id", "parent_id", "corrected_label")


@query("c13_copy_groups", f"WITH k AS (SELECT doc_id, {_HASH} FROM documents), g AS (SELECT h, min(doc_id) AS representative, count(*) AS copies FROM k GROUP BY 1 HAVING count(*) > 1) SELECT doc_id AS record_id, representative, copies FROM k JOIN g USING (h)")
def _(spark, d):
    return ve.copy_groups(table(spark, d, "documents"), "doc_id")


_C14 = """WITH src AS (SELECT 'p' || doc_id AS doc, 0 AS side, text FROM documents UNION ALL SELECT 'r' || item_id, 1, text FROM benchmark)""" + _gram_sql("src", _HASH + ", side").replace("GROUP BY 1)", "GROUP BY h, side)", 1) + f""",
  cs AS (SELECT a.doc FROM wt a JOIN wt b ON a.g = b.g AND a.doc[1] = 'p' AND b.doc[1] = 'r' GROUP BY a.doc, b.doc HAVING sum(a.w * b.w) >= 0.8),
  hh AS (SELECT h FROM tx WHERE doc IN (SELECT doc FROM cs)) SELECT doc_id FROM (SELECT doc_id, {_HASH} FROM documents) WHERE h IN (SELECT h FROM hh)"""


@query("c14_near_duplicate_semi", _C14)
def _(spark, d):
    return nb.near_duplicates_of(table(spark, d, "documents"), "doc_id", table(spark, d, "benchmark"), "item_id")


@query("d39_prevalence_shift", with_views("lab", f", s AS (SELECT sample_strategy, label_b, count(*) / sum(count(*)) OVER (PARTITION BY sample_strategy) AS p FROM lab WHERE sample_strategy IN ('en', 'fr') GROUP BY 1, 2) SELECT label_b, {rsql('''coalesce(sum(p) FILTER (sample_strategy = 'en'), 0) - coalesce(sum(p) FILTER (sample_strategy = 'fr'), 0)''', 4)} AS shift FROM s GROUP BY 1"))
def _(spark, d):
    return ve.prevalence_shift(labelled_docs(spark, d), "sample_strategy", "label_b", "en", "fr").select("label_b", rnd("shift", 4).alias("shift"))


@query("d39_length_profile", f"SELECT lang, count(*) AS rows, {rsql('avg(length(text))')} AS mean_length, {rsql('median(length(text))')} AS median_length FROM documents GROUP BY 1")
def _(spark, d):
    return ve.length_profile(table(spark, d, "documents"), "lang").select("lang", "rows", rnd("mean_length").alias("mean_length"), rnd("median_length").alias("median_length"))


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]{2,}')"
_VOC = f"WITH tk AS (SELECT lang, unnest({_WORDS}) AS term FROM documents), vc AS (SELECT lang, term, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS r FROM tk GROUP BY 1, 2)"


@query("d41_top_vocabulary", _VOC + " SELECT lang, term, n FROM vc WHERE r <= 200")
def _(spark, d):
    return ve.top_vocabulary(table(spark, d, "documents"), "lang")


@query("g4_vocabulary_overlap", _VOC + f", t AS (SELECT term, count(DISTINCT lang) AS c FROM vc WHERE r <= 200 AND lang IN ('fr', 'es') GROUP BY 1) SELECT count(*) FILTER (c = 2) AS shared_terms, count(*) AS all_terms, {rsql('count(*) FILTER (c = 2) / count(*)::DOUBLE')} AS vocabulary_jaccard FROM t")
def _(spark, d):
    out = ve.vocabulary_overlap(ve.top_vocabulary(table(spark, d, "documents"), "lang"), "lang", "fr", "es")
    return out.withColumn("vocabulary_jaccard", rnd("vocabulary_jaccard"))


_CENT = f""", dk AS (SELECT doc_id, lang, unnest({_WORDS}) AS term FROM documents WHERE lang IN ('fr', 'es')), ct AS (SELECT doc_id, any_value(lang) AS lang, term, count(*) AS tf FROM dk GROUP BY doc_id, term),
  dfr AS (SELECT term, count(*) AS df FROM ct GROUP BY 1), nn AS (SELECT count(*) AS n, count(*) FILTER (lang = 'fr') AS na, count(*) FILTER (lang = 'es') AS nb FROM documents WHERE lang IN ('fr', 'es')),
  rr AS (SELECT doc_id, lang, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS r FROM ct JOIN dfr USING (term), nn),
  ww AS (SELECT lang, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS w FROM rr),
  cc AS (SELECT term, coalesce(sum(w) FILTER (lang = 'fr'), 0) / any_value(na) AS x, coalesce(sum(w) FILTER (lang = 'es'), 0) / any_value(nb) AS y FROM ww, nn GROUP BY 1)"""


@query("d42_centroid_distance", _VOC + _CENT + f" SELECT {rsql('1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))')} AS distance FROM cc")
def _(spark, d):
    out = ve.centroid_distance(table(spark, d, "documents"), "doc_id", "lang", "fr", "es")
    return out.select(rnd("tfidf_centroid_cosine_distance").alias("distance"))


@query("j25_slice_shift")
def _(spark, d):
    rows = labelled_docs(spark, d)
    out = ve.slice_shift(rows, "record_id", "sample_strategy", "label_b", "en", "fr")
    doubles = [c for c, t in out.dtypes if t == "double"]
    return out.withColumns({c: rnd(c) for c in doubles})


@query("j25_drift_report", with_views("lab", f""", ms AS (SELECT 'lang' AS dimension, sample_strategy AS slice, * FROM lab UNION ALL SELECT 'source', parent_id, * FROM lab),
  sl AS (SELECT dimension, slice, count(*) AS n, avg(length(text)) AS ml, median(length(text)) AS md FROM ms WHERE slice IS NOT NULL GROUP BY 1, 2),
  pr AS (SELECT a.dimension, a.slice AS sa, b.slice AS sb, a.n AS na, b.n AS nb, a.ml AS la, b.ml AS lb, a.md AS ma, b.md AS mb FROM sl a JOIN sl b ON a.dimension = b.dimension AND a.slice < b.slice),
  sh AS (SELECT dimension, slice, label_b, count(*) / sum(count(*)) OVER (PARTITION BY dimension, slice) AS p FROM ms GROUP BY 1, 2, 3),
  lv AS (SELECT DISTINCT label_b FROM lab),
  sx AS (SELECT pr.dimension, sa, sb, max(abs(round(coalesce(x.p, 0) - coalesce(y.p, 0), 4))) AS shift FROM pr CROSS JOIN lv LEFT JOIN sh x ON x.dimension = pr.dimension AND x.slice = sa AND x.label_b = lv.label_b
    LEFT JOIN sh y ON y.dimension = pr.dimension AND y.slice = sb AND y.label_b = lv.label_b GROUP BY 1, 2, 3),
  ct AS (SELECT dimension, slice, doc_id, term, count(*) AS tf FROM (SELECT dimension, slice, doc_id, unnest({_WORDS}) AS term FROM ms) GROUP BY ALL),
  st AS (SELECT dimension, slice, term, sum(tf) AS uses, count(*) AS df FROM ct GROUP BY 1, 2, 3),
  tp AS (SELECT dimension, slice, term FROM st QUALIFY row_number() OVER (PARTITION BY dimension, slice ORDER BY uses DESC, term) <= 200),
  jc AS (SELECT dimension, sa, sb, count(*) FILTER (k = 2) / count(*)::DOUBLE AS j FROM (SELECT pr.dimension, sa, sb, term, count(*) AS k FROM pr JOIN tp ON tp.dimension = pr.dimension AND tp.slice IN (sa, sb) GROUP BY ALL) GROUP BY 1, 2, 3),
  dp AS (SELECT pr.dimension, sa, sb, term, sum(df) AS df FROM pr JOIN st ON st.dimension = pr.dimension AND st.slice IN (sa, sb) GROUP BY ALL),
  rw AS (SELECT pr.dimension, pr.sa, pr.sb, ct.slice = pr.sa AS one, doc_id, ct.term, tf * (ln((1 + na + nb) / (1 + df)::DOUBLE) + 1) AS r FROM pr JOIN ct ON ct.dimension = pr.dimension AND ct.slice IN (pr.sa, pr.sb)
    JOIN dp ON dp.dimension = pr.dimension AND dp.sa = pr.sa AND dp.sb = pr.sb AND dp.term = ct.term),
  ww AS (SELECT *, r / sqrt(sum(r * r) OVER (PARTITION BY dimension, sa, sb, doc_id)) AS w FROM rw),
  ce AS (SELECT dimension, sa, sb, term, coalesce(sum(w) FILTER (one), 0) AS x, coalesce(sum(w) FILTER (NOT one), 0) AS y FROM ww GROUP BY ALL),
  ds AS (SELECT dimension, sa, sb, 1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS dist FROM ce GROUP BY ALL)
  SELECT dimension, sa AS slice_a, sb AS slice_b, na AS rows_a, nb AS rows_b, {rsql('la')} AS mean_length_a, {rsql('lb')} AS mean_length_b, {rsql('ma')} AS median_length_a, {rsql('mb')} AS median_length_b,
    {rsql('shift')} AS max_prevalence_shift, {rsql('j')} AS vocabulary_jaccard, {rsql('dist')} AS tfidf_centroid_cosine_distance, least(na, nb) < 30 AS small_sample
  FROM pr JOIN sx USING (dimension, sa, sb) JOIN jc USING (dimension, sa, sb) JOIN ds USING (dimension, sa, sb)"""))
def _(spark, d):
    rows = labelled_docs(spark, d).withColumnsRenamed({"sample_strategy": "lang", "parent_id": "source"})
    out = drift.drift_report(rows, "record_id", "label_b", ["lang", "source"])
    return out.withColumns({c: rnd(c) for c, t in out.dtypes if t == "double"})


@query("j25_split_drift")
def _(spark, d):
    rows = sp.group_split(corpus(spark, d))
    out = drift.drift_report(rows, "record_id", "corrected_label", ["split"], drift.split_pairs(rows))
    return out.withColumns({c: rnd(c) for c, t in out.dtypes if t == "double"})


# --- queues and provenance -------------------------------------------------------------------

_KEY = TEXT_KEY_SQL.format("text")
_POOL_SQL = f""", pool AS (SELECT doc_id, source, text, {_KEY} AS tk FROM documents), lt AS (SELECT DISTINCT {_KEY} AS tk FROM lab WHERE toxic = 1),
  rs AS (SELECT *, CASE WHEN trim(text) = '' THEN 'empty_text' WHEN tk IN (SELECT tk FROM lt) THEN 'already_labelled'
    WHEN row_number() OVER (PARTITION BY tk ORDER BY doc_id) > 1 THEN 'duplicate_in_pool' END AS reason FROM pool)"""


def _pool_reasons(spark, d, near=False):
    toxic = labelled_docs(spark, d).filter("toxic = 1")
    return qu.pool_reasons(table(spark, d, "documents"), toxic, "doc_id", near)


@query("b15_pool_reasons", with_views("lab", _POOL_SQL + " SELECT coalesce(reason, 'eligible') AS reason, count(*) AS rows FROM rs GROUP BY 1"))
def _(spark, d):
    return qu.reason_counts(_pool_reasons(spark, d))


@query("b15_eligible_pool_full", with_views("lab", _POOL_SQL + ", src AS (SELECT 'p' || doc_id AS doc, 0 AS side, text FROM rs WHERE reason IS NULL UNION ALL SELECT 'r' || doc_id, 1, text FROM lab WHERE toxic = 1)"
  + _gram_sql("src", _HASH + ", side").replace("GROUP BY 1)", "GROUP BY h, side)", 1) + f""",
  cs AS (SELECT a.doc FROM wt a JOIN wt b ON a.g = b.g AND a.doc[1] = 'p' AND b.doc[1] = 'r' GROUP BY a.doc, b.doc HAVING sum(a.w * b.w) >= 0.8),
  hh AS (SELECT h FROM tx WHERE doc IN (SELECT doc FROM cs))
  SELECT coalesce(reason, CASE WHEN h IN (SELECT h FROM hh) THEN 'near_duplicate_of_labelled' ELSE 'eligible' END) AS reason, count(*) AS rows
  FROM (SELECT reason, {_HASH} FROM rs) GROUP BY 1"""))
def _(spark, d):
    return qu.reason_counts(_pool_reasons(spark, d, near=True))


@query("c7_unlabelled", f"WITH k AS (SELECT doc_id, {_KEY} AS tk FROM documents) SELECT doc_id FROM k WHERE tk NOT IN (SELECT tk FROM k JOIN labels USING (doc_id))")
def _(spark, d):
    return qu.unlabelled(table(spark, d, "documents"), labelled_docs(spark, d)).select("doc_id")


@query("c16_unseen_groups", "SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def _(spark, d):
    pool = table(spark, d, "documents").withColumn("group_key", F.col("source"))
    return qu.unseen_groups(pool, labelled_docs(spark, d).filter("toxic = 1")).select("doc_id")


_QUEUE_SQL = """, sc AS (SELECT id AS queue_id, CASE WHEN k % 5 = 0 THEN 'Reddit' ELSE 'youtube' END AS source, 'g' || parent_id AS group_key, intent_label AS rule_label,
    CASE WHEN k % 4 = 0 THEN 'general_discussion' ELSE intent_label END AS model_label, k / 100.0::DOUBLE AS p, 0.5::DOUBLE AS t FROM lsig),
  cor AS (SELECT label_b AS lb, 'g' || user_id AS grp FROM lab JOIN events ON event_id = doc_id),
  ra AS (SELECT label FROM (VALUES """ + _TAX + """) v(label) LEFT JOIN cor ON lb = label GROUP BY 1 HAVING count(lb) < 10),
  m AS (SELECT *, rule_label IN (SELECT label FROM ra) AS f1, lower(source) = 'reddit' AS f2, group_key NOT IN (SELECT grp FROM cor) AS f3,
    rule_label <> model_label OR abs(p - t) < 0.1 AS f4, rule_label <> model_label AS rm, format('{:.12f}', abs(p - t)) AS dist FROM sc),
  q1 AS (SELECT *, 'random_control' AS stratum FROM m ORDER BY md5(queue_id || '-random_control-42'), queue_id LIMIT 25),
  q2 AS (SELECT *, 'missing_class_candidate' AS stratum FROM m WHERE f1 AND queue_id NOT IN (SELECT queue_id FROM q1) ORDER BY md5(queue_id || '-missing_class_candidate-42'), queue_id LIMIT 40),
  q3 AS (SELECT *, 'reddit' AS stratum FROM m WHERE f2 AND queue_id NOT IN (SELECT queue_id FROM q1 UNION SELECT queue_id FROM q2) ORDER BY md5(queue_id || '-reddit-42'), queue_id LIMIT 30),
  q4 AS (SELECT *, 'unseen_group' AS stratum FROM m WHERE f3 AND queue_id NOT IN (SELECT queue_id FROM q1 UNION SELECT queue_id FROM q2 UNION SELECT queue_id FROM q3) ORDER BY md5(queue_id || '-unseen_group-42'), queue_id LIMIT 25),
  q5 AS (SELECT *, 'model_disagreement' AS stratum FROM m WHERE f4 AND queue_id NOT IN (SELECT queue_id FROM q1 UNION SELECT queue_id FROM q2 UNION SELECT queue_id FROM q3 UNION SELECT queue_id FROM q4)
    ORDER BY dist || '|' || md5(queue_id || '-model_disagreement-42'), queue_id LIMIT 30),
  qq AS (SELECT * FROM q1 UNION ALL SELECT * FROM q2 UNION ALL SELECT * FROM q3 UNION ALL SELECT * FROM q4 UNION ALL SELECT * FROM q5)"""


def _strata(spark, d):
    sig = labelled_signals(spark, d)
    scored = sig.select(
        F.col("id").alias("queue_id"), "text", F.when(F.col("k") % 5 == 0, "Reddit").otherwise("youtube").alias("source"),
        F.concat(F.lit("g"), "parent_id").alias("group_key"), F.col("intent_label").alias("rule_label"),
        F.when(F.col("k") % 4 == 0, "general_discussion").otherwise(F.col("intent_label")).alias("model_label"),
        (F.col("k") / F.lit(100.0)).alias("model_probability"), F.lit(0.5).alias("model_threshold"))
    users = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.concat(F.lit("g"), "user_id").alias("parent_id"))
    known = labelled_docs(spark, d).select("doc_id", F.col("label_b").alias("corrected_label")).join(users, "doc_id")
    return qu.with_strata(scored, known)


@query("h12_strata", with_views("sig lsig lab", _QUEUE_SQL + " SELECT queue_id, f1 AS missing_class_candidate, f2 AS reddit, f3 AS unseen_group, f4 AS model_disagreement FROM m"))
def _(spark, d):
    return _strata(spark, d).select("queue_id", qu.RARE, qu.REDDIT, qu.UNSEEN, qu.DISAGREEMENT)


@query("f7_quota_queue", with_views("sig lsig lab", _QUEUE_SQL + """ SELECT queue_id, stratum, CASE stratum WHEN 'random_control' THEN 'uniform random sample of the eligible pool' WHEN 'missing_class_candidate' THEN 'rule predicts rare class ' || rule_label
  WHEN 'reddit' THEN 'source is reddit' WHEN 'unseen_group' THEN 'group ' || group_key || ' not in labelled corpus' ELSE CASE WHEN rm THEN 'rule/model label disagreement' ELSE 'near decision threshold' END END AS stratum_reason FROM qq"""))
def _(spark, d):
    return qu.select_queue(_strata(spark, d))[0].select("queue_id", "stratum", "stratum_reason")


@query("h9_random_control", with_views("sig lsig lab", _QUEUE_SQL + " SELECT queue_id FROM q1"))
def _(spark, d):
    return qu.select_queue(_strata(spark, d))[0].filter(F.col("stratum") == qu.RANDOM).select("queue_id")


@query("h10_double_annotation", with_views("sig lsig lab", _QUEUE_SQL + " SELECT queue_id, row_number() OVER (ORDER BY md5(queue_id || '-double-42'), queue_id) <= (SELECT CAST(round_even(count(*) * 0.15, 0) AS BIGINT) FROM qq) AS double_annotate FROM qq"))
def _(spark, d):
    return qu.select_queue(_strata(spark, d))[0].select("queue_id", "double_annotate")


@query("h13_queue_report", with_views("sig lsig lab", _QUEUE_SQL + """, e AS (SELECT 'random_control' AS stratum, 25 AS quota, (SELECT count(*) FROM m) AS eligible UNION ALL
    SELECT 'missing_class_candidate', 40, (SELECT count(*) FROM m WHERE f1 AND queue_id NOT IN (SELECT queue_id FROM q1)) UNION ALL
    SELECT 'reddit', 30, (SELECT count(*) FROM m WHERE f2 AND queue_id NOT IN (SELECT queue_id FROM q1 UNION SELECT queue_id FROM q2)) UNION ALL
    SELECT 'unseen_group', 25, (SELECT count(*) FROM m WHERE f3 AND queue_id NOT IN (SELECT queue_id FROM q1 UNION SELECT queue_id FROM q2 UNION SELECT queue_id FROM q3)) UNION ALL
    SELECT 'model_disagreement', 30, (SELECT count(*) FROM m WHERE f4 AND queue_id NOT IN (SELECT queue_id FROM q1 UNION SELECT queue_id FROM q2 UNION SELECT queue_id FROM q3 UNION SELECT queue_id FROM q4)))
  SELECT stratum, quota::BIGINT AS quota, eligible, (SELECT count(*) FROM qq WHERE qq.stratum = e.stratum) AS selected, greatest(0, quota - (SELECT count(*) FROM qq WHERE qq.stratum = e.stratum)) AS shortfall FROM e"""))
def _(spark, d):
    return qu.select_queue(_strata(spark, d))[1]


@query("j23_blind_queue", with_views("sig lsig lab", _QUEUE_SQL + " SELECT queue_id, source, group_key AS parent_id, stratum, '' AS human_label, '' AS annotator_id FROM qq"))
def _(spark, d):
    queue = qu.select_queue(_strata(spark, d))[0].withColumns({"parent_id": F.col("group_key"), "pool_row": F.lit(0), "source_record_id": F.col("queue_id")})
    return qu.blind_files(queue, "pool", "hash")[0].select("queue_id", "source", "parent_id", "stratum", "human_label", "annotator_id")


@query("j24_review_template", with_views("lab", _RULES_SQL + " SELECT record_id, label_a AS current_label, rule_label, 'full_reaudit' AS selection_reason, '' AS reviewed_label FROM rl"))
def _(spark, d):
    return qu.review_template(corpus(spark, d)).select("record_id", "current_label", "rule_label", "selection_reason", "reviewed_label")


_LEARN_SQL = """, sc AS (SELECT doc_id, source, parent_id, intent_label AS rl, CASE WHEN k % 9 = 0 THEN 'general_discussion' ELSE intent_label END AS ml, k / 100.0::DOUBLE AS p FROM lsig),
  n AS (SELECT count(*) AS n FROM sc), mc AS (SELECT ml, count(*) AS c FROM sc GROUP BY 1), so AS (SELECT source, count(*) AS c FROM sc GROUP BY 1), gr AS (SELECT parent_id, count(*) AS c FROM sc GROUP BY 1),
  fl AS (SELECT sc.*, rl <> ml AS a, abs(p - 0.5) < 0.1 AS b, p > 0.85 AND rl <> ml AS cc, mc.c < greatest(3, n // 50) AS d, so.c < (SELECT max(c) FROM so) * 0.25 AS e, gr.c <= 2 AS f
    FROM sc JOIN mc USING (ml) JOIN so USING (source) JOIN gr USING (parent_id), n),
  pr AS (SELECT *, 1 - abs(p - 0.5) AS u, CASE WHEN a THEN 'rule_model_disagreement' WHEN b THEN 'near_decision_threshold' WHEN cc THEN 'confident_model_rule_disagreement' WHEN d THEN 'rare_predicted_class'
     WHEN e THEN 'underrepresented_source' WHEN f THEN 'underrepresented_group' ELSE '' END AS reason,
     greatest(0, CASE WHEN a THEN 6 ELSE 0 END, CASE WHEN b THEN 4 ELSE 0 END, CASE WHEN cc THEN 4.5 ELSE 0 END, CASE WHEN d THEN 3 ELSE 0 END, CASE WHEN e THEN 2 ELSE 0 END, CASE WHEN f THEN 1.5 ELSE 0 END) AS w FROM fl),
  top AS (SELECT doc_id, reason FROM pr WHERE reason <> '' ORDER BY w + u DESC, u DESC, doc_id LIMIT 130)"""


def _learning(spark, d):
    sig = labelled_signals(spark, d)
    return qu.learning_priority(sig.select(
        "doc_id", "source", "parent_id", F.col("intent_label").alias("rule_label"),
        F.when(F.col("k") % 9 == 0, "general_discussion").otherwise(F.col("intent_label")).alias("model_label"),
        (F.col("k") / F.lit(100.0)).alias("model_probability"), F.lit(0.5).alias("model_threshold")))


@query("i22_uncertainty", with_views("ev", f" SELECT event_id, {rsql('1 - abs(p - 0.4)')} AS uncertainty, abs(p - 0.4::DOUBLE) < 0.1 AS near FROM ev"))
def _(spark, d):
    p, t = F.col("p"), F.lit(0.4)
    return events(spark, d).select("event_id", rnd(scoring.uncertainty(p, t)).alias("uncertainty"), scoring.near_threshold(p, t).alias("near"))


@query("i23_priority", with_views("sig lsig", _LEARN_SQL + f" SELECT doc_id, reason AS selection_reason, {rsql('w + u')} AS priority FROM pr"))
def _(spark, d):
    return _learning(spark, d).select("doc_id", "selection_reason", rnd("priority").alias("priority"))


@query("f6_priority_head", with_views("sig lsig", _LEARN_SQL + " SELECT * FROM top"))
def _(spark, d):
    return qu.learning_queue(_learning(spark, d), "doc_id", control=0, max_rows=130).select("doc_id", F.col("selection_reason").alias("reason"))


@query("j22_learning_queue", with_views("sig lsig", _LEARN_SQL + " SELECT * FROM top UNION ALL SELECT doc_id, 'random_control' FROM (SELECT doc_id FROM pr WHERE doc_id NOT IN (SELECT doc_id FROM top) ORDER BY md5(doc_id || '-42'), doc_id LIMIT 20)"))
def _(spark, d):
    return qu.learning_queue(_learning(spark, d), "doc_id").select("doc_id", F.col("selection_reason").alias("reason"))


_ATTACH_SQL = f""", co AS (SELECT doc_id, {_KEY} AS tk, CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 100) / 100.0::DOUBLE END AS op FROM lab),
  ct AS (SELECT tk, arg_max(op, CAST(doc_id AS VARCHAR)) FILTER (op IS NOT NULL) AS pt FROM co GROUP BY 1),
  sg AS (SELECT s.*, {_KEY} AS tk FROM sig s),
  jn AS (SELECT sg.*, co.op AS pi, co.doc_id IS NOT NULL AS ti, ct.pt, ct.tk IS NOT NULL AS tt FROM sg LEFT JOIN co ON co.doc_id = sg.doc_id AND sg.k >= 50 LEFT JOIN ct ON ct.tk = sg.tk),
  att AS (SELECT *, CASE WHEN coalesce(pi, pt) IS NOT NULL THEN 'oof_supervised' WHEN ti OR tt THEN 'excluded_training_row' WHEN k >= 10 THEN 'persisted_supervised' ELSE 'unavailable' END AS src,
    CASE WHEN coalesce(pi, pt) IS NOT NULL THEN coalesce(pi, pt) WHEN ti OR tt THEN NULL WHEN k >= 10 THEN k / 100.0::DOUBLE END AS pp FROM jn)"""


def _attached(spark, d):
    sig = signals(spark, d).drop("actionable_probability", "probability_source")
    # Rows below k = 50 lost their id, as in an extract without identifiers.
    sig = sig.withColumn("id", F.when(F.col("k") >= 50, F.col("id")).otherwise(""))
    base = table(spark, d, "documents").select("doc_id", F.col("text").alias("plain"))
    sig = sig.join(base, "doc_id").withColumn("text", F.col("plain"))
    train = labelled_docs(spark, d).select("record_id", "text", F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 100) / F.lit(100.0)).alias("oof_probability"))
    return pr.attach_probabilities(sig, train, F.when(F.col("k") >= 10, F.col("k") / F.lit(100.0)))


@query("c6_attach_probabilities", with_views("sig lab", _ATTACH_SQL.replace("sg AS (SELECT s.*, " + _KEY + " AS tk FROM sig s)", "sg AS (SELECT s.* EXCLUDE (text), " + TEXT_KEY_SQL.format("d.text") + " AS tk FROM sig s JOIN documents d USING (doc_id))") + f" SELECT doc_id, {rsql('pp')} AS actionable_probability, src AS probability_source FROM att"))
def _(spark, d):
    return _attached(spark, d).select("doc_id", rnd("actionable_probability").alias("actionable_probability"), "probability_source")


@query("d65_probability_sources", with_views("sig lab", _ATTACH_SQL.replace("sg AS (SELECT s.*, " + _KEY + " AS tk FROM sig s)", "sg AS (SELECT s.* EXCLUDE (text), " + TEXT_KEY_SQL.format("d.text") + " AS tk FROM sig s JOIN documents d USING (doc_id))") + f" SELECT src AS probability_source, count(*) AS rows, count(pp) AS with_probability, {rsql('avg(pp)')} AS mean_probability FROM att GROUP BY 1"))
def _(spark, d):
    return pr.source_counts(_attached(spark, d)).withColumn("mean_probability", rnd("mean_probability"))
