import random

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import agreement, evaluation
from pulseframe.plans import studies
from tests.test_persistence import corpus

CLASSES = ("high_intent", "confusion_barrier", "general_discussion")


def predictions(spark, n=80):
    rng, rows = random.Random(6), []
    for model in ("a", "b"):
        for seed in (1, 2):
            for i in range(n):
                true = CLASSES[i % 3]
                p = round(rng.random(), 2)
                y = int(true != "general_discussion")
                rows.append((str(i), true, y, p, int(p > 0.4), model == "a", 0.4, False, rng.choice(CLASSES), rng.choice(CLASSES[:2]), rng.choice(CLASSES), model, seed, 0))
    return spark.createDataFrame(rows, studies._PREDICTIONS)


def test_keyed_measures_equal_those_of_each_run(spark):
    rows = predictions(spark)
    tables = studies.benchmark_tables(rows)
    per = {(r.model, r.seed): r for r in tables["per_seed"].collect()}
    assert len(per) == 4 and tables["summary"].count() == 2
    for (model, seed), row in per.items():
        own = rows.where((F.col("model") == model) & (F.col("seed") == seed))
        one = evaluation.binary_metrics(own, "y", "pred", "p").first()
        assert (row.stage1_f1, row.stage1_pr_auc, row.stage1_roc_auc) == pytest.approx((one.f1, one.pr_auc, one.roc_auc))
        assert (row.stage1_brier is None) == (model == "b")
        for column, prefix, part in (("flat_label", "flat", own), ("e2e_label", "e2e", own), ("stage2_label", "stage2", own.where("y = 1"))):
            want = agreement.multiclass_summary(agreement.label_pairs(part, "corrected_label", column)).first()
            got = tuple(row[f"{prefix}_{c}"] for c in ("accuracy", "macro_f1", "weighted_f1", "macro_f1_observed"))
            assert got == pytest.approx((want.accuracy, want.macro_f1, want.weighted_f1, want.macro_f1_observed))
        ranks = {r.cutoff: r for r in evaluation.ranking_metrics(own, "y", "p", "record_id", studies.RANK_K, studies.RANK_SHARES).collect()}
        for cut, want in ranks.items():
            assert (row[f"precision_{cut}"], row[f"recall_{cut}"], row[f"lift_{cut}"]) == pytest.approx((want.precision, want.recall, want.lift))


def test_cv_tables_of_given_predictions(spark):
    facts = corpus(spark, 80).select("record_id", "text", "parent_id", F.lit("s").alias("source"), F.lit("en").alias("sample_strategy"))
    rows = predictions(spark)
    tables = studies.cv_tables(rows, facts, 1, replicates=20)
    assert tables["per_seed"].count() == 4 and tables["per_class"].count() == 4 * 8
    own = rows.where("model = 'a' and seed = 1")
    want = {r.bin: tuple(r)[1:] for r in evaluation.reliability_table(spark, evaluation.score_table(own, "y", "p")).collect()}
    got = {r.bin: tuple(r)[2:] for r in tables["reliability"].where("model = 'a'").collect()}
    assert got.keys() == want.keys() and all(got[b] == pytest.approx(want[b], nan_ok=True) for b in want)
    slices = {(r.model, r.dimension, r.value): r.n for r in tables["slices"].collect()}
    assert slices[("a", "source", "s")] == slices[("b", "sample_strategy", "en")] == 80
    assert tables["groups"].where("model = 'b'").agg(F.sum("n")).first()[0] == 80
    spans = tables["bootstrap"].collect()
    assert {(r.model, r.metric) for r in spans} == {(m, c) for m in "ab" for c in ("pr_auc", "roc_auc", "brier_score", "lift_at_10pct")}
    assert all(r.low <= r.high for r in spans)


def test_out_of_fold_rows_are_scored_once_by_models_of_other_groups(spark):
    df = corpus(spark, 60)
    got = studies.cv_predictions(df, ("logistic", "rules"), (42,), 3).collect()
    for model in ("logistic", "rules"):
        ids = sorted(int(r.record_id) for r in got if r.model == model)
        assert ids == sorted(set(ids)) and len(ids) >= 30
    fold = {}
    groups = {r.record_id: r.parent_id for r in df.collect()}
    for r in got:
        assert fold.setdefault(groups[r.record_id], r.fold) == r.fold
    right = [r.pred == r.y for r in got if r.model == "logistic"]
    assert sum(right) > 0.7 * len(right)


def test_shared_feature_table_equals_features_fitted_per_run(spark):
    from pulseframe.plans import classifiers as cl

    df = corpus(spark, 40).withColumns({"split": F.when(F.col("record_id").cast("int") < 25, "train").otherwise("test"), "run": F.lit("r")})
    made = studies._feature_table(df, ["word", "word_char"])
    for family, blocks in (("word", ("word",)), ("word_char", ("word", "char"))):
        rows = df.withColumn("doc", F.col("record_id"))
        want = cl.TextFeatures(blocks).fit(rows.where("split = 'train'")).transform(rows)
        pair = made.where(F.col("family") == family).join(want.select("doc", F.col("features").alias("w")), "doc").collect()
        assert len(pair) == 40
        for r in pair:
            assert sorted(r.features.values) == pytest.approx(sorted(r.w.values))
