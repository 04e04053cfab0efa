import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from pulseframe.operators import vectors
from pulseframe.plans import linear


def rows(spark, classes=2, n=60, size=40, seed=1):
    rng = np.random.default_rng(seed)
    made = []
    for i in range(n):
        y = i % classes
        at = sorted({int(k) for k in rng.integers(0, size, 6)} | {y})
        made.append((i, Vectors.sparse(size, at, rng.random(len(at)) + 0.1), float(y), 1.0 + y))
    return spark.createDataFrame(made, StructType([StructField("i", IntegerType()), StructField("features", VectorUDT()), StructField("label", DoubleType()), StructField("_weight", DoubleType())]))


def margins(model, df):
    return np.array([r.margins for r in model.margins(df).orderBy("i").collect()])


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_equals_mllib_run_to_the_end(spark, classes):
    df = rows(spark, classes)
    ours = margins(linear.fit_logistic(df, 1.0, 200, classes), df)
    theirs = LogisticRegression(weightCol="_weight", regParam=1 / 60, standardization=False, maxIter=1000, tol=1e-12).fit(df)
    want = np.array([r[0] for r in theirs.transform(df).orderBy("i").select(vector_to_array("probability")).collect()])
    got = 1 / (1 + np.exp(-ours[:, 0])) if classes == 2 else np.exp(ours) / np.exp(ours).sum(axis=1, keepdims=True)
    assert np.allclose(got, want[:, 1] if classes == 2 else want, atol=1e-4)


def test_svm_reaches_an_objective_no_worse_than_mllib(spark):
    df = rows(spark, seed=4)
    facts = df.orderBy("i").select("label", "_weight").collect()
    sign, share = np.array([2 * r.label - 1 for r in facts]), np.array([r._weight for r in facts])

    def objective(m, square):
        return float(np.sum(share * np.maximum(0, 1 - sign * m)) / share.sum() + square / 120)

    model = linear.fit_svm(df, 1.0, 100)
    theirs = LinearSVC(weightCol="_weight", regParam=1 / 60, standardization=False, maxIter=100).fit(df)
    raw = np.array([r[0][1] for r in theirs.transform(df).orderBy("i").select(vector_to_array("rawPrediction")).collect()])
    own = objective(margins(model, df)[:, 0], model.weights.agg(F.sum(F.col("w")[0] ** 2)).first()[0])
    assert own <= objective(raw, float(np.sum(theirs.coefficients.toArray() ** 2))) * 1.001


def test_no_array_of_the_vocabulary_is_needed(spark):
    """A vocabulary of two thousand million terms: a dense vector of it would take 16 GB."""
    made = [(i, Vectors.sparse(2_000_000_000, [i % 2, 1_999_999_000 + i], [1.0, 1.0]), float(i % 2), 1.0) for i in range(20)]
    df = spark.createDataFrame(made, rows(spark, n=2).schema)
    got = margins(linear.fit_logistic(df, 1.0, 50), df)[:, 0]
    assert all((m > 0) == (i % 2 == 1) for i, m in enumerate(got))
    one = margins(linear.fit_svm(df, 1.0, 50, rest=2), df)
    assert all(m.argmax() == i % 2 for i, m in enumerate(one))


def test_term_counts_shuffle_texts_not_terms(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (1, "aa"), (2, "bb cc")], "id int, text string")
    counts = vectors.term_counts(df, "id", vectors.word_terms(F.col("text")))
    assert {tuple(r) for r in counts.collect()} == {(1, "aa", 3), (1, "bb", 1), (2, "bb", 1), (2, "cc", 1)}
    plan = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc" not in plan.split("Generate")[0]


def test_margins_shuffle_no_row_per_term(spark, monkeypatch):
    monkeypatch.setattr(linear, "MARGIN_TERMS", 3)
    rows = [(i, Vectors.sparse(40, {k: float(k + i) for k in range(i % 7, 40, 3 + i % 4)})) for i in range(30)] + [(30, Vectors.sparse(40, {}))]
    df = spark.createDataFrame(rows, ["i", "features"])
    weights = spark.createDataFrame([(k, [0.5 * k, 1.0 - k]) for k in range(0, 40, 2)], "number int, w array<double>")
    model = linear.LinearModel(weights, [0.25, -1.0])
    made = model.margins(df)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    for r in made.collect():
        want = [sum(v * w(int(k)) for k, v in zip(r.features.indices, r.features.values) if k % 2 == 0) + s for w, s in ((lambda k: 0.5 * k, 0.25), (lambda k: 1.0 - k, -1.0))]
        assert r.margins == pytest.approx(want)
