import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import termtable, vectors
from pulseframe.plans import classifiers as cl

ROWS = [(1, "aa bb aa"), (1, "bb cc"), (2, "bb dd ée"), (3, None), (None, "aa zz"), (4, "aa zz qq"), (2, "dd")] + [(i, f"aa w{i % 5} w{i}") for i in range(10, 40)]


def expected(rows, n):
    tf = defaultdict(Counter)
    for doc, text in rows:
        tf[doc].update(w for w in (text or "").split())
    df = Counter(w for c in tf.values() for w in c)
    out = {}
    for doc, c in tf.items():
        raw = {w: (1 + math.log(k)) * (math.log((1 + n) / (1 + df[w])) + 1) for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out[doc] = (Counter(df[w] for w in c), sorted(x / norm for x in raw.values()))
    return df, out


@pytest.fixture
def small(monkeypatch):
    """Several batches and shards."""
    monkeypatch.setattr(termtable, "BATCH_BYTES", 60)
    monkeypatch.setattr(termtable, "SHARD_BYTES", 100)


def test_weights_of_repeated_and_missing_keys(spark, small):
    df = spark.createDataFrame(ROWS, "id int, text string")
    got = vectors.text_tfidf(df, "id", vectors.word_terms(F.col("text")), len(ROWS), sublinear=True)
    of_doc = defaultdict(list)
    for r in got.collect():
        of_doc[r.doc].append(r)
    _, want = expected(ROWS, len(ROWS))
    assert set(of_doc) == {d for d in want if want[d][1]}
    for doc, rows in of_doc.items():
        assert len({r.term for r in rows}) == len(rows)
        assert Counter(r.df for r in rows) == want[doc][0]
        assert sorted(r.weight for r in rows) == pytest.approx(want[doc][1])


def test_features_shuffle_texts_and_distinct_terms_only(spark, small, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc int, text string")
    plans, write = [], cl._as_vectors

    def seen(made, name):
        plans.append(made._jdf.queryExecution().executedPlan().toString())
        return write(made, name)

    monkeypatch.setattr(cl, "_as_vectors", seen)
    fitted = cl.TextFeatures().fit(df)
    made = fitted.transform(df)
    assert "Generate" not in plans[0] and "Window" not in plans[0]  # no row per term
    terms = vectors.word_terms(F.col("text"), 2)
    counts = df.select("doc", F.explode(terms).alias("term")).distinct().groupBy("term").count().collect()
    table = {r.term: r for r in fitted.frequency.collect()}
    assert {t: r.df for t, r in table.items()} == {r.term: r["count"] for r in counts}
    assert sorted(r.number for r in table.values()) == list(range(fitted.size)) and fitted.n == len(ROWS)
    rows = made.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert (r.features.numNonzeros() == 0) == (r.doc in (None, 3))
        assert r.features.numNonzeros() == 0 or r.features.norm(2) == pytest.approx(1)
    one = next(r.features for r in rows if r.doc == 4)
    assert set(one.indices) == {table[t].number for t in ("aa", "zz", "qq", "aa zz", "zz qq")}


def test_equal_hashes_keep_terms_apart(monkeypatch):
    monkeypatch.setattr(termtable, "_hashes", lambda terms: np.zeros(len(terms), np.uint64))
    for words in (["b", "a", "c"], ["c", "b", "a"]):
        order, ends = termtable._ordered(pa.array(words), 3)
        assert [words[i] for i in order] == ["a", "b", "c"] and list(ends) == [0, 3, 3, 3]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc int, text string")
    assert cl.TextFeatures(("word", "char")).fit(df).transform(df).count() == 0
    assert vectors.text_tfidf(df, "doc", vectors.word_terms(F.col("text")), 0).count() == 0
