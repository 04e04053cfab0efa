"""Toxicity by class-conditional Kneser-Ney models.

One model of the letters of words is trained on toxic rows, one on ordinary rows; both back off to the counts of the two
together, so an expression that is rare in both says little, and forms of a word that were never seen share its stem's
counts. A text's score is a logistic function of the difference of the two log-likelihoods, divided by the number of words
and by its square root, and of the greatest differences of single words, so that a few words count in a long text. The logistic function is fitted to labelled rows
that the models have not seen, and its constant is set to the ratio of the classes among all labels, so that the bound on
the rows of a class does not move the decision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm import kneser
from pulseframe.llm.words import Words, bound_batches, slices, text_rows

#: Labelled rows of each class that are used at most.
ROWS_PER_CLASS = 6000
ORDER = 5
#: Times that a gram must be seen in a class to count for it.
LEAST = 2
#: Words of a text whose differences are taken together.
TOP = 3
#: A row is held out of learning if crc32 of its id leaves 0.
FOLDS = 5
#: Distinct words whose differences a task keeps between batches (16 bytes each).
KEPT_WORDS = 1 << 20


def held_out(folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


class Differences:
    """Difference of the two classes' log-likelihoods of a word. A word's value depends on its letters alone, so those of at
    most ``limit`` distinct words are kept from batch to batch; a fuller store starts anew."""

    def __init__(self, model: kneser.Model, limit: int = KEPT_WORDS):
        self.model, self.limit = model, limit
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, words: Words) -> np.ndarray:
        """The difference of each word."""
        keys, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        each = np.zeros(len(keys))
        each[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            letters = kneser.Letters([words.word(i) for i in first[new].tolist()])
            codes, place, owner = kneser.padded(letters, self.model.order)
            logs = self.model.log10(codes, place)
            each[new] = kneser.text_sums(logs[:, 1] - logs[:, 0], owner, len(new))
            if len(self.keys) + len(new) > self.limit:
                self.keys, self.values, at = np.zeros(0, np.uint64), np.zeros(0), np.zeros(len(keys), np.int64)
            if len(new) <= self.limit:
                self.keys, self.values = np.insert(self.keys, at[new], keys[new]), np.insert(self.values, at[new], each[new])
        return each[inverse]


def features(differences: Differences, texts: list) -> np.ndarray:
    """For each text: a constant, the normalised differences of log-likelihoods of the whole, and the greatest of a word and
    of TOP words together."""
    words = Words(texts, lower=True)
    own = differences.of(words)
    gain = kneser.text_sums(own, words.text, len(texts))
    order = np.lexsort((-own, words.text))
    rank = np.arange(len(own)) - words.first[:-1][words.text[order]]
    best = kneser.text_sums(np.where(rank == 0, own[order], 0.0), words.text[order], len(texts))
    top = kneser.text_sums(np.where(rank < TOP, np.maximum(own[order], 0.0), 0.0), words.text[order], len(texts)) / TOP
    n = words.counts + 1.0
    return np.stack([np.ones(len(texts)), gain / n, gain / np.sqrt(n), best, top], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.01) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, with a small penalty on all but the constant."""
    w, keep = np.zeros(x.shape[1]), penalty * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _feature_batches(model):
    def score(batches):
        differences = Differences(model)
        for rows, texts in slices(batches, size=2_500_000):
            x = features(differences, texts)
            yield pa.record_batch({"toxic": rows.column("toxic").cast(pa.int32()), "x": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))})

    return score


def _score_batches(model, weights):
    def score(batches):
        differences = Differences(model)
        for rows, texts in slices(batches, size=2_500_000):
            p = 1 / (1 + np.exp(-np.clip(features(differences, texts) @ weights, -30, 30)))
            yield pa.record_batch({"doc_id": rows.column("doc_id"), "held_out": rows.column("held"), "score": pa.array(p),
                                   "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return score


def toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, order: int = ORDER, least: int = LEAST, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``.

    Learns from ``labels(doc_id, toxic)`` of rows that are not held out, at most ``rows_per_class`` of each class, chosen by
    a hash of the id; one in five of them fits the logistic function, for the ratio of the classes among all labels that are
    not held out. A doc_id with several labels counts with the greatest; other labels than 0 and 1, and rows without doc_id,
    teach nothing. A null text scores like an empty one. Without labels of both classes every score is the share of label 1
    (0.5 of nothing). An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(folds))
    # Labels of each class: all, and those of them that fit the logistic function.
    total = np.zeros(2)
    for r in known.groupBy("toxic").count().collect():
        total[r["toxic"]] = r["count"]
    fitting = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(5)) == 0
    chosen = None
    for c in (0, 1):
        part = kneser.bounded_rows(known.where(F.col("toxic") == c), rows_per_class)
        chosen = part if chosen is None else chosen.union(part)
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, toxic int")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # At most 2 * rows_per_class ids: a bounded broadcast, so no text is shuffled to find the rows.
    learn = rows.join(F.broadcast(chosen), "doc_id").withColumn("fitting", fitting)
    model = kneser.train(learn.where("not fitting").select(F.col("toxic").alias("group"), "text"), order, 2, least, letters=True)
    fit = learn.where("fitting").mapInArrow(_feature_batches(model), "toxic int, x array<double>").toPandas()
    y = fit["toxic"].to_numpy(float)
    if 0 < y.sum() < len(y):
        weights = logistic(np.stack(fit["x"].to_list()), y)
        # Each class has its own share of labels among the rows of the fit: the constant takes the ratio of all labels instead.
        used = np.zeros(2)
        for r in chosen.where(fitting).groupBy("toxic").count().collect():
            used[r["toxic"]] = r["count"]
        weights[0] += np.log(total[1] / total[0]) - np.log(used[1] / used[0])
    else:
        share = (total[1] + 0.5) / (total.sum() + 1)
        weights = np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0])
    held = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    return text_rows(held.withColumn("held", held_out(folds)), "doc_id", "held", "text").mapInArrow(
        _score_batches(model, weights), "doc_id long, held_out boolean, score double, predicted int")
