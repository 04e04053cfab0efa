"""Interpolated modified Kneser-Ney n-gram models with shared backoff, trained by Spark from a bounded set of rows.

Counts are made by hash-sharded aggregations and joins: the highest order counts tokens, lower orders count distinct
left contexts, each order has three discounts from its counts of counts, and each context the weight it leaves to the next
lower order. The tables of probabilities and backoff weights are bounded by the number of training tokens, which
``bounded_rows`` limits; they are collected once and held by each scoring task as sorted arrays, so that no document is
shuffled to be scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.words import Words, mix, slices
from pulseframe.session import materialise

#: The text begins after this code and ends with that one.
BEGIN, END = np.uint64(1), np.uint64(2)


def bounded_rows(ids: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``ids(doc_id, ...)``, chosen by a hash of doc_id; all of them if there are no more."""
    return ids.orderBy(F.xxhash64("doc_id"), *ids.columns).limit(limit)


def padded(words: Words, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word codes of all texts, each with ``order`` - 1 begin codes before and one end code behind: codes, the place of each
    token that is predicted, and its text."""
    codes = words.hashes()
    n = words.counts + order
    start = np.concatenate([[0], np.cumsum(n)])
    out = np.full(start[-1], BEGIN)
    own = np.arange(len(codes)) + (order - 1) * (words.text + 1) + words.text
    out[own] = codes
    out[start[1:] - 1] = END
    predicted = np.ones(len(out), bool)
    for k in range(order - 1):
        predicted[start[:-1] + k] = False
    return out, np.flatnonzero(predicted), np.repeat(np.arange(len(n)), words.counts + 1)


def grams(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For 0 .. ``order``: the hash of so many codes that end at each place (from the last one back)."""
    out = [np.zeros(len(codes), np.uint64)]
    for k in range(order):
        shifted = np.concatenate([np.zeros(min(k, len(codes)), np.uint64), codes[: max(0, len(codes) - k)]])
        out.append(mix(out[-1] + shifted + np.uint64(0x9E3779B97F4A7C15)))
    return out


class Letters:
    """The bytes of words as tokens; each word is a text of its own."""

    def __init__(self, words: list[bytes]):
        self.counts = np.array([len(w) for w in words], np.int64)
        self.text = np.repeat(np.arange(len(words)), self.counts)
        self._codes = mix(np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(3))

    def hashes(self) -> np.ndarray:
        return self._codes


def distinct_words(words: Words, group: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of a batch (of each group), the place of one of them, and the number of each word's among them."""
    codes = words.hashes()
    if group is not None:
        codes = mix(codes + group.astype(np.uint64))
    _, first, inverse = np.unique(codes, return_index=True, return_inverse=True)
    return [words.word(i) for i in first.tolist()], first, inverse


def _gram_batches(order: int, letters: bool):
    def count(batches):
        for rows, texts in slices(batches):
            words = Words(texts, lower=True)
            group = rows.column("group").to_numpy(zero_copy_only=False).astype(np.int64)
            weight = None
            if letters:
                group = group[words.text]
                names, first, inverse = distinct_words(words, group)
                group, times, words = group[first], np.bincount(inverse, minlength=len(first)), Letters(names)
            codes, place, text = padded(words, order)
            group = group[text]
            weight = times[text] if letters else np.ones(len(text))
            hashes = grams(codes, order)
            key = mix(hashes[order][place] + group.astype(np.uint64))
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            n = np.bincount(inverse, weight, len(first)).astype(np.int64)
            columns = {"group": pa.array(group[first]), "n": pa.array(n, pa.int64())}
            for k in range(order):
                columns[f"g{k + 1}"] = pa.array(hashes[k + 1][place[first]].view(np.int64))
                columns[f"c{k + 1}"] = pa.array(hashes[k][place[first] - 1].view(np.int64) if k else np.zeros(len(first), np.int64))
            yield pa.record_batch(columns)

    return count


def _discounted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (group, g, c, k): each gram's discounted share of its context, and the weight each context leaves over."""
    of = counts.groupBy("group").agg(*[F.sum((F.col("k") == i).cast("double")).alias(f"t{i}") for i in range(1, 5)])
    y = F.col("t1") / F.greatest(F.col("t1") + 2 * F.col("t2"), F.lit(1.0))
    # Counts of counts of tiny samples can give useless values: they are kept inside (0, k).
    bounds = [F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), i - (i + 1) * y * F.col(f"t{i + 1}") / F.greatest(f"t{i}", F.lit(1.0)))).alias(f"d{i}") for i in (1, 2, 3)]
    cut = F.when(F.col("k") >= 3, F.col("d3")).when(F.col("k") == 2, F.col("d2")).otherwise(F.col("d1"))
    rows = counts.join(of.select("group", *bounds), "group").withColumn("cut", cut)
    context = rows.groupBy("group", "c").agg(F.sum("k").alias("total"), F.sum("cut").alias("left"))
    share = rows.join(context, ["group", "c"]).select("group", "g", ((F.col("k") - F.col("cut")) / F.col("total")).alias("p"))
    return share, context.select("group", "c", (F.col("left") / F.col("total")).alias("w"))


class Model:
    """Probabilities as sorted arrays: order by order from 0, gram -> share and context -> weight, a column for each group.

    Order 0 are the words of all groups together, the backoff that they share; below it all words and one unknown are alike.
    """

    def __init__(self, order: int, words: int, groups: int = 1):
        self.order, self.words, self.groups, self.parts = order, words, groups, {}

    def log10(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 probability of the token at each place given the ``order`` - 1 codes before it: places x groups."""
        hashes = grams(codes, self.order)
        p = np.full((len(place), self.groups), 1.0 / (self.words + 1))
        for k in range(self.order + 1):
            if k in self.parts:
                (own, share), (contexts, weight) = self.parts[k]
                before = hashes[k - 1][place - 1] if k > 1 else np.zeros(len(place), np.uint64)
                p *= _find(contexts, weight, before, 1.0)
                p += _find(own, share, hashes[max(k, 1)][place], 0.0)
        return np.log10(p)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    """Rows of ``values`` for the wanted keys."""
    out = np.full((len(wanted), values.shape[1]), missing)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == wanted)
        out[hit] = values[at[hit]]
    return out


def train(rows: DataFrame, order: int, groups: int = 1, least: int = 1, letters: bool = False) -> Model:
    """Fit to ``rows(group int, text)``, a bounded set of rows; the groups are numbered from 0.

    With several groups each has its own model, and all back off to the words of the groups together. Grams count for a group
    only if they are seen ``least`` times in it (below the highest order: after ``least`` different tokens). With ``letters``
    the tokens are the bytes of single words instead of words. Without rows every token gets an equal share.
    """
    counts = rows.select("group", "text").mapInArrow(
        _gram_batches(order, letters), "group long, n long, " + ", ".join(f"g{k} long, c{k} long" for k in range(1, order + 1)))
    names = [c for c in counts.columns if c not in ("group", "n")]
    # One row for each group and gram of the highest order.
    counts = counts.groupBy("group", f"g{order}").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in names if c != f"g{order}"])
    counts = materialise(counts, "grams")
    model = Model(order, counts.select("g1").distinct().count(), groups)
    for k in range(order, 0, -1):
        if k == order:
            told = counts.select("group", F.col(f"g{k}").alias("g"), F.col(f"c{k}").alias("c"), F.col("n").alias("k"))
        else:
            above = counts.groupBy("group", f"g{k + 1}").agg(F.first(f"g{k}").alias("g"), F.first(f"c{k}").alias("c"))
            told = above.groupBy("group", "g").agg(F.count("*").alias("k"), F.first("c").alias("c"))
        model.parts[k] = _tables(told.where(F.col("k") >= least), list(range(groups)))
    if groups > 1:
        told = counts.groupBy(F.lit(0).cast("long").alias("group"), F.col("g1").alias("g")).agg(F.count("*").alias("k"), F.first("c1").alias("c"))
        model.parts[0] = _tables(told, [0] * groups)
    return model


def _tables(told: DataFrame, groups: list[int]) -> tuple:
    share, weight = _discounted(told)
    return _collected(share, "g", groups, 0.0), _collected(weight, "c", groups, 1.0)


def _collected(df: DataFrame, key: str, groups: list[int], missing: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and a column of values for each group. The frame is bounded by the training tokens."""
    table = df.toArrow()
    group, keys, value = (table.column(c).to_numpy() for c in ("group", key, table.column_names[-1]))
    keys, place = np.unique(keys.view(np.uint64), return_inverse=True)
    out = np.full((len(keys), len(groups)), missing)
    for column, g in enumerate(groups):
        own = group == g
        out[place[own], column] = value[own]
    return keys, out


def text_sums(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sum of the token values of each of ``n`` texts."""
    return np.bincount(text, values, n) if len(values) else np.zeros(n)
