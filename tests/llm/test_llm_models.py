import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import kneser, quality, toxicity
from pulseframe.llm.words import Words
from tests.llm.fixtures import frame, rows, texts, words


def discounts(counts):
    t = [sum(1 for c in counts if c == i) for i in range(1, 5)]
    y = t[0] / max(t[0] + 2 * t[1], 1)
    return [max(0.1, min(i - 0.1, i - (i + 1) * y * t[i] / max(t[i - 1], 1))) for i in (1, 2, 3)]


def brute_bigram(training):
    """p(w | v) by definition, from plain dictionaries."""
    pairs, after = {}, {}
    for t in training:
        w = ["<s>", *t, "</s>"]
        for v, x in zip(w, w[1:]):
            pairs[v, x] = pairs.get((v, x), 0) + 1
    for v, x in pairs:
        after[x] = after.get(x, 0) + 1
    d2, d1 = discounts(pairs.values()), discounts(after.values())
    cut = lambda d, c: d[min(c, 3) - 1]
    n1 = sum(after.values())

    def p(x, v):
        low = sum(cut(d1, c) for c in after.values()) / n1 / (len(after) + 1)
        low += (after[x] - cut(d1, after[x])) / n1 if x in after else 0
        own = {y: c for (u, y), c in pairs.items() if u == v}
        if not own:
            return low
        total = sum(own.values())
        high = (own[x] - cut(d2, own[x])) / total if x in own else 0
        return high + sum(cut(d2, c) for c in own.values()) / total * low

    return p, after


def test_bigram_model_equals_definition_and_adds_up(spark):
    rng = random.Random(4)
    training = [[rng.choice("aaabbcdefg") for _ in range(rng.randint(1, 12))] for _ in range(40)]
    rows_ = spark.createDataFrame([(0, " ".join(t)) for t in training], "group int, text string")
    model = kneser.train(rows_, 2)
    p, after = brute_bigram(training)
    for text in ("a b c", "g g unknown a", "", "zz a"):
        w = Words([text.encode()], lower=True)
        codes, place, _ = kneser.padded(w, 2)
        chain = ["<s>", *text.split(), "</s>"]
        want = [math.log10(p(x, v)) for v, x in zip(chain, chain[1:])]
        assert np.allclose(model.log10(codes, place)[:, 0], want)
    for v in ("a", "g", "<s>"):
        assert math.isclose(sum(p(x, v) for x in after) + p("unknown", v), 1, rel_tol=1e-9)


def labelled(n=120):
    rng, good = random.Random(6), texts(n, 31)
    out, labels = [], []
    for i, t in enumerate(good):
        bad, toxic = i % 5 == 0, i % 3 == 1
        if bad:
            t = " ".join(f"{w}%%%" for w in t.split())
        elif toxic:
            w = t.split()
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["horrid", "vileness", "Scoundrel,"]) if i % 2 else "horridly")
            t = " ".join(w)
        out.append((i, t, "en" if i % 2 else "de", "s"))
        labels.append((i, int(not bad), int(toxic and not bad)))
    return out, labels


def test_quality_keeps_good_and_drops_junk(spark):
    data, labels = labelled()
    odd = [r for r in rows() if r[0] is None or r[0] >= 1000]
    docs = frame(spark, data + odd)
    table = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0), (5, 9, 9)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, table, trusted_rows=60).collect()
    assert len(got) == len(data) + len(odd)
    verdict = {r.doc_id: r.kept for r in got}
    assert [d for d, q, _ in labels if q and not verdict[d]] == []
    assert sum(not verdict[d] for d, q, _ in labels if not q) >= 20
    assert verdict[1000] and verdict[1001] and verdict[1002]
    kept = quality.keep_good(docs, table, trusted_rows=60)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept or r.doc_id is None for r in got)


def test_quality_thresholds_cover_all_trusted_rows(spark, monkeypatch):
    """A language whose trusted rows are few among those of the model's sample has a threshold of its own."""
    data = [(i, t, "de" if i % 12 == 0 else None if i % 12 == 1 else "en", "s") for i, t in enumerate(texts(600, 51, 20))]
    labels = spark.createDataFrame([(d, 1, 0) for d, *_ in data], "doc_id long, quality int, toxic int")
    got = quality.quality(frame(spark, data), labels, trusted_rows=30).collect()
    assert len({r.threshold for r in got}) == 3
    for lang in ("de", None, "en"):
        assert len({r.threshold for r in got if r.lang == lang}) == 1


def test_quality_rejects_the_share_that_its_quantile_says(spark):
    """Of the trusted rows that set the threshold 0.5 % lie above it, and most rows with some junk words."""
    rng, data, labels = random.Random(9), [], []
    for i, t in enumerate(texts(1500, 61, 40)):
        bad = i % 5 == 0
        data.append((i, " ".join(f"{w}%%" if bad and rng.random() < 0.2 else w for w in t.split()), "en", "s"))
        labels.append((i, int(not bad), 0))
    got = quality.quality(frame(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), trusted_rows=400).collect()
    good = [r for r in got if r.doc_id % 5]
    above = sum(not r.kept for r in good)
    assert len({r.threshold for r in got}) == 1 and 0 < above <= 0.005 * len(good)
    assert sum(not r.kept for r in got if r.doc_id % 5 == 0) >= 0.9 * (len(got) - len(good))


def test_quantiles(spark):
    rng = random.Random(3)
    rows_ = [(lang, round(rng.gauss(2, 0.5), 2), rng.randint(1, 4)) for lang in ("a", None, "b") for _ in range(300)] + [("one", 1.5, 7)]
    table = spark.createDataFrame(rows_, "lang string, v double, k long").groupBy("lang", "v").agg(F.sum("k").alias("k"))
    got = {r.lang: (r.n, r.q0, r.q1) for r in quality.quantiles(table, [0.5, 0.99]).collect()}
    for lang in ("a", None, "b", "one"):
        v = sorted(x for name, x, k in rows_ if name == lang for _ in range(k))
        assert got[lang] == (len(v), *[v[max(1, math.ceil(len(v) * q - 1e-9)) - 1] for q in (0.5, 0.99)])


def test_quality_without_labels_or_rows(spark):
    docs, none = frame(spark, rows()), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, none).where("not kept").count() == 0
    assert quality.keep_good(docs.limit(0), none).count() == 0


def test_toxicity_on_held_out_rows(spark):
    data, labels = labelled(300)
    odd = [r for r in rows() if r[0] is None or r[0] >= 1000]
    docs = frame(spark, data + odd)
    table = spark.createDataFrame([*labels, (None, 1, 1), (2, 1, None), (7, 1, 5)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, table).collect()
    assert len(got) == len(data) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (4, 1, 0)]], ids=["none", "one class"])
def test_toxicity_without_two_classes(spark, labels):
    docs = frame(spark, rows())
    got = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len({r.score for r in got}) == 1 and len(got) == docs.count()
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_toxicity_decides_alike_if_a_class_is_bounded(spark):
    """Eight ordinary rows to a toxic one; a word of half the toxic and an eighth of the ordinary rows says "more likely ordinary"."""
    rng, data, labels = random.Random(8), [], []
    for i, t in enumerate(texts(1800, 41, 20)):
        toxic = i % 9 == 0
        word = ("horrid" if i % 2 else "dubious") if toxic else "dubious" if rng.random() < 0.125 else "plain"
        data.append((i, f"{t} {word} {word}", "en", "s"))
        labels.append((i, 1, int(toxic)))
    docs, table = frame(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    word = {d: t.split()[-1] for d, t, *_ in data}
    share, scores = {}, {}
    for bound in (10_000, 160):
        got = toxicity.toxicity(docs, table, rows_per_class=bound).collect()
        share[bound] = {w: np.mean([r.predicted for r in got if word[r.doc_id] == w]) for w in ("plain", "dubious", "horrid")}
        scores[bound] = np.mean([r.score for r in got])
    for bound in share:
        assert share[bound]["plain"] < 0.02 and share[bound]["dubious"] < 0.2 and share[bound]["horrid"] > 0.8
        assert abs(scores[bound] - 1 / 9) < 0.04


@pytest.mark.parametrize("limit", [0, 40, 10_000])
def test_word_differences_are_worked_out_once(limit):
    """Values kept from earlier batches equal new ones, and a word met again is not worked out again."""
    rng = np.random.default_rng(3)

    class Counted(kneser.Model):
        tokens = 0

        def log10(self, codes, place):
            self.tokens += len(place)
            return super().log10(codes, place)

    model = Counted(3, 50, 2)
    letters = kneser.mix(np.arange(256, dtype=np.uint64) + np.uint64(3))
    own = np.sort(kneser.grams(letters, 1)[1])
    model.parts[1] = (own, rng.random((256, 2)) / 256), (np.zeros(1, np.uint64), np.full((1, 2), 0.5))
    batches = [[t.encode() for t in texts(6, seed)] for seed in (1, 2, 1, 3)]
    kept = toxicity.Differences(model, limit)
    got = [toxicity.features(kept, b) for b in batches]
    first = model.tokens
    for b, x in zip(batches, got):
        assert np.array_equal(toxicity.features(toxicity.Differences(model, 0), b), x)
    assert len(kept.keys) <= limit
    if limit == 10_000:
        distinct = {w for b in batches for t in b for w in t.split()}
        assert first == sum(len(w) + 1 for w in distinct)


def test_bounded_rows(spark):
    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    assert kneser.bounded_rows(ids, 10).select(F.count("*")).first()[0] == 10


def test_quality_model_learns_from_all_trusted_rows(spark):
    """Words of rows beyond any bound of the sample are known: the perplexities are those of a model of the whole half."""
    from pulseframe.llm import gramtable

    train = [f"common w{i} v{i % 7} common" for i in range(9000)] + ["", None]
    asked = ["common w8999 v4", "w17 v3 common common", "unknown common", "", None, "w5"]
    table = gramtable.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(3), 2)
    rows_ = spark.createDataFrame(list(enumerate(asked)), "no int, text string")
    got = {r.no: r for r in gramtable.perplexities(rows_, table).collect()}
    model = kneser.train(spark.createDataFrame([(0, t) for t in train], "group int, text string"), 2)
    for i, text in enumerate(asked):
        codes, place, _ = kneser.padded(Words([(text or "").encode()], lower=True), 2)
        want = -float(model.log10(codes, place).sum()) / len(place)
        assert got[i].n_tokens == len(place) and math.isclose(got[i].log10_perplexity, want, rel_tol=1e-9)

    data = [(i, t, "en", "s") for i, t in enumerate(train)]
    labels = spark.createDataFrame([(d, 1, 0) for d, *_ in data], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r.log10_perplexity for r in quality.quality(frame(spark, data), labels).collect()}
    ids = spark.range(len(train)).where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(2)) == 0)
    half = [r.id for r in ids.collect()]
    model = kneser.train(spark.createDataFrame([(0, train[i]) for i in half], "group int, text string"), 2)
    for i in (half[0], half[-3], 1, 4500):
        codes, place, _ = kneser.padded(Words([train[i].encode()], lower=True), 2)
        assert math.isclose(scored[i], -float(model.log10(codes, place).sum()) / len(place), rel_tol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_gram_table_equals_model_of_each_order(spark, monkeypatch, order):
    """Also where most words have no short code, which then travel as hashes, and over several blocks and packs."""
    from pulseframe.llm import gramtable

    for name, value in (("SHORT_CODES", 20), ("HELD", 30), ("BLOCK_BYTES", 2000), ("PACK_ENTRIES", 100), ("SHARDS", 3)):
        monkeypatch.setattr(gramtable, name, value)
    train, asked = texts(40, 71, 30), [*texts(20, 72, 20), "", "unknown words"]
    table = gramtable.train(spark.createDataFrame([(t,) for t in train], "text string"), order)
    rows_ = spark.createDataFrame(list(enumerate(asked)), "no int, text string")
    got = [r.log10_perplexity for r in gramtable.perplexities(rows_, table).orderBy("no").collect()]
    model = kneser.train(spark.createDataFrame([(0, t) for t in train], "group int, text string"), order)
    for value, text in zip(got, asked, strict=True):
        codes, place, _ = kneser.padded(Words([text.encode()], lower=True), order)
        assert math.isclose(value, -float(model.log10(codes, place).sum()) / len(place), rel_tol=1e-9)
