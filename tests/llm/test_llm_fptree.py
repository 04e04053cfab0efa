import math
import random
import re
from collections import Counter

import pytest

from pulseframe.llm import fptree
from tests.llm.fixtures import frame, lower, rows, texts, vocabulary

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(lower(text))


def brute(data, items, top=10):
    docs = [(d, Counter(terms(t)), len(terms(t))) for d, t, *_ in data]
    docs = [d for d in docs if d[2]]
    n_docs, length = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    joined = {}
    for item, text in sorted(set(items), key=str):
        joined.setdefault(item, []).extend(terms(text))
    out = []
    for item, own in joined.items():
        found = []
        for doc, tf, n in docs:
            m = 100 - 75 + 75 * n * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in own)
            if score > 0:
                found.append((-score, doc is None, doc))
        out += [(item, i + 1, doc, -score) for i, (score, _, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def queries(seed=3):
    rng, vocab = random.Random(seed), vocabulary()
    base = [t for _, t, *_ in rows() if t]
    out = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 25)))) for i in range(25)]
    out += [(100 + i, base[i][:200] + "! Word-" + base[i + 1][:50].upper()) for i in range(8)]
    return out + [(200, None), (201, ""), (202, "?! ;"), (203, "unheard"), (None, vocab[0]), (0, out[0][1]), (1, vocab[7] + " " + vocab[7]), (204, " ".join(vocab) * 2)]


def compare(spark, data, items, **options):
    bench = spark.createDataFrame([(*i, 9, "x") for i in items], "item_id long, text string, score long, rank string")
    got = fptree.ranked_search(frame(spark, data), bench, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(data, items)


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_rows_equal_brute_force(spark, leaf):
    compare(spark, rows(), queries(), leaf=leaf)


def test_many_copies_and_blocks_of_items(spark, monkeypatch):
    data = rows() + [(2000 + i, rows()[0][1], "en", "hot") for i in range(120)] + [(3000 + i, t, "en", "s") for i, t in enumerate(texts(150, 77, 12))]
    monkeypatch.setattr(fptree, "TREE_DOCS", 40)
    monkeypatch.setattr(fptree, "_CELLS", 50)
    compare(spark, data, queries(), block_bytes=900)


def test_bounds_hold_and_cut(spark):
    """A node's bound is never below the score of a document under it, and most documents are not scored."""
    import numpy as np

    rng = random.Random(2)
    docs = [sorted(rng.sample(range(200), 12) + [k % 3, 3 + k % 5]) for k in range(3000)]
    first = np.concatenate([[0], np.cumsum([len(set(d)) for d in docs])])
    flat = np.array([t for d in docs for t in sorted(set(d))])
    tree = fptree.Tree(first, flat, np.ones(len(flat), np.int64), np.full(len(docs), 100), 200)
    seen, scores = [0], fptree.Tree._scores

    def counted(self, at, keys, *rest):
        seen[0] += len(at) if keys is self.doc_keys else 0
        return scores(self, at, keys, *rest)

    query, weights = np.array([0, 3, 50, 120, 199]), np.array([10, 20, 3000, 4000, 5000])
    fptree.Tree._scores = counted
    try:
        best = fptree.Best()
        tree.search(query, weights, best, np.arange(len(docs)))
    finally:
        fptree.Tree._scores = scores
    exact = scores(tree, np.arange(len(docs)), tree.doc_keys, tree.tfs, tree.m, query, weights)
    order = np.lexsort((tree.order, -exact))[:10]
    assert best.ids.tolist() == tree.order[order].tolist() and best.scores.tolist() == exact[order].tolist()
    assert seen[0] < len(docs)


def test_empty_tables(spark):
    bench = spark.createDataFrame(queries(), "item_id long, text string")
    assert fptree.ranked_search(frame(spark, rows()).limit(0), bench).count() == 0
    assert fptree.ranked_search(frame(spark, rows()), bench.limit(0)).count() == 0
