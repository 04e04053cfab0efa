import pytest

from pulseframe.llm import graph, similarity
from tests.llm.fixtures import frame, lower, rows, words


def brute(data):
    sets = []
    for doc, text, *_ in data:
        w = words(lower(text))
        sets.append((doc, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((d, len(s), d if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str)


def near_copies(n):
    """A group of texts that differ from one another in random deletions: stars do not connect all of them."""
    import random

    rng, base = random.Random(8), words(rows()[0][1])[:60]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            del w[rng.randrange(len(w))]
        out.append((5000 + i, " ".join(w), "en", "s"))
    return out


@pytest.mark.parametrize("data", [rows(), near_copies(60)], ids=["cases", "near"])
def test_components_equal_brute_force(spark, data):
    got = similarity.near_duplicates(frame(spark, data)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == brute(data)


def test_keep_one_returns_one_row_of_each_group_with_its_columns(spark):
    data = rows()
    docs = frame(spark, data)
    kept = similarity.keep_one(docs)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id for r in kept.collect()), key=str)
    assert found == sorted([*{r[0] for r in brute(data) if r[0] is not None and r[3]}, None, None], key=str)


def test_empty_table(spark):
    docs = frame(spark, rows()).limit(0)
    assert similarity.near_duplicates(docs).count() == 0
    assert similarity.keep_one(docs).count() == 0


def test_sketches_fill_every_slot():
    value, first = similarity.shingle_sets([b"a", b"a b c d e f", b"", None, b" ".join(b"w%d" % i for i in range(3000))])
    sketch = similarity.sketches(value, first)
    full = (sketch != similarity._FULL).all(axis=1)
    assert full.tolist() == [True, True, False, False, True]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(30)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
