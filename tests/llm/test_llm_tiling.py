import random
import re

import numpy as np
import pytest

from pulseframe.llm import tiling
from tests.llm.fixtures import frame, rows, texts


def brute_tiles(p, q, least):
    """Plain greedy tiling: mark the longest free common runs, in document order, until none is left."""
    free_p, free_q, out = [True] * len(p), [True] * len(q), []
    while True:
        best, found = least, []
        for j in range(len(q)):
            for i in range(len(p)):
                k = 0
                while i + k < len(p) and j + k < len(q) and p[i + k] == q[j + k] and free_p[i + k] and free_q[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(free_p[i : i + best]) and all(free_q[j : j + best]):
                out.append(best)
                free_p[i : i + best] = free_q[j : j + best] = [False] * best


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(200):
        p, q = (rng.integers(0, 4, rng.integers(0, n)).astype(np.uint64) for n in (30, 40))
        assert sorted(t[2] for t in tiling.tiles(p, q, 3)) == sorted(brute_tiles(p.tolist(), q.tolist(), 3))


@pytest.mark.parametrize("block_bytes", [4_000_000, 200])
def test_exact_reordered_and_partial_passages(spark, block_bytes):
    items = texts(6, 77, 30)
    rng = random.Random(2)
    base = texts(8, 78, 80)

    def inside(i, passage):
        w = base[i].split()
        at = rng.randrange(len(w))
        return " ".join(w[:at] + passage.split() + w[at:])

    w = items[1].split()
    third = len(w) // 3
    reordered = " ".join(w[2 * third :] + ["x"] + w[:third] + ["y"] + w[third : 2 * third])
    docs = [(1, inside(0, re.sub('[a-z]', lambda m: m[0].upper(), items[0])), "en", "s"), (2, inside(1, reordered), "en", "s"), (3, base[2], "en", "s"),
            (4, inside(3, " ".join(items[2].split()[:4])), "en", "s"), (5, None, "en", "s"), (6, "", "en", "s"), (7, "tiny one", "en", "s"),
            (None, items[0], "en", "s"), (8, items[3], "en", "s"), (8, items[3], "en", "s"), (9, " ".join(base * 30 + items[4:5]), "en", "s")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(None, "", 1), (90, None, 1), (91, "tiny one", 1)], "item_id long, text string, doc_id int")
    got = tiling.leaks(frame(spark, docs), bench, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.item_id) for r in got), key=str) == sorted([(1, 0), (2, 1), (7, 91), (None, 0), (8, 3), (9, 4)], key=str)
    assert {r.doc_id: r.coverage for r in got}[1] == 1.0
    docs = frame(spark, docs)
    kept = tiling.remove_leaking(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["3", "4", "5", "6", "None"]


def test_empty_tables(spark):
    docs = frame(spark, rows())
    bench = spark.createDataFrame([], "item_id long, text string")
    assert tiling.leaks(docs, bench).count() == 0
    assert tiling.leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0
    assert tiling.remove_leaking(docs, bench).count() == docs.count()
