import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import simhash
from pulseframe.session import materialise as write_frame
from tests.llm.fixtures import frame, lower, rows, words


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(parent)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if near(a, b):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {n: find(n) for n in parent}


def fingerprint(spark, text):
    w = words(lower(text))
    spans = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [r.h & (1 << 64) - 1 for r in spark.createDataFrame([(s,) for s in spans], "s string").select(F.xxhash64("s").alias("h")).collect()]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_rows_equal_brute_force(spark):
    data = rows()
    print_of = {t: fingerprint(spark, t) for t in {r[1] for r in data}}
    sets = {}
    for doc, text, *_ in data:
        sets.setdefault(doc, set()).add(print_of[text])
    known = {d: s for d, s in sets.items() if d is not None}
    group = roots(known, lambda a, b: any((x ^ y).bit_count() <= 3 for x in known[a] for y in known[b]))
    got = simhash.simhash_near_duplicates(frame(spark, data))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=str)
    assert found == sorted(((d, f"{print_of[t]:016x}", group.get(d)) for d, t, *_ in data), key=str)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def codes_of(kind):
    rng = random.Random(kind)
    if kind == "random":
        out = [rng.getrandbits(64) for _ in range(150)]
        return out + [x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for x in out[:80]]
    if kind == "chain":  # each code three bits from the last: one component that no star covers
        out = [0]
        for i in range(60):
            out.append(out[-1] ^ 7 << i % 62)
        return out
    half = rng.getrandbits(32) << 32  # one hot half: several groups and single codes share all upper bits
    centres = [rng.getrandbits(32) for _ in range(12)]
    return [half | rng.choice(centres) ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32) for _ in range(250)] + [half | rng.getrandbits(32) for _ in range(60)]


@pytest.mark.parametrize("kind", ["random", "chain", "hot"])
def test_components_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 40)
    codes = sorted({signed(c) for c in codes_of(kind)})
    want = roots(codes, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    found = {r.node: r.component for r in simhash.linked(spark.createDataFrame([(c,) for c in codes], "fp long")).collect()}
    assert {c: found.get(c, c) for c in codes} == want


def test_long_text_is_hashed_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 517}x{i % 13}" for i in range(5000)).encode()
    whole = simhash.fingerprints([b"a b c d", text, None])
    monkeypatch.setattr(simhash, "_PIECE", 77)
    assert np.array_equal(whole, simhash.fingerprints([b"a b c d", text, None]))
    assert whole[2] == 0


def test_empty_table(spark):
    assert simhash.simhash_near_duplicates(frame(spark, rows()).limit(0)).count() == 0


def test_expanded_sides_are_not_broadcast(spark, monkeypatch):
    plans = {}

    def seen(df, name, write=simhash.materialise):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(simhash, "materialise", seen)
    codes = write_frame(spark.createDataFrame([(i * 0x9E3779B97F4A7C15 % (1 << 63),) for i in range(50)], "fp long"), "codes")  # of known size
    assert simhash.linked(codes).count() == 0
    assert "SortMergeJoin" in plans["fetched"] and "Broadcast" not in plans["fetched"]
