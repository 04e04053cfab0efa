import numpy as np
import pytest

from pulseframe.llm import mixing
from tests.llm.fixtures import frame, rows, words


def water(sizes, weights=(5, 2, 1), passes=3):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, active, rest = {}, set(names), float(sum(sizes.values()))
    while active:
        share = {s: rest * weight[s] / sum(weight[a] for a in active) for s in active}
        over = {s for s in active if share[s] > passes * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = float(passes * sizes[s])
            rest -= target[s]
        active -= over
    return target


def test_sizes_targets_and_taken(spark):
    data = rows(n=200)
    got = mixing.mix_sizes(frame(spark, data)).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(d), len(words(t))) for d, t, *_ in data)
    sizes = {}
    for _, t, _, s in data:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = sorted(water(sizes).values())
    assert sorted({r.target for r in got}) == pytest.approx(sorted(set(want)))
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    for s in {r.source_size for r in got}:
        part = [r for r in got if r.source_size == s]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 0.05 * part[0].target + 3 * mixing.BLOCK
    again = mixing.mix_sizes(frame(spark, data).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(4)
    for sizes in ({f"s{i}": int(rng.integers(0, 1000)) for i in range(30)} | {None: 50}, {"a": 1, "b": 1000}, {"a": 0}):
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(table).collect()}
        assert got == pytest.approx(water(sizes))


def test_permutation_is_one():
    for n in (1, 2, 3, 64, 1000):
        image = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(image.tolist()) == list(range(n))


def test_texts_hold_what_the_sizes_say(spark):
    docs = frame(spark, rows())
    mixed = mixing.mix_texts(docs).collect()
    assert all(len(words(r.text)) == r.n_words for r in mixed)
    assert sum(r.n_words for r in mixed) == sum(r.taken for r in mixing.mix_sizes(docs).collect())
    assert len({(r.shard, r.slot) for r in mixed}) == len(mixed)


def test_empty_tables(spark):
    docs = frame(spark, rows())
    assert mixing.mix_sizes(docs.limit(0)).count() == 0
    assert mixing.mix_texts(docs.limit(0)).count() == 0
    nothing = mixing.mix_sizes(docs.where("doc_id in (1000, 1001)")).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in nothing] == [(0, 0, 0.0, 0)] * 2


def test_slots_are_spread_and_portioned(spark, monkeypatch):
    docs = frame(spark, rows(n=200))
    want = sorted(map(str, mixing.mix_sizes(docs).collect()))
    monkeypatch.setattr(mixing, "TASK_SLOTS", 16)
    monkeypatch.setattr(mixing, "HELD_SLOTS", 8)
    mixed = mixing.Mix(docs, shard_slots=32)
    slots = mixed.slots.collect()
    assert mixed.slots.rdd.getNumPartitions() > 1 and len({(r.shard, r.slot) for r in slots}) == len(slots)
    # Turn by turn, a source's slots take each of its blocks once.
    for sid in {r.sid for r in slots}:
        turns = {}
        for r in slots:
            if r.sid == sid:
                turns.setdefault(r["pass"], []).append(r.block)
        assert all(len(set(b)) == len(b) for b in turns.values())
        assert all(set(turns[0]) == set(turns[t]) for t in turns if t < max(turns))
    monkeypatch.undo()
    assert sorted(map(str, mixing.mix_sizes(docs).collect())) == want
