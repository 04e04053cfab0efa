import hashlib
import random
import tracemalloc

import pyarrow as pa

from pulseframe.llm import superkmers
from tests.llm.fixtures import frame, rows, words


def brute(data, window=13):
    first = {}
    for doc, text, *_ in data:
        w = words(text)
        for i in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text, *_ in data:
        w, gone = words(text), set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def few_words(seed=3):
    """Texts over four words: many equal grams, windows that repeat inside and between texts."""
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("abcd" if i % 2 else "ab") for _ in range(rng.randint(5, 80))), "en", "s") for i in range(60)]


def test_digest_equals_brute_force(spark):
    for data in (rows(), few_words()):
        got = superkmers.removal_digest(frame(spark, data)).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(data)


def test_a_frequent_gram_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(superkmers, "HEAVY", 16)
    data = few_words(9)
    got = superkmers.removal_digest(frame(spark, data)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(data)


def test_cut_texts_keep_columns_and_white_space(spark):
    data = rows()
    docs = frame(spark, data)
    out = superkmers.remove_repeats(docs)
    assert out.columns == docs.columns
    want = {}
    for doc, n, removed, digest in brute(data):
        if not removed or removed < n:
            want.setdefault(doc, []).append(digest)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest())
        assert r.n_chars is None if r.text is None else r.n_chars == len(r.text)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    untouched = {d: t for d, t, *_ in data if d is not None and [x for x in brute(data) if x[0] == d][0][2] == 0}
    assert all(r.text == untouched[r.doc_id] for r in out.where("doc_id is not null").collect() if r.doc_id in untouched and r.doc_id < 1000)


def test_empty_table(spark):
    docs = frame(spark, rows()).limit(0)
    assert superkmers.removal_digest(docs).count() == 0
    assert superkmers.remove_repeats(docs).count() == 0


def test_memory_of_a_task_in_proportion_to_its_strings():
    """Arrays of words cover a slice of a pack or bucket, not the whole."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghik") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    data = [" ".join(rng.choices(vocabulary, k=5000)) for _ in range(120)]
    batch = pa.record_batch({"doc_id": pa.array(range(120), pa.int64()), "tag": pa.array([0] * 120, pa.int32()), "text": data})
    size = sum(map(len, data))
    tracemalloc.start()
    try:
        blocks = [b for found in superkmers._packer([], 1)(iter([batch])) for b in found.column("block").to_pylist()]
        assert tracemalloc.get_traced_memory()[1] < 18 * size
        tracemalloc.reset_peak()
        assert superkmers._bucket_runs(blocks) is None
        strings = sum(map(len, superkmers._open(blocks)[0]))
        assert tracemalloc.get_traced_memory()[1] < 10 * strings, tracemalloc.get_traced_memory()[1] / strings
    finally:
        tracemalloc.stop()
