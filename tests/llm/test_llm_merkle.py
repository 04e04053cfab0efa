import zlib
from hashlib import sha256

import pytest

from pulseframe.llm import merkle
from tests.llm.fixtures import frame, rows, texts


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc, source, lang, n, text):
    fields = [None if v is None else str(v) for v in (doc, source, lang, n, text)]
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in fields))


def tree(nodes):
    """(root, siblings of each node level by level, with the node's place among them)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for leaf_no, p in enumerate(at):
            start = p - p % 3
            run = level[start : start + 3]
            paths[leaf_no].append((p - start, run[: p - start] + run[p - start + 1 :]))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [p // 3 for p in at]
    return level[0], paths


def brute(data):
    rows_, by = [], {}
    for doc, text, lang, source in data:
        n = len(text or "")
        bad = text.replace("\n", "") if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 else text
        by.setdefault(source, []).append((doc is not None, doc or 0, leaf(doc, source, lang, n, text), leaf(doc, source, lang, n, bad)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: tree([r[2] for r in sorted(by[s])]) for s in sources}
    root, high = tree([low[s][0] for s in sources])
    for s, top in zip(sources, high):
        for (known, doc, digest, bad), path in zip(sorted(by[s]), low[s][1]):
            folded = bad
            for place, others in path + top:
                folded = h(*others[:place], folded, *others[place:])
            proof = h(*(x for _, others in path + top for x in others))
            rows_.append((doc if known else None, digest, low[s][0], root, proof, folded, folded == root))
    return sorted(rows_, key=str)


def line_breaks():
    return [(7000 + i, t.replace(" ", "\n", i % 3), "en", "lines") for i, t in enumerate(texts(75, 9, 6))] + [(8000 + i, "same\ntext", None, None) for i in range(5)]


@pytest.mark.parametrize("height", [1, 2, 7])
@pytest.mark.parametrize("n", [1, 3, 10, 500])
def test_rows_equal_brute_force(spark, height, n):
    data = (line_breaks() + rows())[:n]
    got = merkle.manifest(frame(spark, data), merkle.without_line_breaks(), height=height).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(data)
    assert n < 100 or {r.verified for r in got} == {True, False}


def test_many_sources(spark):
    data = [(i, f"t\n{i}", "en", f"s{i}é" if i % 2 else f"S{i}") for i in range(40)]
    got = merkle.manifest(frame(spark, data), merkle.without_line_breaks(), height=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(data)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 50])
def test_streamed_witnesses_fold_to_the_root(n):
    stream = merkle.Appender()
    nodes = [sha256(bytes([i])).digest() for i in range(n)]
    for node in nodes:
        stream.append(node)
    root, witnesses = stream.finish()
    want, paths = tree([d.hex() for d in nodes])
    assert root.hex() == want and all(merkle.fold(d, w) == root for d, w in zip(nodes, witnesses))
    assert [[(p, [s.hex() for s in others]) for p, others in merkle.siblings(w)] for w in witnesses] == paths


def test_empty_table(spark):
    assert merkle.manifest(frame(spark, rows()).limit(0), merkle.without_line_breaks()).count() == 0
