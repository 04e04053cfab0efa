"""Ranked lexical search: branch-and-bound over trees of frequency-ordered term vectors.

A document is restricted to the terms that the items use, and its terms are ordered by document frequency, the most frequent first.
The ordered vectors of a batch of documents form a prefix tree (an FP-tree): documents share the path of their common
terms, paths without a branch are one edge, and fewer than ``LEAF`` documents below a node stay a list. Every node holds the
greatest tf of each term in its subtree and the least m, so a score is bounded from above for all documents below it. Each
item is searched depth first, the branch with the greatest bound first; a branch whose bound is below the item's tenth score so
far is not entered. Documents reached are scored exactly, so nothing is lost.

A task holds one tree at a time, of bounded size, and ten findings per item; the findings of all tasks are ranked in the end.
Items are taken in blocks of bounded size against all documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.words import Words, slices, text_rows
from pulseframe.session import materialise, spread

TOP = 10
#: Documents below a node that are not branched further.
LEAF = 32
#: Vector entries of one tree, and its documents.
TREE_ENTRIES = 1_000_000
TREE_DOCS = 20_000
#: Bytes of item texts in one block; a longer item is a block of its own.
BLOCK_BYTES = 4_000_000
#: Pairs of a document or node and a term that are looked up at once.
_CELLS = 1_000_000

# Terms are made of ASCII letters and digits and of all characters beyond ASCII, whose UTF-8 bytes are 0x80 and above.
_BETWEEN = np.ones(256, bool)
_BETWEEN[0x80:] = False
for _first, _last in (b"09", b"AZ", b"az"):
    _BETWEEN[_first : _last + 1] = False


def _terms(texts: list) -> Words:
    return Words(texts, lower=True, between=_BETWEEN)


@dataclass
class Items:
    """A block of items: the sorted hashes of their terms, and for each item its terms' numbers with their counts."""

    ids: list
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    counts: list[np.ndarray]

    @classmethod
    def of(cls, ids: list, texts: list[bytes]) -> Items:
        words = _terms(texts)
        vocabulary, number = np.unique(words.hashes(), return_inverse=True)
        own = [np.unique(number[a:b], return_counts=True) for a, b in zip(words.first[:-1], words.first[1:])]
        return cls(ids, vocabulary, [t for t, _ in own], [c.astype(np.int64) for _, c in own])


def _vector_batches(vocabulary: np.ndarray):
    """Number of terms of each document, and its restricted vector: numbers of the items' terms with their tf."""

    def run(batches):
        for rows, texts in slices(batches):
            words = _terms(texts)
            hashes = words.hashes()
            at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
            hit = np.flatnonzero(vocabulary[at] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
            key, tf = np.unique(words.text[hit] * np.int64(max(len(vocabulary), 1)) + at[hit], return_counts=True)
            owner, term = np.divmod(key, max(len(vocabulary), 1))
            ends = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
            yield pa.record_batch({
                "doc_id": rows.column("doc_id").cast(pa.int64()), "n": pa.array(words.counts, pa.int64()),
                "terms": pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())), "tfs": pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())),
            })

    return run


class Tree:
    """Prefix tree of documents with subtree maxima; ``first`` says where each document's ascending terms begin."""

    def __init__(self, first: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray, width: int, leaf: int = LEAF):
        counts = np.diff(first)
        paths = terms.astype(">u4").tobytes()
        order = sorted(range(len(counts)), key=lambda i: paths[4 * first[i] : 4 * first[i + 1]])
        self.order = np.array(order, np.int64)
        take = np.repeat(first[:-1][self.order], counts[self.order])
        self.first = np.concatenate([[0], np.cumsum(counts[self.order])])
        take = take + np.arange(len(terms)) - np.repeat(self.first[:-1], counts[self.order])
        self.terms, self.tfs, self.m, self.width = terms[take].astype(np.int64), tfs[take].astype(np.int64), m[self.order], width
        self.doc_keys = np.repeat(np.arange(len(counts), dtype=np.int64), np.diff(self.first)) * width + self.terms
        self._branch(self._shared(), leaf)
        self._maxima()

    def _shared(self) -> np.ndarray:
        """Length of the common path of each document and the one before it."""
        out = np.zeros(len(self.order), np.int64)
        for i in range(1, len(out)):
            a, b = self.terms[self.first[i - 1] : self.first[i]], self.terms[self.first[i] : self.first[i + 1]]
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            at = int(differ.argmax()) if n else 0
            out[i] = at if n and differ[at] else n
        return out

    def _branch(self, shared: np.ndarray, leaf: int) -> None:
        self.children: list[list[int]] = []
        self.docs: list[np.ndarray] = []
        low, todo = [], [(0, len(self.order), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(self.children)
            self.children.append([])
            self.docs.append(np.arange(a, b))
            low.append(self.m[a:b].min() if b > a else 0)
            if parent >= 0:
                self.children[parent].append(node)
            if b - a <= leaf:
                continue
            inner = shared[a + 1 : b]
            edges = np.concatenate([[a], a + 1 + np.flatnonzero(inner == inner.min()), [b]])
            sizes = np.diff(edges)
            self.docs[node] = edges[:-1][sizes == 1]
            todo += [(int(x), int(y), node) for x, y in zip(edges[:-1], edges[1:]) if y - x > 1 and y - x < b - a]
        self.low = np.array(low, np.int64)

    def _maxima(self) -> None:
        """Greatest tf of each term in the subtree of each node, from the leaves up."""
        own: list = [None] * len(self.children)
        for node in reversed(range(len(own))):
            docs = self.docs[node]
            spans = [slice(self.first[d], self.first[d + 1]) for d in docs]
            terms = np.concatenate([*(self.terms[s] for s in spans), *(own[c][0] for c in self.children[node]), np.zeros(0, np.int64)])
            tfs = np.concatenate([*(self.tfs[s] for s in spans), *(own[c][1] for c in self.children[node]), np.zeros(0, np.int64)])
            order = np.argsort(terms, kind="stable")
            terms, tfs = terms[order], tfs[order]
            new = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
            own[node] = terms[new], np.maximum.reduceat(tfs, new) if len(new) else tfs
        sizes = np.array([len(t) for t, _ in own])
        self.node_keys = np.repeat(np.arange(len(own), dtype=np.int64), sizes) * self.width + np.concatenate([t for t, _ in own])
        self.node_tfs = np.concatenate([t for _, t in own])
        self.children = [np.array(c, np.int64) for c in self.children]

    def _scores(self, at: np.ndarray, keys: np.ndarray, tfs: np.ndarray, m: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(at), np.int64)
        step = max(1, _CELLS // len(terms))
        return np.concatenate([self._part(at[i : i + step], keys, tfs, m, terms, weights) for i in range(0, len(at), step)])

    def _part(self, at, keys, tfs, m, terms, weights) -> np.ndarray:
        wanted = at[:, None] * self.width + terms[None, :]
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        tf = np.where(keys[place] == wanted, tfs[place], 0)
        return (weights * (1_000_000_000 * tf // (1000 * tf + 8 * m[at][:, None]))).sum(axis=1)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best, ids: np.ndarray) -> None:
        """Add the documents with the best scores to ``best``; ``ids`` names the documents in the order of the input."""
        stack = [(0, None)]
        while stack:
            node, bound = stack.pop()
            if bound is not None and bound < best.least:
                continue
            docs = self.docs[node]
            if len(docs):
                score = self._scores(docs, self.doc_keys, self.tfs, self.m, terms, weights)
                good = np.flatnonzero(score >= best.least)
                if len(good):
                    best.add(score[good], ids[self.order[docs[good]]])
            below = self.children[node]
            if len(below):
                bounds = self._scores(below, self.node_keys, self.node_tfs, self.low, terms, weights)
                for i in np.argsort(bounds, kind="stable"):
                    if bounds[i] >= best.least:
                        stack.append((int(below[i]), bounds[i]))


class Best:
    """The ``top`` greatest scores above 0 with their ids, equal scores by ascending id."""

    def __init__(self, top: int = TOP):
        self.top, self.least = top, 1
        self.scores = self.ids = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.top:
            self.least = max(1, int(self.scores[-1]))


#: Stands for a missing doc_id inside a task: behind all others.
_NO_ID = np.iinfo(np.int64).max


def _searcher(items: Items, rank: np.ndarray, weights: np.ndarray, total: int, length: int, top: int, leaf: int):
    """Top findings of every item among the rows of a task; ``rank`` orders terms by falling document frequency."""
    queries = []
    for terms, counts in zip(items.terms, items.counts):
        order = np.argsort(rank[terms])
        queries.append((rank[terms][order].astype(np.int64), (weights[terms] * counts)[order]))

    def trees(batches):
        held, entries, rows = [], 0, 0
        for batch in batches:
            start = 0
            sizes = np.diff(batch.column("terms").offsets.to_numpy())
            while start < batch.num_rows:
                room = np.searchsorted(np.cumsum(sizes[start:]), TREE_ENTRIES - entries, side="right")
                end = min(batch.num_rows, start + max(1 if not rows else 0, int(room)), start + TREE_DOCS - rows)
                if end > start:
                    held.append(batch.slice(start, end - start))
                    entries, rows, start = entries + int(sizes[start:end].sum()), rows + end - start, end
                if start < batch.num_rows:
                    yield held
                    held, entries, rows = [], 0, 0
        if held:
            yield held

    def run(batches):
        best = [Best(top) for _ in queries]
        for held in trees(batches):
            ids, n = (np.concatenate([b.column(c).fill_null(_NO_ID).to_numpy(zero_copy_only=False) for b in held]) for c in ("doc_id", "n"))
            terms = np.concatenate([b.column("terms").flatten().to_numpy() for b in held])
            tfs = np.concatenate([b.column("tfs").flatten().to_numpy() for b in held])
            first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b.column("terms").offsets.to_numpy()) for b in held]))])
            owner = np.repeat(np.arange(len(n)), np.diff(first))
            order = np.lexsort((rank[terms], owner))
            m = 25 + 75 * n * total // length
            tree = Tree(first, rank[terms][order], tfs[order], m, len(rank), leaf)
            for query, found in zip(queries, best):
                if len(query[0]):
                    tree.search(*query, found, ids)
        out = [(i, d if d != _NO_ID else None, s) for i, b in enumerate(best) for d, s in zip(b.ids.tolist(), b.scores.tolist())]
        yield pa.record_batch({"item": pa.array([o[0] for o in out], pa.int32()), "doc_id": pa.array([o[1] for o in out], pa.int64()),
                               "score": pa.array([o[2] for o in out], pa.int64())})

    return run


def _search_block(docs: DataFrame, items: Items, top: int, leaf: int) -> DataFrame | None:
    rows = text_rows(docs, "doc_id", "text")
    schema = "doc_id long, n long, terms array<int>, tfs array<int>"
    vectors = materialise(rows.mapInArrow(_vector_batches(items.vocabulary), schema).where("n > 0"), "vectors")
    total, length = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total or not len(items.vocabulary):
        return None
    # At most one row per term of the block.
    found = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
    df = np.zeros(len(items.vocabulary), np.int64)
    for r in found:
        df[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    search = _searcher(items, rank, weights, total, length, top, leaf)
    hits = spread(vectors.where(F.size("terms") > 0)).mapInArrow(search, "item int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = hits.withColumn("rank", place).where(F.col("rank") <= top)
    names = docs.sparkSession.createDataFrame(list(enumerate(items.ids)), "item int, item_id long")
    ranked = ranked.join(names, "item")
    return ranked.select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, leaf: int = LEAF) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item with a score above 0, equal scores by doc_id.

    Items are rows of ``benchmark(item_id, text)``; rows that repeat both are one item, texts that share an item_id are one item with
    the terms of all of them. Null or empty texts hold no terms: such items find nothing, such documents are not counted.
    Rows of ``docs`` that repeat a doc_id are ranked one by one; a row without doc_id is ranked behind equal scores.
    Without documents or items there are no rows. Terms are matched as 64-bit hashes.
    """
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    items = items.where("length(text) > 0").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    dealt = materialise(items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "items")
    found = None
    for b in range(blocks):
        own: dict = {}
        for r in sorted(dealt.where(F.col("block") == b).collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"])):
            own.setdefault(r["item_id"], []).append(r["text"].encode())
        part = _search_block(docs, Items.of(list(own), [b"\n".join(t) for t in own.values()]), top, leaf) if own else None
        if part is not None:
            found = part if found is None else found.union(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
