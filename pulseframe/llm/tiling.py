"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a seed of ``SEED`` words become candidates. For each candidate pair the longest
common runs that do not overlap are marked, longest first: rounds of running Karp-Rabin hash the unmarked windows of the
present length of the item, look the document's windows up, and shorten the length when nothing is found. The item's
covered share decides, so a passage whose parts were reordered is found as well.

Items are dealt into blocks of bounded size and each block is held against all documents (a query set against all rows, in
blocks), so what a task holds does not grow with the benchmark, and no document is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.words import Words, bound_batches, slices, text_rows, windows
from pulseframe.session import materialise

#: Shortest run of words that counts; it is also the shared seed.
SEED = 4
#: Covered share of an item's words from which a document leaks it.
THRESHOLD = 0.6
#: Items with fewer words are compared as a whole (they must occur entirely).
BLOCK_BYTES = 4_000_000

_MULTIPLIER = np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))


def _window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Rolling hashes of all windows of ``size`` codes."""
    n = len(codes)
    if n < size:
        return np.zeros(0, np.uint64)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _MULTIPLIER)]), dtype=np.uint64)
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * power[:n], dtype=np.uint64)])
    return (sums[size:] - sums[:-size]) * back[: n - size + 1]


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two code arrays: (start in item, start in document, length), longest first; ties by position.

    Codes are compared, hashes only find the places. Tiles overlap neither in the item nor in the document.
    """
    free_item, free_doc, found = np.ones(len(item), bool), np.ones(len(doc), bool), []
    size = min(len(item), len(doc))
    while size >= least:
        at: dict[int, list[int]] = {}
        for i, h in enumerate(_window_hashes(item, size).tolist()):
            if free_item[i : i + size].all():
                at.setdefault(h, []).append(i)
        longest = 0
        if at:
            places = np.flatnonzero(np.isin(_window_hashes(doc, size), np.array(list(at), np.uint64)))
            hashes = _window_hashes(doc, size)
            for j in places.tolist():
                if not free_doc[j : j + size].all():
                    continue
                for i in at[int(hashes[j])]:
                    if free_item[i : i + size].all() and np.array_equal(item[i : i + size], doc[j : j + size]):
                        found.append((i, j, size))
                        free_item[i : i + size] = free_doc[j : j + size] = False
                        longest = size
                        break
        if longest:
            continue
        # No match of this length is left: bisect down to the greatest length that still has one.
        low, high = least - 1, size - 1
        while low < high:
            middle = (low + high + 1) // 2
            mine = {h for i, h in enumerate(_window_hashes(item, middle).tolist()) if free_item[i : i + middle].all()}
            theirs = (h for j, h in enumerate(_window_hashes(doc, middle).tolist()) if free_doc[j : j + middle].all())
            low, high = (middle, high) if any(h in mine for h in theirs) else (low, middle - 1)
        size = low
    return found


class _Block:
    """Items of one block: word codes, and for each seed hash the items that hold it."""

    def __init__(self, ids: list, texts: list, seed: int):
        words = Words(texts, lower=True)
        codes = words.hashes()
        self.ids, self.items = ids, [codes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        pairs = []
        for k, item in enumerate(self.items):
            size = min(seed, len(item))
            if size:
                pairs.append(np.stack([windows(item, size), np.full(len(item) - size + 1, k, np.uint64), np.full(len(item) - size + 1, size, np.uint64)]))
        joined = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((3, 0), np.uint64)
        #: By the seed's size (shorter than usual only for items shorter than a seed): sorted hashes and their items.
        self.seeds = {int(s): (joined[0][joined[2] == s], joined[1][joined[2] == s].astype(np.int64)) for s in np.unique(joined[2])}
        self.words = np.unique(codes)


def _matcher(block: _Block, seed: int, threshold: float):
    def match(batches):
        for rows, texts in slices(batches):
            words = Words(texts, lower=True)
            codes = words.hashes()
            if not len(codes) or not len(block.words):
                continue
            out = {c: [] for c in ("row", "item", "covered", "item_words", "tiles")}
            pairs = []
            for size, (hashes, owners) in block.seeds.items():
                spans = windows(codes, size)
                if not len(spans):
                    continue
                left = np.searchsorted(hashes, spans)
                hit = np.flatnonzero(hashes[np.minimum(left, len(hashes) - 1)] == spans)
                hit = hit[words.text[hit] == words.text[hit + size - 1]]
                left = left[hit]
                n = np.searchsorted(hashes, spans[hit], side="right") - left
                place = np.repeat(hit, n)
                owner = owners[np.repeat(left, n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]
                pairs.append(np.stack([words.text[place], owner, place, np.full(len(place), size)]))
            if not pairs or not sum(p.shape[1] for p in pairs):
                continue
            text, owner, place, size = np.concatenate(pairs, axis=1)
            order = np.lexsort((place, owner, text))
            text, owner, place, size = text[order], owner[order], place[order], size[order]
            cut = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (owner[1:] != owner[:-1]), [True]]))
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                item = block.items[owner[x]]
                # An upper bound of the coverage: distinct item words that lie in the document's seeds.
                reach = np.unique((place[x:y, None] + np.arange(size[x])).reshape(-1))
                if np.isin(item, codes[reach]).sum() < threshold * len(item):
                    continue
                # Only seeds can hold tiles: the document is cut to its seeds, with a gap between pieces.
                gap = np.flatnonzero(np.diff(reach) > 1) + 1
                doc = np.concatenate([np.append(p, np.uint64(k)) for k, p in enumerate(np.split(codes[reach], gap))])
                found = tiles(item, doc, min(seed, len(item)))
                covered = sum(t[2] for t in found)
                if covered >= threshold * len(item):
                    for c, v in zip(out, (int(text[x]), block.ids[owner[x]], covered, len(item), len(found))):
                        out[c].append(v)
            if out["row"]:
                yield pa.record_batch({
                    "doc_id": rows.column("doc_id").take(pa.array(out["row"])).cast(pa.int64()), "item_id": pa.array(out["item"], pa.int64()),
                    "item_words": pa.array(out["item_words"], pa.int64()), "covered_words": pa.array(out["covered"], pa.int64()),
                    "n_tiles": pa.array(out["tiles"], pa.int64())})

    return match


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, n_tiles, coverage): each benchmark item that a document leaks.

    Words are lower-cased for A-Z. An item with fewer than ``seed`` words must occur as a whole. Null or empty texts and
    items leak nothing; rows without item_id are judged and give a null item_id; rows that repeat a doc_id or item_id are
    judged one by one, and equal findings are one row. Empty tables give no rows.
    """
    bound_batches(docs.sparkSession)
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-2 * total // block_bytes) if total > block_bytes else 1
    dealt = materialise(items.where("length(text) > 0").withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    rows = text_rows(docs, "doc_id", "text")
    found = None
    for b in range(blocks):
        part = sorted(dealt.where(F.col("block") == b).collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        block = _Block([r["item_id"] for r in part], [r["text"].encode() for r in part], seed)
        own = rows.mapInArrow(_matcher(block, seed, threshold), "doc_id long, item_id long, item_words long, covered_words long, n_tiles long")
        found = own if found is None else found.union(own)
    return found.distinct().withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def remove_leaking(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document leaks no item, with all their columns. Rows without doc_id are kept."""
    bad = leaks(docs.where(docs["doc_id"].isNotNull()), benchmark, **options).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["__leak"], "left_anti")
