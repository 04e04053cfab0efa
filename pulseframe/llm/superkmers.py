"""Removal of passages that repeat an earlier document, by super-k-mer partitioning.

Every window of ``WINDOW`` words has a minimiser: the least hash among its ``GRAM``-word grams. Consecutive windows with the
same minimiser travel as one packed string to that minimiser's bucket, where equal windows meet; they are compared as
strings. Grams that make up over 1/``HEAVY`` of the corpus rank behind all others (there are at most ``HEAVY`` of
them), so a passage in a third of all documents sends its neighbourhood to many buckets, and windows that lie wholly inside
it are combined to one string with a list of places in each batch before they are shuffled. A batch sends one compressed
block to each bucket. Buckets grow in number with the input's partitions, so a bucket's size does not grow.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.words import BATCH_BYTES, Words, slices, tagged, windows
from pulseframe.session import materialise

WINDOW = 13
GRAM = 2
HEAVY = 4096
#: Buckets for each partition of the input.
BUCKETS_PER_PARTITION = 8
PACK_BYTES = 4_000_000
_LATE = np.uint64(1 << 63)


def _valid(words: Words, window: int) -> np.ndarray:
    left = np.repeat(words.first[1:], words.counts) - np.arange(len(words.starts))
    return left >= window


def _heavy_batches(batches):
    """Grams that are frequent in one batch, and the number of grams of the batch (under a null gram)."""
    for _, texts in slices(batches, size=PACK_BYTES):
        words = Words(texts)
        grams = windows(words.hashes(), GRAM)[_valid(words, GRAM)[: max(0, len(words.starts) - GRAM + 1)]]
        value, count = np.unique(grams, return_counts=True)
        # Half of the final share: a gram above the final share passes in so many batches that its sum does as well.
        often = count * 2 * HEAVY >= max(len(grams), 32 * HEAVY // 16)
        value, count = value[often].view(np.int64).tolist(), count[often].tolist()
        yield pa.record_batch({"gram": pa.array([None, *value], pa.int64()), "n": pa.array([len(grams), *count], pa.int64())})


def heavy_grams(rows: DataFrame) -> list[int]:
    """The grams (as 64-bit hashes) above 1/HEAVY of all grams; at most HEAVY of them. They steer the buckets, not the result."""
    sums = rows.mapInArrow(_heavy_batches, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    sums = materialise(sums, "grams")
    total = sums.where("gram is null").first()
    if total is None or not total["n"]:
        return []
    found = sums.where("gram is not null").where(F.col("n") * HEAVY > total["n"]).orderBy(F.desc("n"), "gram").limit(HEAVY)
    return [r["gram"] for r in found.collect()]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _plain(words: Words) -> tuple[bytes, np.ndarray]:
    """All words joined by one space, and where each begins."""
    space = np.ones(len(words.bytes), np.int8)
    space[words.starts] += 1
    inside = np.zeros(len(words.bytes) + 1, np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    keep = inside.copy()
    keep[words.ends] = True
    out = np.where(inside, words.bytes, 32).astype(np.uint8)[keep]
    begin = np.concatenate([[0], np.cumsum(words.ends - words.starts + 1)])
    return out.tobytes(), begin


def _super_kmers(rows: pa.RecordBatch, texts: list, late: np.ndarray, buckets: int):
    """Bucket, string, doc_id, tag and word offset of each run of windows with one minimiser; none if no text has a window."""
    words = Words(texts)
    if len(words.starts) < WINDOW:
        return None
    grams = windows(words.hashes(), GRAM)
    rank = grams >> np.uint64(1)
    if len(late):
        at = np.minimum(np.searchsorted(late, grams), len(late) - 1)
        rank[late[at] == grams] |= _LATE
    least = _sliding_min(rank, WINDOW - GRAM + 1)
    place = np.flatnonzero(_valid(words, WINDOW))
    if not len(place):
        return None
    least = least[place]
    cut = np.concatenate([[True], (least[1:] != least[:-1]) | (place[1:] != place[:-1] + 1)])
    run = np.flatnonzero(cut)
    start, size = place[run], np.diff(np.concatenate([run, [len(place)]]))
    bucket = (least[run] % np.uint64(buckets)).astype(np.int64)
    text, begin = _plain(words)
    a, b = begin[start].tolist(), (begin[start + size + WINDOW - 1] - 1).tolist()
    owner = words.text[start]
    doc = rows.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[owner]
    tag = rows.column("tag").to_numpy(zero_copy_only=False).astype(np.int32)[owner]
    return bucket, [text[x:y] for x, y in zip(a, b)], doc, tag, (start - words.first[owner]).astype(np.int32)


def _packer(heavy: list[int], buckets: int):
    def pack(batches):
        late = np.array(heavy, np.int64).view(np.uint64)
        late.sort()
        press, held, total = zstandard.ZstdCompressor(level=6), [], 0
        # The arrays of words cover a slice; only its strings wait for the others of their pack.
        for rows, texts in slices(batches):
            if (found := _super_kmers(rows, texts, late, buckets)) is not None:
                held.append(found)
                total += sum(len(t) for t in texts if t)
            if total >= PACK_BYTES:
                yield _blocks(held, press)
                held, total = [], 0
        if held:
            yield _blocks(held, press)

    return pack


def _blocks(held: list, press: zstandard.ZstdCompressor) -> pa.RecordBatch:
    """One compressed block for each bucket."""
    bucket, doc, tag, offset = (np.concatenate([x[k] for x in held]) for k in (0, 2, 3, 4))
    every = [s for x in held for s in x[1]]
    order = np.argsort(bucket, kind="stable")
    strings = [every[i] for i in order.tolist()]
    doc, tag, offset, bucket = doc[order], tag[order], offset[order], bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    out = []
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
        names: dict[bytes, int] = {}
        which = np.array([names.setdefault(s, len(names)) for s in strings[x:y]], np.int32)
        body = b"".join([np.array([y - x, len(names)], np.int64).tobytes(), np.diff(doc[x:y], prepend=0).tobytes(), which.tobytes(),
                         tag[x:y].tobytes(), offset[x:y].tobytes(), b"\n".join(names)])
        out.append(press.compress(body))
    return pa.record_batch({"bucket": pa.array(bucket[edges[:-1]], pa.int64()), "block": pa.array(out, pa.binary())})


def _open(blocks: list[bytes]):
    """Packed strings of all blocks, and of each place: doc, tag, word offset and the number of its string."""
    press, strings, parts = zstandard.ZstdDecompressor(), [], []
    for block in blocks:
        body = press.decompress(block)
        n = int(np.frombuffer(body, np.int64, 1)[0])
        doc = np.cumsum(np.frombuffer(body, np.int64, n, 16))
        which, tag, offset = (np.frombuffer(body, np.int32, n, 16 + 8 * n + 4 * n * k) for k in range(3))
        parts.append((doc, tag, offset, which.astype(np.int64) + len(strings)))
        strings += body[16 + 20 * n :].split(b"\n")
    return strings, [np.concatenate(x) for x in zip(*parts)]


def _string_windows(strings: list[bytes]) -> list[np.ndarray]:
    """Hash, string, word offset and the bytes from and to of every window; the words of a slice of the strings are held at once."""
    parts, start, total = [], 0, 0
    for i, s in enumerate(strings, 1):
        total += len(s)
        if total < BATCH_BYTES and i < len(strings):
            continue
        words = Words(strings[start:i])
        place = np.flatnonzero(_valid(words, WINDOW))
        owner = words.text[place]
        before = words.starts[words.first[owner]]  # a string begins with a word
        parts.append((windows(words.hashes(), WINDOW)[place], (owner + start).astype(np.int32), (place - words.first[owner]).astype(np.int32),
                      (words.starts[place] - before).astype(np.int32), (words.ends[place + WINDOW - 1] - before).astype(np.int32)))
        start, total = i, 0
    return [np.concatenate(x) for x in zip(*parts)]


def _bucket_runs(blocks: list[bytes]) -> pa.RecordBatch | None:
    """Runs of words (doc_id, tag, start, size) in this bucket that an earlier document has as well."""
    strings, (doc, tag, offset, which) = _open(blocks)
    least = np.full(len(strings), np.iinfo(np.int64).max)
    most = np.full(len(strings), np.iinfo(np.int64).min)
    np.minimum.at(least, which, doc)
    np.maximum.at(most, which, doc)
    value, owner, at, begin, end = _string_windows(strings)
    order = np.argsort(value, kind="stable")
    value = value[order]
    cut = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    low, high = np.minimum.reduceat(least[owner[order]], cut), np.maximum.reduceat(most[owner[order]], cut)
    several = np.zeros(len(owner), bool)
    several[order] = np.repeat(low < high, np.diff(np.concatenate([cut, [len(owner)]])))
    del value, order
    owner, at, begin, end = owner[several], at[several], begin[several], end[several]
    if not len(owner):
        return None
    # The windows that seem to meet are compared as strings.
    texts = [strings[o][x:y] for o, x, y in zip(owner.tolist(), begin.tolist(), end.tolist())]
    earliest: dict[bytes, int] = {}
    for text, d in zip(texts, least[owner].tolist()):
        if d < earliest.get(text, d + 1):
            earliest[text] = d
    first = np.array([earliest[t] for t in texts], np.int64)
    del texts, earliest
    # Every place of a string with every such window of the string.
    begin = np.searchsorted(owner, np.arange(len(strings) + 1))
    n = np.diff(begin)[which]
    total = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(which)), n)
    window = np.arange(total[-1]) - total[:-1][row] + begin[:-1][which][row]
    hit = first[window] < doc[row]
    row, window = row[hit], window[hit]
    if not len(row):
        return None
    at = offset[row] + at[window]
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]))
    size = np.diff(np.concatenate([cut, [len(row)]])) + WINDOW - 1
    row = row[cut]
    return pa.record_batch({"doc_id": pa.array(doc[row]), "tag": pa.array(tag[row]),
                            "start": pa.array(at[cut], pa.int32()), "size": pa.array(size, pa.int32())})


def _reduce_batches(batches):
    """Rows come sorted by bucket: work on one bucket at a time."""
    now, blocks = None, []
    for batch in batches:
        for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
            if bucket != now and blocks:
                if (found := _bucket_runs(blocks)) is not None:
                    yield found
                blocks = []
            now = bucket
            blocks.append(block)
    if blocks and (found := _bucket_runs(blocks)) is not None:
        yield found


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, start, size): word runs made of windows that also start in a document with a smaller doc_id."""
    rows = tagged(docs.where(docs["doc_id"].isNotNull()), "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    partitions = max(1, rows.rdd.getNumPartitions())
    blocks = rows.mapInArrow(_packer(heavy_grams(rows), BUCKETS_PER_PARTITION * partitions), "bucket long, block binary")
    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _reduce_batches, "doc_id long, tag int, start int, size int")


def _mask(text: bytes | None, runs: list | None):
    words = (text or b"").split()
    gone = np.zeros(len(words) + 1, np.int32)
    for r in runs or ():
        gone[r["start"]] += 1
        gone[r["start"] + r["size"]] -= 1
    return words, np.cumsum(gone[:-1]) > 0


def _digest_batches(batches):
    for rows, texts in slices(batches):
        n, removed, digest = [], [], []
        for text, runs in zip(texts, rows.column("__runs").to_pylist()):
            if runs:
                words, gone = _mask(text, runs)
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
            else:
                kept = words = (text or b"").split()
            n.append(len(words))
            removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.record_batch({"doc_id": rows.column("doc_id"), "n_words": pa.array(n, pa.int64()),
                               "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})


def _cut_batches(batches):
    for rows, texts in slices(batches):
        out, lost = [], []
        for text, runs in zip(texts, rows.column("__runs").to_pylist()):
            if not runs:
                out.append(text)
                lost.append(False)
                continue
            _, gone = _mask(text, runs)
            words = Words([text])
            keep = np.zeros(len(words.bytes) + 1, np.int32)
            stay = np.flatnonzero(~gone)
            lost.append(not len(stay))
            # A kept word takes the white space behind it along.
            nxt = np.append(words.starts[1:], len(text))
            keep[words.starts[stay]] += 1
            np.subtract.at(keep, nxt[stay], 1)
            out.append(words.bytes[np.cumsum(keep[:-1]) > 0].tobytes().rstrip(b" \t\n\r\x0b\x0c"))
        column = pa.array(out, pa.binary()).cast(rows.column("text").type)
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", column)
        yield rows.filter(pa.array([not x for x in lost], pa.bool_())).drop_columns(["__runs"])


def _with_runs(docs: DataFrame) -> DataFrame:
    runs = repeated_runs(docs).groupBy(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).agg(
        F.collect_list(F.struct("start", "size")).alias("__runs"))
    tag = F.hash(F.coalesce(docs["text"], F.lit("")))
    return docs.withColumn("__tagged", tag).join(runs, (F.col("doc_id") == F.col("__id")) & (F.col("__tagged") == F.col("__tag")), "left").drop("__id", "__tag", "__tagged")


def removal_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs(doc_id, text)``.

    A word goes if a window of 13 words over it also starts in a document with a smaller doc_id; all windows are judged on
    the input. A null text has no words (SHA-256 of nothing). Texts under 13 words lose none. Rows without doc_id neither
    remove nor lose words. Rows that repeat a doc_id do not remove each other's words. An empty table gives no rows.
    """
    rows = _with_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.select("doc_id", "text", "__runs").mapInArrow(
        _digest_batches, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words cut from ``text``; other rows and the white space between kept words stay as they are.

    A document that loses every word goes; ``n_chars``, if there, is set anew. Cases as in ``removal_digest``.
    """
    from pyspark.sql.types import StructType

    rows = _with_runs(docs)
    schema = StructType([f for f in rows.schema.fields if f.name != "__runs"])
    out = rows.mapInArrow(_cut_batches, schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
