"""Words of whole texts as flat NumPy arrays, one batch of rows at a time.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return,
that is ``[^\\x20\\x09-\\x0D]+``. A null text has no words. Batches are cut by bytes (``BATCH_BYTES``), so the memory of
a task does not depend on the number of rows or on the length of a source; one text is always kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once inside a task.
BATCH_BYTES = 1_500_000

_PIECE = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def bound_batches(spark: SparkSession, size: int = 8_000_000) -> None:
    """Let Spark cut the Arrow batches of Python stages by bytes; long texts would otherwise fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64, kept between batches."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
        _INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
    return _POWERS, _INVERSES


class Words:
    """Words of several texts: byte positions, the text each belongs to, and a 64-bit hash of each.

    ``between`` marks the bytes that no word holds; the line feed, which ends each text, must be one of them.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False, between: np.ndarray = SPACE):
        self.data = b"\n".join(t or b"" for t in texts) + b"\n"
        if lower:
            self.data = self.data.lower()  # bytes.lower() changes A-Z alone
        self.bytes = np.frombuffer(self.data, np.uint8)
        space = between[self.bytes]
        before = np.concatenate([[True], space[:-1]])
        self.starts = np.flatnonzero(before & ~space)
        self.ends = np.flatnonzero(~before & space)
        lengths = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
        #: Position of the first word of each text, and behind the last one the number of words.
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(lengths)]))
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self) -> np.ndarray:
        """Hash of every word: a polynomial over the bytes' random values, then mixed. Works on a piece at a time."""
        out, i = np.zeros(len(self.starts), np.uint64), 0
        while i < len(out):
            a = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, a + _PIECE, side="right")))
            b = self.ends[j - 1]
            powers, inverses = _powers(int(b - a))
            sums = np.zeros(b - a + 1, np.uint64)
            values = _BYTES[self.bytes[a:b]]
            values *= powers[: b - a]
            np.cumsum(values, out=sums[1:])
            first, last = self.starts[i:j] - a, self.ends[i:j] - a
            out[i:j] = mix((sums[last] - sums[first]) * inverses[first])
            i = j
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive words; position i is the window that starts at word i (texts not regarded)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out += hashes[k : k + size] * np.uint64((2 * k + 3) * 0xD6E8FEB86659FD93 & (1 << 64) - 1 | 1)
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut record batches so that each has about ``size`` bytes of text; yields the rows and their texts as bytes."""
    for batch in batches:
        column = batch.column(text).cast(pa.binary())
        texts = column.to_pylist()
        start = total = 0
        for i, t in enumerate(texts):
            total += len(t) if t else 0
            if total >= size or i + 1 - start >= 20_000:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, total = i + 1, 0
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def text_rows(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that further columns with clashing names never reach an operator."""
    bound_batches(df.sparkSession)
    return df.select(*names)


def tagged(df: DataFrame, *names: str) -> DataFrame:
    """``names`` and ``tag``, a hash of the text that tells apart rows which repeat a doc_id."""
    tag = F.hash(F.coalesce(df["text"], F.lit(""))).alias("tag")
    return text_rows(df.select(*names, tag), *names, "tag")
