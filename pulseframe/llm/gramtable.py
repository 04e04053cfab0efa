"""Interpolated modified Kneser-Ney model of any number of rows, as a written table that meets the texts in Spark.

The estimates are those of ``kneser``. The log10 probability of a text is a sum over its grams of all lengths: a gram of the
model adds what it gains over backing off, a context the weight that it leaves to the next lower order, any other gram nothing.
So one table (key, value) is the whole model. Texts send the distinct grams of a batch to shards of that table and get back one sum
for each text and shard; no task holds more than one shard, and shards become more as the model grows. A bounded number of the most
frequent entries is held by every task, so that texts send the other grams alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm import kneser
from pulseframe.llm.words import Words, mix, slices
from pulseframe.session import materialise

#: Words with a short code; a gram of up to three of them is a small number, others are 63-bit hashes.
SHORT_CODES = 65_533
#: Shards of the table: so many, or more, so that one holds about so many entries.
SHARDS, SHARD_ENTRIES = 32, 8_000_000
#: Most frequent grams of the highest order that every task holds, at most, besides the words with a short code.
HELD = 1_000_000
#: Text of one block of grams, and entries of the table that are packed at once.
BLOCK_BYTES, PACK_ENTRIES = 4_000_000, 1_000_000

_HASHED = np.uint64(1 << 63)
_PACKED = "shard int, kind int, batch long, n long, keys binary, texts binary, items binary, times binary"
_MODEL, _BLOCK, _ROWS = 0, 1, 2


@dataclass
class GramTable:
    """``words`` are the sorted hashes of the words with a short code and ``codes`` these codes; ``base`` is what any token has.
    ``held`` and ``gains`` are the sorted keys and the values of the entries outside ``table``."""

    order: int
    words: np.ndarray
    codes: np.ndarray
    base: float
    held: np.ndarray
    gains: np.ndarray
    table: DataFrame
    entries: int


def _keys(codes: np.ndarray, order: int, words: np.ndarray, short: np.ndarray) -> list[np.ndarray]:
    """For 1 .. ``order``: the key of so many codes that end at each place."""
    own = np.where(codes <= kneser.END, codes, np.uint64(0))
    if len(words):
        at = np.minimum(np.searchsorted(words, codes), len(words) - 1)
        own = np.where(words[at] == codes, short[at], own)
    out, packed, known = [], np.zeros(len(codes), np.uint64), np.ones(len(codes), bool)
    for k, hashed in enumerate(kneser.grams(codes, order)[1:]):
        moved = np.concatenate([np.zeros(min(k, len(own)), np.uint64), own[: max(0, len(own) - k)]])
        known = known & (moved > 0) & (k < 3)
        packed = packed | moved << np.uint64(16 * min(k, 3))
        out.append(np.where(known, packed, hashed | _HASHED))
    return out


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in slices(batches):
        codes, n = np.unique(Words(texts, lower=True).hashes(), return_counts=True)
        yield pa.record_batch({"code": pa.array(codes.view(np.int64)), "n": pa.array(n, pa.int64())})


def _gram_batches(order: int, words: np.ndarray, short: np.ndarray):
    """Distinct grams of a batch: ``g1`` .. their last words, ``c2`` .. the contexts of these."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            codes, place, _ = kneser.padded(Words(texts, lower=True), order)
            keys = _keys(codes, order, words, short)
            _, first, n = np.unique(keys[-1][place], return_index=True, return_counts=True)
            at = place[first]
            # Of a short gram the parts are read off its key: nulls there shuffle as nothing.
            short_one = keys[-1][at] < _HASHED
            columns = {"n": pa.array(n, pa.int64())}
            columns |= {f"g{k + 1}": pa.array(keys[k][at].view(np.int64), mask=short_one if k + 1 < order else None) for k in range(order)}
            columns |= {f"c{k + 1}": pa.array(keys[k - 1][at - 1].view(np.int64), mask=short_one) for k in range(1, order)}
            yield pa.record_batch(columns)

    return count


def _whole(counts: DataFrame, order: int) -> DataFrame:
    """``counts`` with the parts of short grams."""
    def last(key: Column, n: int) -> Column:
        return key.bitwiseAND(F.lit((1 << 16 * n) - 1))

    top = F.col(f"g{order}")
    made = {f"g{k}": F.coalesce(f"g{k}", last(top, k)) for k in range(1, order)}
    made |= {f"c{k}": F.coalesce(f"c{k}", last(F.shiftright(top, 16), k - 1)) for k in range(2, order + 1)}
    return counts.withColumns(made) if made else counts


def _cut(told: DataFrame) -> Column:
    """The discount of a gram from its count ``k``, with the three discounts of ``told``."""
    t = [float(x) for x in told.agg(*[F.count_if(F.col("k") == i) for i in range(1, 5)]).first()]
    y = t[0] / max(t[0] + 2 * t[1], 1.0)
    d = [max(0.1, min(i - 0.1, i - (i + 1) * y * t[i] / max(t[i - 1], 1.0))) for i in (1, 2, 3)]
    return F.when(F.col("k") >= 3, F.lit(d[2])).when(F.col("k") == 2, F.lit(d[1])).otherwise(F.lit(d[0]))


def _least_held(told: DataFrame) -> int:
    """The least count ``k`` that at most ``HELD`` grams of ``told`` reach."""
    upto = least = 0
    for k, grams in sorted(told.groupBy("k").count().collect(), reverse=True):
        upto += grams
        if upto > HELD:
            break
        least = k
    return least or 1 << 62


def _gained(told: DataFrame, context: DataFrame, lower: DataFrame, shares: bool) -> DataFrame:
    """(g, value[, p]): each join carries the gram and what it has beyond backing off, and its probability where a higher order needs it."""
    more = (F.col("k") - F.col("cut")) / F.col("left")
    weight = [(F.col("left") / F.col("total")).alias("w")] if shares else []
    met = told.join(context, "c").select("g", "s", more.alias("more"), *weight)
    gain = F.lit(1.0) + F.col("more") / F.col("low")
    met = met.join(lower.select(F.col("g").alias("s"), F.col("p").alias("low")), "s")
    return met.select("g", F.log10(gain).alias("value"), *([(F.col("w") * F.col("low") * gain).alias("p")] if shares else []))


def train(rows: DataFrame, order: int) -> GramTable:
    """Fit to all ``rows(text)``. Without rows every token gets an equal share."""
    seen = rows.select("text").mapInArrow(_word_batches, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    frequent = seen.orderBy(F.desc("n"), "code").limit(SHORT_CODES).toArrow().column("code").to_numpy().view(np.uint64)
    by_hash = np.argsort(frequent)
    words, short = frequent[by_hash], by_hash.astype(np.uint64) + np.uint64(3)

    schema = "n long, " + ", ".join(f"g{k} long" for k in range(1, order + 1)) + "".join(f", c{k} long" for k in range(2, order + 1))
    counts = rows.select("text").mapInArrow(_gram_batches(order, words, short), schema)
    rest = [F.first(c).alias(c) for c in counts.columns if c not in ("n", f"g{order}")]
    counts = materialise(counts.groupBy(f"g{order}").agg(F.sum("n").alias("n"), *rest), "grams")
    entries, counts = counts.count(), _whole(counts, order)

    base, lower, parts, often = 0.0, None, [], []
    for k in range(1, order + 1):
        names = ([F.first(f"c{k}").alias("c"), F.first(f"g{k - 1}").alias("s")]) if k > 1 else []
        if k == order:
            told = counts.select(F.col(f"g{k}").alias("g"), F.col("n").alias("k"), *([F.col(f"c{k}").alias("c"), F.col(f"g{k - 1}").alias("s")] if k > 1 else []))
        else:
            above = counts if k + 1 == order else counts.groupBy(f"g{k + 1}").agg(*[F.first(c).alias(c) for c in counts.columns if c[1:].isdigit() and int(c[1:]) <= k])
            told = materialise(above.groupBy(F.col(f"g{k}").alias("g")).agg(F.count("*").alias("k"), *names), "told")
        told = told.withColumn("cut", _cut(told))
        if k == 1:
            distinct, total, left = told.agg(F.count("*"), F.sum("k"), F.sum("cut")).first()
            if not distinct:
                none = told.select(F.col("g").alias("key"), F.col("cut").alias("value"))
                return GramTable(order, words, short, 0.0, np.zeros(0, np.uint64), np.zeros(0), none, 0)
            low = left / total / (distinct + 1)
            base = float(np.log10(low))
            own = told.select("g", ((F.col("k") - F.col("cut")) / F.lit(total) + F.lit(low)).alias("p")).withColumn("value", F.log10("p") - F.lit(base))
        else:
            context = materialise(told.groupBy("c").agg(F.sum("k").alias("total"), F.sum("cut").alias("left")), "contexts")
            parts.append(context.select(F.col("c").alias("key"), F.log10(F.col("left") / F.col("total")).alias("value")))
            if k == order:
                least = _least_held(told)
                often.append(_gained(told.where(F.col("k") >= least), context, lower, False).select(F.col("g").alias("key"), "value"))
                told = told.where(F.col("k") < least)
            own = _gained(told, context, lower, k < order)
        if k < order:
            lower = own = materialise(own, "shares")
        parts.append(own.select(F.col("g").alias("key"), "value"))
    # A word's gram and its context share a key. Short words are in the first two parts only.
    single = F.col("key").between(1, (1 << 16) - 1)
    table = reduce(DataFrame.unionAll, parts).where(~single)
    held = reduce(DataFrame.unionAll, [*often, reduce(DataFrame.unionAll, parts[:2]).where(single).groupBy("key").agg(F.sum("value").alias("value"))]).toArrow()
    keys, gains = held.column("key").to_numpy().view(np.uint64), held.column("value").to_numpy()
    by = np.argsort(keys)
    return GramTable(order, words, short, base, keys[by], gains[by], table, entries)


def _pack(values: np.ndarray) -> bytes:
    """Values byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences."""
    return np.diff(keys, prepend=np.uint64(0))


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32)


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = [c.split(" ")[0] for c in _PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _table_batches(shards: int):
    """Entries of the table, packed for each shard."""

    def packs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys = np.concatenate([b.column("key").to_numpy() for b in parts]).view(np.uint64)
        values = np.concatenate([b.column("value").to_numpy() for b in parts])
        shard = mix(keys) % np.uint64(shards)
        by = np.lexsort((keys, shard))
        keys, values, ends = keys[by], values[by], np.searchsorted(shard[by], np.arange(shards + 1))
        return _packed_rows([(s, _MODEL, 0, 0, _pack(_steps(keys[a:b])), None, _pack(values[a:b]), None)
                             for s, (a, b) in enumerate(zip(ends, ends[1:])) if a < b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PACK_ENTRIES:
                yield packs(held)
                held = []
        if held:
            yield packs(held)

    return run


def _text_batches(model: tuple, shards: int, names: list[str]):
    """Blocks of (key, texts that hold it, times) for each shard, and the other columns of the rows with the sums of the held entries."""
    order, words, short, known, gains = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for at, (rows, texts) in enumerate(slices(batches, size=BLOCK_BYTES)):
            told, n = Words(texts, lower=True), len(texts)
            codes, _, _ = kneser.padded(told, order)
            sizes = told.counts + order
            text = np.repeat(np.arange(n), sizes)
            place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # A gram of the model counts where it ends at a token, a context where it ends before one.
            valid = [place >= max(order - 2, k) for k in range(order)]
            keys, inverse = np.unique(np.concatenate([x[v] for x, v in zip(_keys(codes, order, words, short), valid)]), return_inverse=True)
            text = np.concatenate([text[v] for v in valid])
            held = keys < np.uint64(1 << 16)
            gain = np.zeros(len(keys))
            if len(known):
                at_known = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at_known] == keys
                gain[hit], held = gains[at_known[hit]], held | hit
            own = kneser.text_sums(gain[inverse], text, n)
            sent = ~held[inverse]
            keys, inverse, text = keys[~held], (np.cumsum(~held) - 1)[inverse[sent]], text[sent]
            shard = mix(keys) % np.uint64(shards)
            by = np.argsort(shard, kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            held, times = np.unique(rank[inverse] * n + text, return_counts=True)
            keys, ends = keys[by], np.searchsorted(shard[by], np.arange(shards + 1))
            of, texts_of = np.divmod(held, n)
            per, bounds = np.bincount(of, minlength=len(keys)), np.searchsorted(of, ends)
            out = [(s, _BLOCK, part | at, n, _pack(_steps(keys[a:b])), _pack(_small(per[a:b])), _pack(_small(texts_of[i:j])), _pack(_small(times[i:j])))
                   for s, (a, b, i, j) in enumerate(zip(ends, ends[1:], bounds, bounds[1:])) if a < b]
            facts = pa.record_batch({c: rows.column(c) for c in names} | {"n_tokens": pa.array(told.counts + 1, pa.int64()), "own": pa.array(own, pa.float64())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, facts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(facts)
            yield _packed_rows([*out, (at % shards, _ROWS, part | at, n, None, None, sink.getvalue().to_pybytes(), None)])

    return run


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the packed rows of a shard, its table first: the sum of every text of a block; the rows' columns pass through."""
    at, parts, table = None, [], None
    for batch in batches:
        for i in range(batch.num_rows):
            shard, kind, number, n, keys, per, items, times = (c[i].as_py() for c in batch.columns)
            if shard != at:
                at, parts, table = shard, [], None
            if kind == _MODEL:
                parts.append((np.cumsum(_unpack(keys, np.uint64), dtype=np.uint64), _unpack(items, np.float64)))
                continue
            if kind == _ROWS:
                out = (-1, number, items)
            else:
                if table is None:
                    own, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in parts]]), return_inverse=True)
                    table, parts = (own, np.bincount(place, np.concatenate([np.zeros(0), *[v for _, v in parts]]), len(own))), []
                wanted = np.cumsum(_unpack(keys, np.uint64), dtype=np.uint64)
                found = kneser._find(table[0], table[1][:, None], wanted, 0.0)[:, 0]
                value = np.repeat(found, _unpack(per, np.uint32)) * _unpack(times, np.uint32)
                out = (shard, number, np.bincount(_unpack(items, np.uint32), value, n).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.binary()))], ["shard", "batch", "items"])


def _sum_batches(base: float):
    """The rows of each block, with the sums of all shards in the order of the shards."""

    def told(facts: bytes, sums: np.ndarray) -> pa.RecordBatch:
        rows = pa.ipc.open_stream(facts).read_all().combine_chunks().to_batches()[0]
        sums, tokens = sums + rows.column("own").to_numpy(), rows.column("n_tokens").to_numpy()
        rows = rows.select([c for c in rows.schema.names if c != "own"])
        return rows.append_column("log10_perplexity", pa.array(-(sums / tokens + base)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = sums = None
        for batch in batches:
            for shard, items in zip(batch.column("shard").to_pylist(), batch.column("items").to_pylist()):
                if shard < 0:
                    if facts is not None:
                        yield told(facts, sums)
                    facts, sums = items, 0.0
                else:
                    sums = sums + np.frombuffer(items)
        if facts is not None:
            yield told(facts, sums)

    return run


def perplexities(rows: DataFrame, model: GramTable) -> DataFrame:
    """The columns of ``rows`` without ``text``, and n_tokens and log10_perplexity of every row's whole text."""
    shards = max(SHARDS, -(-model.entries // SHARD_ENTRIES))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    table = model.table.mapInArrow(_table_batches(shards), _PACKED)
    held = (model.order, model.words, model.codes, model.held, model.gains)
    blocks = rows.mapInArrow(_text_batches(held, shards, [f.name for f in kept]), _PACKED)
    met = table.unionAll(blocks).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "batch")
    sums = met.mapInArrow(_lookup, "shard int, batch long, items binary")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n_tokens long, log10_perplexity double"
    return sums.repartition("batch").sortWithinPartitions("batch", "shard").mapInArrow(_sum_batches(model.base), schema)
