"""TF-IDF of texts without a shuffled row per term.

Texts are dealt by document key into batches of bounded bytes. A batch asks once for each of its distinct terms, whatever number of its
documents have it: the terms travel as packed strings, dealt over shards by a hash of the term, with the number of the batch's documents that
have each. A shard adds these up and answers every batch with document frequencies and term numbers, in the order asked. Then the texts
meet the answers of their batch, and a task weighs whole documents. Terms are compared as strings; the hash only deals and orders them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from pulseframe.session import materialise

#: Text bytes of one batch, and of the input for each shard of terms.
BATCH_BYTES = 8_000_000
SHARD_BYTES = 16_000_000
_ARROW_BYTES = 16_000_000
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_ASKED = "shard int, batch long, block int, n int, size long, lengths binary, terms binary, docs binary, numbers binary"
_ANSWERED = "batch long, shard int, block int, n int, df binary, number binary"
_FOUND = "shard int, block int, level int, term string, df long, place long"
#: Entries of one document in one block.
WEIGHTS = StructType([StructField("term", ArrayType(LongType())), StructField("tf", ArrayType(LongType())), StructField("df", ArrayType(LongType())),
                      StructField("weight", ArrayType(DoubleType()))])


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, for ``unpacked`` with its length and type."""
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _buffers(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array."""
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset:terms.offset + len(terms) + 1]
    data = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return offsets - offsets[0], data


def _strings(lengths: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def _hashes(terms: pa.Array) -> np.ndarray:
    """64-bit hash of each string."""
    if not len(terms):
        return np.zeros(0, np.uint64)
    offsets, data = _buffers(terms)
    lengths = np.diff(offsets)
    powers = np.cumprod(np.full(max(int(lengths.max(initial=0)), 1), _ODD))
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[place])])
    h = sums[offsets[1:]] - sums[offsets[:-1]] + lengths.astype(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def _ordered(terms: pa.Array, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct terms by (shard, hash, term), and the ends of the shards in it."""
    h = _hashes(terms)
    shard = (h % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((h, shard))
    if len(h) > 1 and (np.diff(h[order]) == 0).any():
        order = np.array(sorted(range(len(h)), key=lambda i: (shard[i], h[i], terms[i].as_py())))
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


class _Terms:
    """Distinct (document, term) pairs of the rows of one batch, for one block."""

    def __init__(self) -> None:
        self.rows, self.codes, self.counts, self.terms, self.size, self.n = [], [], [], [], 0, 0

    def add(self, lists: pa.ListArray) -> None:
        found = lists.flatten().dictionary_encode()
        terms, code = found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(self.n, self.n + len(lists)), np.diff(lists.offsets.to_numpy()))
        key, counts = np.unique(row * max(len(terms), 1) + code, return_counts=True)
        row, code = np.divmod(key, max(len(terms), 1))
        self.rows.append(row), self.codes.append(code + self.size), self.counts.append(counts), self.terms.append(terms)
        self.size, self.n = self.size + len(terms), self.n + len(lists)

    def pairs(self, doc: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct terms; document, term and count of each pair, by document. Rows of one document are one."""
        every = pa.concat_arrays(self.terms).dictionary_encode()
        terms, renamed = every.dictionary, every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = doc[np.concatenate(self.rows)] * max(len(terms), 1) + renamed[np.concatenate(self.codes)]
        key, at = np.unique(key, return_inverse=True)
        document, term = np.divmod(key, max(len(terms), 1))
        return terms, document, term, np.bincount(at, np.concatenate(self.counts), len(key)).astype(np.int64)


class _Batch:
    """The rows of one batch as they come."""

    def __init__(self, blocks: int):
        self.blocks, self.kept, self.answers = [_Terms() for _ in range(blocks)], [], {}

    def add(self, batch: pa.RecordBatch) -> None:
        for i, b in enumerate(self.blocks):
            b.add(batch.column(f"_terms{i}"))
        self.kept.append(batch.drop_columns([f"_terms{i}" for i in range(len(self.blocks))]))

    def documents(self, key: str) -> tuple[pa.Table, np.ndarray, pa.Array]:
        """Rows, the number of each row's document, and the documents' keys; a null key is a document."""
        rows = pa.Table.from_batches(self.kept)
        found = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
        return rows, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _batches(batches: Iterator[pa.RecordBatch], blocks: int) -> dict[int, _Batch]:
    """Rows and answers of a partition by batch."""
    out: dict[int, _Batch] = {}
    for batch in batches:
        number = batch.column("_batch").to_numpy()
        for k in np.unique(number):
            own = batch.filter(pa.array(number == k)) if len(number) else batch
            held = out.setdefault(int(k), _Batch(blocks))
            if "_answer" not in own.schema.names:
                held.add(own)
                continue
            given = own.column("_answer").is_valid()
            for r in own.filter(given).column("_answer").to_pylist():
                held.answers[r["block"], r["shard"]] = (unpacked(r["df"], r["n"], np.int64), unpacked(r["number"], r["n"], np.int64))
            rows = own.filter(pc.invert(given)).drop_columns(["_answer"])
            if rows.num_rows:
                held.add(rows)
    return out


def _asking(key: str, blocks: int, shards: int, copies: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _batches(batches, blocks).items():
            rows, doc, keys = held.documents(key)
            weight = np.ones(len(keys))
            if copies:
                weight[doc] = rows.column("_copies").to_numpy()
            for i, block in enumerate(held.blocks):
                terms, document, term, _ = block.pairs(doc)
                docs = np.bincount(term, weight[document], len(terms)).astype(np.int64)
                yield from _questions(terms, docs, None, number, i, shards)

    return run


def _questions(terms: pa.Array, docs: np.ndarray, numbers: np.ndarray | None, batch: int, block: int, shards: int) -> Iterator[pa.RecordBatch]:
    order, ends = _ordered(terms, shards)
    made = []
    for s in range(shards):
        own = order[ends[s]:ends[s + 1]]
        if len(own):
            offsets, data = _buffers(terms.take(pa.array(own)))
            made.append((s, batch, block, len(own), len(data), packed(np.diff(offsets).astype(np.int32)), packed(data), packed(docs[own]),
                         packed(numbers[own]) if numbers is not None else None))
    if made:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in _ASKED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)


def _known(blocks: int, shards: int) -> Callable:
    """Rows (block, term, df, number) of a given vocabulary, packed like questions of batch -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(blocks):
                own = batch.filter(pc.equal(batch.column("block"), i))
                if own.num_rows:
                    yield from _questions(own.column("term"), own.column("df").to_numpy(), own.column("number").to_numpy(), -1, i, shards)

    return run


def _shard(table: pa.Table) -> Iterator[tuple[int, pa.Array, np.ndarray, list[tuple[dict, np.ndarray]], dict]]:
    """Of each block of a shard: its distinct terms, documents that have each, and the questions with the codes of their terms."""
    rows = table.to_pylist()
    for block in sorted({r["block"] for r in rows}):
        own = sorted((r for r in rows if r["block"] == block), key=lambda r: r["batch"])
        parts = [_strings(unpacked(r["lengths"], r["n"], np.int32), pa.decompress(r["terms"], r["size"], codec="zstd", asbytes=True) if r["size"] else b"") for r in own]
        found = pa.concat_arrays(parts).dictionary_encode()
        code, terms = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
        asked = np.split(code, np.cumsum([r["n"] for r in own])[:-1])
        known = [(r, c) for r, c in zip(own, asked, strict=True) if r["batch"] < 0]
        questions = [(r, c) for r, c in zip(own, asked, strict=True) if r["batch"] >= 0]
        df = np.zeros(len(terms), np.int64)
        for r, c in known or questions:
            df[c] += unpacked(r["docs"], r["n"], np.int64)
        numbers = {"known": bool(known), "of": np.full(len(terms), -1, np.int64)}
        for r, c in known:
            numbers["of"][c] = unpacked(r["numbers"], r["n"], np.int64)
        yield block, terms, df, questions, numbers


def _answer(shards: int, given: bool) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        made, shard = [], table.column("shard")[0].as_py()
        for block, terms, df, questions, numbers in _shard(table):
            # A number no other term has: the place in the shard, then the shard.
            number = numbers["of"] if given else np.arange(len(terms)) * shards + shard
            made += [(r["batch"], shard, block, r["n"], packed(df[c]), packed(number[c])) for r, c in questions]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = list(zip(*made, strict=True)) or [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _ANSWERED.split(", ")])

    return run


def _vocabulary(table: pa.Table) -> pa.Table:
    parts, shard = [], table.column("shard")[0].as_py()
    for block, terms, df, _, _ in _shard(table):
        n, level = len(terms), np.log2(df).astype(np.int32)
        order = np.lexsort((-df, -level))
        first = np.searchsorted(-level[order], -level[order])
        parts.append(pa.table({"shard": pa.array(np.full(n, shard, np.int32)), "block": pa.array(np.full(n, block, np.int32)), "level": pa.array(level[order]),
                               "term": terms.take(pa.array(order)), "df": pa.array(df[order]), "place": pa.array(np.arange(n) - first)}))
    return pa.concat_tables(parts)


def _sizes(df: DataFrame, text_col: str) -> tuple[int, int, int]:
    """Batches and shards for the texts of ``df``, and its number of rows."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()
    return max(1, -(-size // BATCH_BYTES), min(df.sparkSession.sparkContext.defaultParallelism, rows)), max(1, -(-size // SHARD_BYTES)), rows


def _dealt(df: DataFrame, key: str, batches: int) -> DataFrame:
    return df.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("long")).repartitionById(batches, F.col("_batch").cast("int"))


def _with_terms(dealt: DataFrame, blocks: Mapping[str, Column], condition: Column | None = None) -> DataFrame:
    """Term lists, made where the texts of a batch are: they are never shuffled."""
    dealt.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_ARROW_BYTES))
    made = [F.when(condition, c).otherwise(F.array().cast("array<string>")) if condition is not None else c for c in blocks.values()]
    return dealt.withColumns({f"_terms{i}": F.coalesce(c, F.array().cast("array<string>")) for i, c in enumerate(made)})


def _questions_of(df: DataFrame, key: str, text_col: str, blocks: Mapping[str, Column], batches: int, shards: int, copies: str | None) -> DataFrame:
    columns = [F.col(key).alias("_key"), F.col(text_col), *([F.col(copies).alias("_copies")] if copies else [])]
    rows = _with_terms(_dealt(df.select(*columns), "_key", batches), blocks).drop(text_col)
    return rows.mapInArrow(_asking("_key", len(blocks), shards, copies is not None), _ASKED)


def _answers(asked: DataFrame, shards: int, given: bool = False) -> DataFrame:
    return materialise(asked.groupBy("shard").applyInArrow(_answer(shards, given), _ANSWERED), "answers")


def vocabulary(df: DataFrame, key: str, text_col: str, blocks: Mapping[str, Column]) -> tuple[DataFrame, int, int]:
    """(block, term, df, number) of all terms of ``df``, numbered from 0 without gaps; their number and that of the rows. ``blocks`` maps
    names to term lists of ``text_col``; a block is named by its place. Rows of one key are one document. Frequent terms of a block come
    first, so that a document's weights by number are runs of equal ones, which are written in little space."""
    batches, shards, rows = _sizes(df, text_col)
    asked = _questions_of(df, key, text_col, blocks, batches, shards, None)
    found = materialise(asked.groupBy("shard").applyInArrow(_vocabulary, _FOUND), "terms")
    sizes = found.groupBy("block", "level", "shard").agg(F.count("*").alias("n")).orderBy("block", F.desc("level"), "shard").collect()  # some 20 rows per shard
    starts, total = [], 0
    for r in sizes:
        starts.append((r["block"], r["level"], r["shard"], total))
        total += r["n"]
    starts = df.sparkSession.createDataFrame(starts, "block int, level int, shard int, start long")
    numbered = found.join(F.broadcast(starts), ["block", "level", "shard"])
    return numbered.select("block", "term", "df", (F.col("start") + F.col("place")).alias("number")), total, rows


def _met(df: DataFrame, key: str, text_col: str, blocks: Mapping[str, Column], batches: int, answers: DataFrame) -> DataFrame:
    """All rows of ``df`` with their term lists, and the answers of their batch, in one partition per batch."""
    kind = "struct<block: int, shard: int, n: int, df: binary, number: binary>"
    given = F.struct("block", "shard", "n", "df", "number").alias("_answer")
    rows = df.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("long")).withColumn("_answer", F.lit(None).cast(kind))
    both = rows.unionByName(answers.select(F.col("batch").alias("_batch"), given), allowMissingColumns=True)
    both = both.repartitionById(batches, F.col("_batch").cast("int"))
    return _with_terms(both, blocks, F.col("_answer").isNull())


class _Weigher:
    """Weights of the documents of a batch: one list of term, tf, df and weight per document."""

    def __init__(self, n_docs: int, sublinear: bool, shards: int):
        self.n_docs, self.sublinear, self.shards = n_docs, sublinear, shards

    def of(self, held: _Batch, block: int, doc: np.ndarray, documents: int) -> tuple[np.ndarray, ...]:
        """Ends of the documents' entries, and number, tf, df and weight of each entry; terms without a number are dropped."""
        terms, document, term, tf = held.blocks[block].pairs(doc)
        order, ends = _ordered(terms, self.shards)
        df, number = np.zeros(len(terms), np.int64), np.full(len(terms), -1, np.int64)
        for s in range(self.shards):
            if ends[s] < ends[s + 1]:
                own = order[ends[s]:ends[s + 1]]
                df[own], number[own] = held.answers[block, s]
        known = number[term] >= 0
        document, term, tf = document[known], term[known], tf[known]
        raw = (1.0 + np.log(tf) if self.sublinear else tf.astype(float)) * (np.log((1.0 + self.n_docs) / (1.0 + df[term])) + 1.0)
        weight = raw / np.sqrt(np.bincount(document, raw * raw, documents))[document]
        by = np.lexsort((number[term], document))
        term = term[by]
        return np.searchsorted(document[by], np.arange(documents + 1)), number[term], tf[by], df[term], weight[by]


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def document_weights(df: DataFrame, key: str, text_col: str, terms: Column, sublinear: bool = False, copies: str | None = None,
                     n_docs: int | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """One row per value of ``key``: doc, and lists of term number, tf, df and weight by number, of length 1.

    ``copies`` names a column that says how many rows a document stands for; ``n_docs`` is their sum, else the number of rows.
    ``carried`` columns are those of a document's first row.
    """
    blocks = {"terms": terms}
    batches, shards, rows = _sizes(df, text_col)
    answers = _answers(_questions_of(df, key, text_col, blocks, batches, shards, copies), shards)
    weigher, kind = _Weigher(rows if n_docs is None else n_docs, sublinear, shards), df.schema[key].dataType

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batches(parts, 1).values():
            if not held.kept:
                continue
            rows, doc, keys = held.documents("doc")
            ends, *values = weigher.of(held, 0, doc, len(keys))
            first = pa.array(np.unique(doc, return_index=True)[1])
            own = [rows.column(c).combine_chunks().take(first) for c in carried]
            # A document without terms has no rows.
            some = pa.array(np.diff(ends) > 0)
            made = pa.RecordBatch.from_arrays([keys, *own, *(_lists(ends, v) for v in values)], ["doc", *carried, *WEIGHTS.names]).filter(some)
            for start in range(0, made.num_rows, 1000):
                yield made.slice(start, 1000)

    met = _met(df.select(F.col(key).alias("doc"), F.col(text_col), *carried), "doc", text_col, blocks, batches, answers).drop(text_col)
    return met.mapInArrow(run, StructType([StructField("doc", kind), *[df.schema[c] for c in carried], *WEIGHTS.fields]))


_FEATURES = StructType([StructField("_i", ArrayType(IntegerType())), StructField("_w", ArrayType(DoubleType()))])


def features(df: DataFrame, key: str, text_col: str, blocks: Mapping[str, Column], frequency: DataFrame, n_docs: int) -> DataFrame:
    """``df`` with the numbers and sublinear weights ``_i``, ``_w`` of the terms in ``frequency``, by number; each block has length 1.

    Rows of one key share the features of all their texts; those without key have none."""
    batches, shards, _ = _sizes(df, text_col)
    asked = _questions_of(df, key, text_col, blocks, batches, shards, None)
    table = frequency.select(F.col("block").cast("int").alias("block"), "term", F.col("df").cast("long").alias("df"), F.col("number").cast("long").alias("number"))
    answers = _answers(asked.unionByName(table.mapInArrow(_known(len(blocks), shards), _ASKED)), shards, True)
    weigher, names, count = _Weigher(n_docs, True, shards), df.columns, len(blocks)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batches(parts, count).values():
            if not held.kept:
                continue
            rows, doc, keys = held.documents(key)
            every = [weigher.of(held, i, doc, len(keys)) for i in range(count)]
            owner = np.concatenate([np.repeat(np.arange(len(keys)), np.diff(e[0])) for e in every])
            number, weight = (np.concatenate([e[k] for e in every]) for k in (1, 4))
            order = np.lexsort((number, owner))
            ends = np.searchsorted(owner[order], np.arange(len(keys) + 1))
            lists = [_lists(ends, number[order].astype(np.int32)), _lists(ends, weight[order])]
            none = pc.is_null(rows.column(key)).to_numpy(zero_copy_only=False)
            for start in range(0, rows.num_rows, 1000):
                part, own = rows.slice(start, 1000), doc[start:start + 1000]
                missing = none[start:start + 1000]
                made = [x.take(pa.array(own)) for x in lists]
                made = [pc.if_else(pa.array(missing), pa.scalar([], x.type), x) if missing.any() else x for x in made]
                table = part.select(names).combine_chunks()
                yield from pa.table([*table.columns, *made], names=[*names, "_i", "_w"]).to_batches()

    met = _met(df, key, text_col, blocks, batches, answers)
    return met.mapInArrow(run, StructType([*df.schema.fields, *_FEATURES.fields]))
