"""Mixing sources to target weights by blocks, multinomial draws and index permutations.

The words of each source are laid out one document after the other and cut into blocks of ``BLOCK`` words. The mix is a
number of output shards of ``SHARD_SLOTS`` slots. For each shard the numbers of slots per source are drawn: the whole
part of the expectation plus a multinomial draw of the rest. A source's slots count on from shard to shard; slot j takes
the block that a pseudorandom permutation of the source's block numbers (a new one for each pass) gives for j. Slots and
blocks meet in an equality join on (source, block), so a source with a third of all words is no hot key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.words import bound_batches, mix, slices
from pulseframe.operators.ordered import running
from pulseframe.session import materialise

WEIGHTS = (5, 2, 1)
#: A source's target ends at this many times its size; so does the number of passes over it.
PASSES = 3
BLOCK = 32
SHARD_SLOTS = 4096
#: Slots that one task expands, about, and slots that it holds at a time.
TASK_SLOTS, HELD_SLOTS = 1 << 19, 1 << 18
SEED = 20
#: Documents of a source are laid out in this many runs, so that no task orders a whole source.
RUNS = 1024
#: The draw holds one number per source; a table with more sources is refused.
MAX_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, source_size, sid, target) from (source, source_size), one row per source.

    Sources in code point order, null last, get the weights in turn. They share the sum of all sizes by weight; a target
    stops at ``passes`` times the source's size and the excess is shared by the others: capped are exactly the sources
    whose cap per weight lies under the level that fills the rest.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") % len(weights)) + 1).cast("int"))
    rows = sizes.withColumn("sid", F.row_number().over(order) - 1).withColumn("weight", weight)
    rows = rows.withColumn("cap", F.col("source_size").cast("double") * passes).withColumn("full_at", F.col("cap") / F.col("weight"))
    before = Window.orderBy("full_at", "sid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("capped", F.col("level") > F.col("full_at"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))
    return rows.select("source", "source_size", "sid", target.alias("target"))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each index under a pseudorandom permutation of 0 .. size-1 chosen by the key: four Feistel rounds, walked
    until the value falls into the range. All three are arrays of equal length."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, todo = index.astype(np.uint64), np.arange(len(index))
    key = key.astype(np.uint64)
    while len(todo):
        left, right = value[todo] >> half[todo], value[todo] & mask[todo]
        for r in range(4):
            turn = mix(right + key[todo] * np.uint64(2 * r + 3) + np.uint64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            left, right = right, left ^ (turn & mask[todo])
        value[todo] = left << half[todo] | right
        todo = todo[value[todo] >= size[todo].astype(np.uint64)]
    return value.astype(np.int64)


def _draws(sources: list, slots: int, seed: int, shard_slots: int):
    """For each shard: (shard, sid, n, base); base is where the source's slots begin in the shard."""
    sid = np.array([r["sid"] for r in sources], np.int64)
    blocks = np.array([r["blocks"] for r in sources], np.int64)
    share = np.array([r["expected"] for r in sources], float)
    share = share / share.sum()

    def draw(frames):
        for frame in frames:
            out = []
            for shard in frame["id"]:
                n = min(shard_slots, slots - shard * shard_slots)
                count = np.floor(n * share + 1e-9).astype(np.int64)
                rest = np.maximum(n * share - count, 0)
                more = n - count.sum()
                if more > 0:
                    count = count + np.random.default_rng([seed, shard]).multinomial(more, rest / rest.sum())
                some = count > 0
                out.append(pd.DataFrame({"shard": shard, "sid": sid[some], "n": count[some], "blocks": blocks[some],
                                         "base": (np.cumsum(count) - count)[some], "slots": n}))
            if out:
                yield pd.concat(out)

    return draw


def _portions(frame: pd.DataFrame):
    """The rows of a frame in portions of HELD_SLOTS slots; a row has no more than a shard."""
    yield from (part for _, part in frame.groupby(np.cumsum(frame["n"].to_numpy()) // HELD_SLOTS))


def _slots(seed: int, passes: int):
    def expand(frames):
        for frame in (part for frame in frames for part in _portions(frame)):
            n = frame["n"].to_numpy()
            row = np.repeat(np.arange(len(frame)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = lambda c: frame[c].to_numpy()[row]
            j, size, sid, shard = at("first") + k, at("blocks"), at("sid"), at("shard")
            turn = j // size
            key = mix((sid * 8191 + turn + seed * 1_000_003).astype(np.uint64))
            block = permuted(j % size, size, key)
            slot = permuted(at("base") + k, at("slots"), mix(shard.astype(np.uint64) + np.uint64(seed + 77)))
            out = pd.DataFrame({"shard": shard, "slot": slot, "sid": sid, "block": block, "pass": turn})
            yield out[turn < passes]

    return expand


class Mix:
    """A mix of ``docs(doc_id, source, text)``: its places (documents in their source's layout) and its slots."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED, passes: int = PASSES):
        spark = docs.sparkSession
        bound_batches(spark)
        self.docs, self.block = docs, block
        text = F.coalesce(docs["text"], F.lit(""))
        sized = materialise(docs.select(
            docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), F.hash(text).alias("tag"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "sizes")
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.targets = materialise(source_targets(sizes, weights, passes), "targets")
        blocks = F.ceil(F.col("source_size") / block).cast("long")
        known = self.targets.where("source_size > 0").select(
            "sid", blocks.alias("blocks"), (F.col("target") * blocks / F.col("source_size")).alias("expected"))
        sources = known.limit(MAX_SOURCES + 1).collect()
        if len(sources) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        sources.sort(key=lambda r: r["sid"])
        self.places = self._places(sized)
        slots = int(round(sum(r["expected"] for r in sources)))
        shards = spark.range(-(-slots // shard_slots))
        counts = shards.mapInPandas(_draws(sources, slots, seed, shard_slots), "shard long, sid long, n long, blocks long, base long, slots long")
        counts = running(counts, ["sid"], [F.asc("shard")], {"first": "n"}).withColumn("first", F.col("first") - F.col("n"))
        # The draws are few bytes, what they expand to is not: the number of slots sets the number of tasks.
        counts = counts.repartition(max(1, -(-slots // TASK_SLOTS)), "shard")
        #: (shard, slot, sid, block, pass): the block in each slot. Draws past the last pass over a source are void.
        #: Merged, not broadcast: the planner takes the slots for as small as the table of draws.
        self.slots = counts.mapInPandas(_slots(seed, passes), "shard long, slot long, sid long, block long, pass long").hint("merge")

    def _places(self, sized: DataFrame) -> DataFrame:
        named = sized.join(self.targets, sized["source"].eqNullSafe(self.targets["source"])).drop(self.targets["source"])
        named = named.withColumn("run", F.pmod(F.xxhash64("doc_id", "size"), F.lit(RUNS)))
        within = F.sum("size").over(Window.partitionBy("sid", "run").orderBy("doc_id", "size", "tag").rowsBetween(Window.unboundedPreceding, 0))
        runs = named.groupBy("sid", "run").agg(F.sum("size").alias("all"))
        runs = runs.select("sid", "run", (F.sum("all").over(Window.partitionBy("sid").orderBy("run")) - F.col("all")).alias("ahead"))
        rows = named.withColumn("within", within - F.col("size")).join(runs, ["sid", "run"])
        return materialise(rows.select("doc_id", "tag", "source", "sid", "size", "source_size", "target",
                                       (F.col("ahead") + F.col("within")).alias("start")), "places")

    def pieces(self) -> DataFrame:
        """(sid, block, start, doc_id, words): what each document adds to the blocks that it touches."""
        b = self.block
        rows = self.places.where("size > 0").withColumn("block", F.explode(F.sequence(
            F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.greatest("start", F.col("block") * b)
        return rows.select("sid", "block", "start", "doc_id", words.alias("words"))

    def spans(self) -> DataFrame:
        """(shard, slot, sid, block, start, doc_id, words): the mix as spans of documents."""
        return self.slots.join(self.pieces(), ["sid", "block"])

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) for every row."""
        sums = self.spans().groupBy("sid", F.col("start").alias("key")).agg(F.sum("words").alias("taken"))
        rows = self.places.withColumn("key", F.when(F.col("size") > 0, F.col("start")))
        joined = rows.join(sums, ["sid", "key"], "left")
        return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def texts(self) -> DataFrame:
        """(shard, slot, source, block, n_words, doc_ids, text): the mix itself, one row per slot; words joined by one space."""
        docs, places = self.docs, self.places.where("size > 0")
        same = Window.partitionBy("doc_id", "tag", "source")
        places = places.withColumn("copies", F.count("*").over(same)).select(
            F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.col("source").alias("__source"), "sid", "start", "copies")
        rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["source"].cast("string").alias("source"),
                           F.hash(F.coalesce(docs["text"], F.lit(""))).alias("tag"))
        rows = rows.join(places, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("tag") == F.col("__tag")) & F.col("source").eqNullSafe(F.col("__source")))
        rows = rows.select("doc_id", "text", "source", "sid", "start", "copies")
        rows = rows.where("copies = 1").union(rows.where("copies > 1").dropDuplicates(["sid", "start"]))
        cut = rows.select("doc_id", "sid", "start", "source", "text").mapInArrow(
            _cutter(self.block), "sid long, block long, start long, doc_id long, source string, words long, text string")
        parts = F.sort_array(F.collect_list(F.struct("start", "doc_id", "words", "text")))
        blocks = cut.groupBy("sid", "block").agg(F.first("source").alias("source"), parts.alias("parts"))
        blocks = blocks.select(
            "sid", "block", "source", F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["words"]).alias("n_words"),
            F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
            F.concat_ws(" ", F.transform("parts", lambda p: p["text"])).alias("text"))
        return self.slots.join(blocks, ["sid", "block"]).select("shard", "slot", "source", "block", "n_words", "doc_ids", "text")


def _cutter(block: int):
    def cut(batches):
        for rows, texts in slices(batches):
            cols = [rows.column(c).to_pylist() for c in ("doc_id", "sid", "start", "source")]
            out = {c: [] for c in ("sid", "block", "start", "doc_id", "source", "words", "text")}
            for text, doc, sid, start, source in zip(texts, *cols):
                words, i = (text or b"").split(), 0
                while i < len(words):
                    b = (start + i) // block
                    part = words[i : (b + 1) * block - start]
                    for c, v in zip(out, (sid, b, start, doc, source, len(part), b" ".join(part))):
                        out[c].append(v)
                    i += len(part)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            columns = {c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)}
            yield pa.record_batch(columns | {"text": columns["text"].cast(pa.string())})

    return cut


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs(doc_id, source, text)``.

    size counts the words of the text (null: 0), taken those that the mix holds, repeats counted. Null sources are one
    source, the last. Documents and sources without words get 0; rows that repeat a doc_id are laid out one after the
    other. An empty table gives no rows. The same rows give the same mix, however they are partitioned.
    """
    return Mix(docs, **options).taken()


def mix_texts(docs: DataFrame, **options) -> DataFrame:
    """The mixed blocks with their texts; cases as in ``mix_sizes``."""
    return Mix(docs, **options).texts()
