"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits, cut into ``SEGMENTS`` = 2 halves. Two fingerprints that differ in at most ``DISTANCE`` = 3 bits differ in
at most one bit of some half (pigeonhole). So each fingerprint is stored under both of its halves, and probes both tables with
the ball of radius ``RADIUS`` = 1 around its own half: the half itself and the halves with one bit changed. Of two halves one bit
apart exactly one has that bit set, so only set bits are cleared: 16 probes of a half on average reach every such pair once.
What a probe fetches is verified on all 64 bits.

Fetches never become all pairs of a bucket (the members of a table entry and the probes that reach it). Equal fingerprints are one
class. In each bucket all rows are first verified against one member; rows found connected need no further check. Where a bucket
still holds several components, the rows outside its largest one are held in blocks against the other rows, and a block
returns one link for two components. So every fetched pair whose ends are not connected already is verified exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pulseframe.llm.graph import components
from pulseframe.llm.words import SPACE, Words, slices, text_rows
from pulseframe.session import materialise

SHINGLE = 3
DISTANCE = 3
SEGMENTS = 2
RADIUS = DISTANCE // SEGMENTS
SEED = 42
#: Rows of a bucket in one block; two blocks are compared at once.
BLOCK_ROWS = 4096
#: A fingerprint of more than 1 / COMMON of all rows meets its rows by broadcast: there are fewer than COMMON of them.
COMMON = 1024

_HALF = 64 // SEGMENTS
_PIECE = 100_000
_STRIP = 256


def fingerprints(texts: list, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprint of each text (bytes or None): a bit is set if over half the shingles' hashes have it set."""
    words = Words(texts, lower=True)
    # All words again, each followed by one space, so that a shingle is a slice of the buffer.
    data = words.bytes.copy()
    data[words.ends] = 32
    inside = ~SPACE[words.bytes]
    inside[words.ends] = True
    data = data[inside].tobytes()
    lengths = words.ends - words.starts
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = starts + lengths

    left = np.repeat(words.first[1:], words.counts) - np.arange(len(starts))
    few = words.counts < shingle
    # Shingles begin at each word with enough words behind it; a text of fewer words has one, at its first word.
    first = np.flatnonzero((left >= shingle) | few[words.text] & (left == np.repeat(words.counts, words.counts)))
    last = first + np.minimum(left[first], shingle) - 1
    owner = words.text[first]
    counts = np.bincount(owner, minlength=len(texts))
    ones = np.zeros((len(texts), 64), np.int64)
    for i in range(0, len(first), _PIECE):
        spans = zip(starts[first[i : i + _PIECE]].tolist(), ends[last[i : i + _PIECE]].tolist())
        hashes = np.array([xxh64_intdigest(data[a:b], SEED) for a, b in spans], np.uint64)
        own = owner[i : i + _PIECE]
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def _fingerprint_batches(batches):
    for rows, texts in slices(batches):
        yield pa.record_batch({"doc_id": rows.column("doc_id").cast(pa.int64()), "fingerprint": pa.array(fingerprints(texts).view(np.int64))})


def _block_batches(batches):
    """One link for each two components that a block of outside rows and a block of rows of one bucket connect."""
    for batch in batches:
        found = [np.zeros((0, 2), np.int64)]
        for queries, rows in zip(batch.column("queries"), batch.column("rows")):
            q, r = (np.stack([x.values.field(c).to_numpy() for c in ("fp", "component")], axis=1) for x in (queries, rows))
            for i in range(0, len(q), _STRIP):
                strip = q[i : i + _STRIP]
                near = np.bitwise_count(strip[:, None, 0].view(np.uint64) ^ r[None, :, 0].view(np.uint64)) <= DISTANCE
                a, b = np.nonzero(near & (strip[:, None, 1] != r[None, :, 1]))
                if len(a):
                    _, one = np.unique(np.stack([strip[a, 1], r[b, 1]]), axis=1, return_index=True)
                    found.append(np.stack([strip[a[one], 0], r[b[one], 0]], axis=1))
        links = np.concatenate(found)
        yield pa.record_batch({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})


def linked(codes: DataFrame) -> DataFrame:
    """(node, component) of every distinct 64-bit ``fp`` of ``codes`` that has a link; the component is its least node.

    Fingerprints link at ``DISTANCE`` or fewer differing bits. Nulls are ignored.
    """
    halves = F.array(F.shiftrightunsigned("fp", _HALF), F.col("fp").bitwiseAND((1 << _HALF) - 1))
    table = codes.select("fp", F.posexplode(halves).alias("segment", "half"))
    # A bucket's key is the half with the segment's number above it.
    key = F.col("segment") * F.lit(1 << _HALF) + F.col("half")
    members = table.select(key.alias("bucket"), "fp")
    ones = F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(_HALF)]), lambda bit: F.col("half").bitwiseAND(bit) != 0)
    probes = table.select("fp", "segment", "half", F.explode(ones).alias("bit")).select(
        (key - F.col("bit")).alias("bucket"), "fp")
    heads = members.groupBy("bucket").agg(F.min("fp").alias("head"), F.count("*").alias("members"))
    # Both sides are some 2 and 32 rows a fingerprint, which Spark sizes like the small file they are made from: without the hint it would
    # bring the probes to the driver and send them to all tasks.
    fetched = probes.hint("merge").join(heads.hint("merge"), "bucket").select("bucket", "fp", "head")
    own = members.hint("merge").join(heads.where("members > 1").drop("members").hint("merge"), "bucket").where("fp <> head").select("bucket", "fp", "head")
    rows = materialise(fetched.union(own), "fetched")

    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))) <= DISTANCE
    stars = materialise(rows.where(near).select(F.col("head").alias("a"), F.col("fp").alias("b")).distinct(), "stars")
    found = components(stars)

    # Buckets that still hold several components: rows outside the largest one against the others, in blocks.
    held = rows.select("bucket", "fp").union(rows.select("bucket", F.col("head").alias("fp")).distinct())
    named = held.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("bucket", "fp", F.coalesce("component", "fp").alias("component"))
    sizes = named.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    # A bucket of two rows was settled by its head.
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("top"), F.sum("k").alias("all"), F.count("*").alias("parts"))
    mixed = mixed.where("parts > 1 and all > 2").select("bucket", F.col("top.component").alias("largest"), F.ceil(F.col("all") / BLOCK_ROWS).alias("parts"))
    mixed = materialise(named.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("fp"), "parts")), "mixed")
    packed = F.collect_list(F.struct("fp", "component"))
    rows = mixed.groupBy("bucket", "part").agg(packed.alias("rows"))
    queries = mixed.where("component <> largest").groupBy("bucket", F.col("part").alias("own"), "parts").agg(packed.alias("queries"))
    queries = queries.select("bucket", "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    further = materialise(queries.join(rows, ["bucket", "part"]).select("queries", "rows").mapInArrow(_block_batches, "a long, b long").distinct(), "links")
    return found if further.isEmpty() else components(stars.union(further))


def simhash_near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs(doc_id, text)``.

    Shingles are 3 consecutive words (A-Z lower-cased), repeats included; a text of fewer words is one shingle. Texts without words
    (null, empty, white space) have fingerprint zero and link like any other. component_id is the smallest doc_id of the linked
    group. Rows that repeat a doc_id are one document: they share a component. A row without doc_id has a fingerprint, no
    component_id, and links nothing. An empty table gives no rows.
    """
    rows = materialise(text_rows(docs, "doc_id", "text").mapInArrow(_fingerprint_batches, "doc_id long, fingerprint long"), "fingerprints")
    known = rows.where("doc_id is not null")
    codes = materialise(known.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "codes")
    found = linked(codes.select("fp"))

    # One doc_id on rows with several fingerprints: their groups belong together.
    several = known.groupBy("doc_id").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("z")).where("a < z").select("doc_id", "a")
    repeated = known.join(several, "doc_id").where("fingerprint <> a").select("a", F.col("fingerprint").alias("b")).distinct()
    if not repeated.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(repeated))

    named = codes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "copies", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(named.join(least, "component").select(F.col("fp").alias("fingerprint"), "copies", "component_id"), "named")
    # Fingerprints of more than 1 / COMMON of all rows are fewer than COMMON, so their rows need no shuffle.
    total = named.agg(F.sum("copies")).first()[0] or 0
    common = F.col("copies") * COMMON > total
    few = F.broadcast(named.where(common).drop("copies"))
    out = rows.join(few, "fingerprint").unionByName(
        rows.join(few, "fingerprint", "left_anti").join(named.where(~common).drop("copies"), "fingerprint", "left"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
                      F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
