"""Near-duplicates by fast similarity sketches, banding and exact verification.

Sketch: ``SLOTS`` coordinates are filled in rounds. In round i each shingle is hashed to one coordinate and to a value; a
coordinate keeps the least (round, value). Rounds go on until every coordinate is filled; from round ``SLOTS`` on,
round i fills coordinate i - SLOTS, so all are full after 2 * SLOTS rounds, whatever the set's size. Rows of ``BAND_ROWS``
equal coordinates make candidates: at a similarity of 0.75 a link is missed with a chance of (1 - 0.75^4)^32 < 6e-6.

Candidates never become all pairs of a bucket. Texts with equal shingle sets are one class. In each bucket every class is
first compared with one central class only; classes found connected so need no further comparison. Where a bucket still
holds several components, the members outside its largest one are the queries, held in blocks against its other members;
only links leave that step. Pairs are left out
only where a bound proves that they are no link: shingles that no other candidate has lie in the union of a pair and not in
its intersection. So every candidate pair whose ends are not connected already is confirmed or refused exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.graph import components
from pulseframe.llm.words import Words, mix, slices, text_rows, windows
from pulseframe.session import materialise

SHINGLE = 5
SLOTS = 128
BAND_ROWS = 4
BANDS = SLOTS // BAND_ROWS
#: Members of a bucket that are compared with its queries at once.
BLOCK_ROWS = 128
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 75

_FULL = np.uint64(2**64 - 1)


def shingle_sets(texts: list, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and where each text's begin."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    spans = windows(hashes, shingle)
    left = np.repeat(words.first[1:], words.counts) - np.arange(len(words.starts))  # words from here to the text's end
    whole = left >= shingle
    owner, value = words.text[whole], spans[np.flatnonzero(whole)] if len(spans) else np.zeros(0, np.uint64)
    few = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    short = []
    for t in few:
        own = hashes[words.first[t] : words.first[t + 1]]
        short.append(windows(own, len(own))[0] ^ np.uint64(len(own) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    if short:
        owner, value = np.concatenate([owner, few]), np.concatenate([value, np.array(short, np.uint64)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(value):
        new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
        owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def sketches(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of each set; rows of empty sets stay at the greatest value."""
    counts = np.diff(first)
    rows = np.flatnonzero(counts)
    out = np.full((len(counts), SLOTS), _FULL)
    owner = np.repeat(np.arange(len(counts)), counts)
    for i in range(2 * SLOTS):
        if not len(rows):
            break
        if i:
            keep = np.zeros(len(counts), bool)
            keep[rows] = True
            keep = keep[owner]
            owner, value = owner[keep], value[keep]
        x = mix(value + np.uint64((i + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))
        if i < SLOTS:
            slot = (x >> np.uint64(57)).astype(np.int64)
        else:
            slot = i - SLOTS
        x = (x & np.uint64((1 << 57) - 1)) >> np.uint64(1) | np.uint64(i << 56)
        np.minimum.at(out.reshape(-1), owner * SLOTS + slot, x)
        rows = rows[(out[rows] == _FULL).any(axis=1)]
    return out


def _bands(sketch: np.ndarray) -> np.ndarray:
    part = sketch.reshape(len(sketch), BANDS, BAND_ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
    total = np.broadcast_to(total, part.shape[:2]).copy()
    for k in range(BAND_ROWS):
        total = mix(total + part[:, :, k])
    return total


def _sketch_batches(batches):
    for rows, texts in slices(batches):
        value, first = shingle_sets(texts)
        counts = np.diff(first)
        ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        more = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(0x14057B7EF767814F)), dtype=np.uint64)])
        bands = _bands(sketches(value, first)).view(np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1)))
        yield pa.record_batch({
            "doc_id": rows.column("doc_id").cast(pa.int64()), "n_shingles": pa.array(counts, pa.int64()),
            "high": pa.array((ends[first[1:]] - ends[first[:-1]]).view(np.int64)),
            "low": pa.array((more[first[1:]] - more[first[:-1]]).view(np.int64)), "bands": bands,
        })


def _set_batches(batches):
    for rows, texts in slices(batches):
        value, first = shingle_sets(texts)
        yield pa.record_batch({
            "doc_id": rows.column("doc_id").cast(pa.int64()),
            "shingles": pa.array([value[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()),
        })


def _confirm_batches(batches):
    for batch in batches:
        pairs = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())
        keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs]
        yield pa.record_batch({n: batch.column(n).filter(pa.array(keep, pa.bool_())) for n in ("a", "b")})


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)) or not len(x):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    both = int((x[at] == y).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _block_batches(batches):
    """Links between the queries and the members of a bucket's block that are in different components."""
    for batch in batches:
        out = []
        for queries, members in zip(batch.column("queries"), batch.column("members")):
            own = [(m["id"], m["component"], m["outside"], m["n"], m["own"], np.frombuffer(m["shingles"], np.uint64)) for m in members.as_py()]
            for q in queries.as_py():
                x = np.frombuffer(q["shingles"], np.uint64)
                for i, component, outside, n, single, y in own:
                    if component == q["component"] or outside and i < q["id"]:
                        continue
                    if n is not None and q["n"] is not None:
                        a, b = n - single, q["n"] - q["own"]
                        if 100 * min(a, b) < PERCENT * (single + q["own"] + max(a, b)):
                            continue
                    if _linked(x, y):
                        out.append((min(i, q["id"]), max(i, q["id"])))
        yield pa.record_batch({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return materialise(rows.mapInArrow(_confirm_batches, "a long, b long").distinct(), "links")


def _shingle_rows(batches):
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        ids = np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), [len(x) for x in sets])
        yield pa.record_batch({"id": pa.array(ids, pa.int64()), "shingle": pa.array(np.concatenate(sets) if sets else ids, pa.int64())})


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(id, n, own): each document's number of shingles, and how many of them no other document of ``sets`` has.

    Both are null for an id with several sets.
    """
    rows = sets.mapInArrow(_shingle_rows, "id long, shingle long")
    once = rows.groupBy("shingle").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1")
    own = once.groupBy("id").agg(F.count("*").alias("own"))
    size = sets.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("k"), F.max(F.octet_length("shingles") / 8).cast("long").alias("n"))
    single = F.col("k") == 1
    return size.join(own, "id", "left").select("id", F.when(single, F.col("n")).alias("n"), F.when(single, F.coalesce("own", F.lit(0))).alias("own"))


def _may_link(n: str, own: str, m: str, other: str):
    """False only where own shingles prove two sets too different: the intersection holds none of them, the union all."""
    x, y = F.col(n) - F.col(own), F.col(m) - F.col(other)
    return F.coalesce(100 * F.least(x, y) >= PERCENT * (F.col(own) + F.col(other) + F.greatest(x, y)), F.lit(True))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``.

    A text's set are its distinct 5-word shingles (A-Z lower-cased); with fewer words the whole sequence is one shingle.
    Texts without words (null, empty, white space) have 0 shingles, are linked with nothing and kept. Equal sets are linked.
    component_id is the smallest doc_id of the linked group, kept says whether it is the row's own. Rows that repeat a
    doc_id are one document: they share a component, and it is linked when any of its texts is. A row without doc_id has
    no component_id, is kept and links nothing. An empty table gives no rows.
    """
    sketch = text_rows(docs, "doc_id", "text").mapInArrow(
        _sketch_batches, "doc_id long, n_shingles long, high long, low long, bands array<long>")
    sketch = materialise(sketch, "sketches")
    classes = sketch.where("n_shingles > 0").groupBy("high", "low").agg(F.min("doc_id").alias("rep"))
    member = materialise(sketch.join(classes, ["high", "low"], "left").select(
        "doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")), "members")

    band = member.where("bands is not null").select(F.col("rep").alias("id"), F.explode("bands").alias("band"))
    least = band.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("last")).where("least < last")
    shared = materialise(band.join(least.select("band"), "band"), "buckets")
    wanted = shared.select(F.col("id").alias("doc_id")).distinct()
    sets = materialise(text_rows(docs, "doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(
        _set_batches, "doc_id long, shingles binary"), "sets")
    # A set with so many shingles of its own that it can have no link at all takes no further part.
    shared = materialise(shared.join(_own_shingles(sets), "id").where(
        F.coalesce(100 * (F.col("n") - F.col("own")) >= PERCENT * F.col("n"), F.lit(True))), "buckets")
    # The first comparisons are with the bucket's member that has the fewest shingles of its own: it is the most central.
    centre = shared.groupBy("band").agg(F.min(F.struct("own", "id", "n")).alias("c"))
    stars = shared.join(centre, "band").where("id <> c.id").where(_may_link("n", "own", "c.n", "c.own"))
    stars = materialise(stars.select(F.least("c.id", "id").alias("a"), F.greatest("c.id", "id").alias("b")).distinct(), "stars")
    links = _confirmed(stars, sets)

    # One doc_id on rows with several sets: their classes belong together.
    several = member.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("doc_id")
    repeated = member.join(several, "doc_id").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = materialise(links.union(repeated), "links")
    found = components(links)

    # Buckets that still hold several components: members outside the largest one against the others, in blocks.
    names = shared.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "band", "id", "n", "own", F.coalesce("component", "id").alias("component"))
    sizes = names.groupBy("band", "component").agg(F.count("*").alias("members"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("members", "component")).alias("top"), F.sum("members").alias("all"),
                                      F.count("*").alias("k")).where("k > 1")
    mixed = names.join(mixed.select("band", F.col("top.component").alias("largest"), "all"), "band")
    mixed = materialise(mixed.withColumn("outside", F.col("component") != F.col("largest")), "mixed")
    whole = mixed.join(sets.withColumnRenamed("doc_id", "id"), "id").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.ceil(F.col("all") / BLOCK_ROWS)))
    member_of = F.collect_list(F.struct("id", "component", "n", "own", "outside", "shingles"))
    blocks = whole.groupBy("band", "part").agg(member_of.alias("members"))
    queries = whole.where("outside").groupBy("band", "part").agg(member_of.alias("queries"))
    pairs = queries.select("band", "queries").join(blocks.select("band", "members"), "band")
    further = materialise(pairs.mapInArrow(_block_batches, "a long, b long").distinct(), "links")
    if not further.isEmpty():
        found = components(links.union(further))

    named = member.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document ``near_duplicates`` keeps, with all their columns.

    Rows without doc_id stay. Of rows that repeat a doc_id one stays.
    """
    kept = near_duplicates(docs).where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"))
    rows = docs.join(kept, docs["doc_id"] == kept["__id"])
    once = rows.where("__n = 1").drop("__id", "__n")
    again = rows.where("__n > 1").dropDuplicates(["__id"]).drop("__id", "__n")
    return once.unionByName(again).unionByName(docs.where(docs["doc_id"].isNull()))
