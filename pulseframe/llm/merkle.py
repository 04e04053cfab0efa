"""Merkle manifest of a dataset: leaf, root and witness of every row, one tree per source and one over the sources.

H is the lowercase hex SHA-256 of its inputs written one behind the other, digests as hex text. Every ``ARITY`` consecutive
nodes of a level become their H (the last run of a level may be shorter, even one node) while a tree has more than one node.

Nodes are appended in order to a stream of open subtrees (``Appender``). When a run closes, each of its members hands its
siblings on to all leaves below it, whose witnesses so grow level by level. The stream of a tree is cut into aligned blocks of
``ARITY ** HEIGHT`` nodes, so a block is a whole subtree and is appended by any task on its own; block roots are the nodes of
the next pass, and their witnesses extend those of the block's leaves. No task holds more than a block, however many rows a
source has.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.words import text_rows
from pulseframe.session import materialise

ARITY = 3
#: Levels of a block: it has ARITY ** HEIGHT nodes.
HEIGHT = 7

_NODES = "tree string, pos long, block long, doc_id long, digest binary, tampered binary, witness binary, top boolean"


def joined(digests: list[bytes]) -> bytes:
    """H of digests."""
    return sha256("".join([d.hex() for d in digests]).encode()).digest()


class Appender:
    """Appends nodes to open subtrees and gives each node the witness of its path as soon as a subtree closes.

    A witness is a byte string with one part per level: place in the run, size of the run, the siblings' 32 bytes each.
    """

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.open: list[list[tuple[bytes, int, int]]] = [[]]  # per level: (digest, first leaf, last leaf + 1)
        self.parts: list[list[bytes]] = []

    def append(self, digest: bytes) -> None:
        at = len(self.parts)
        self.parts.append([])
        self._add(0, (digest, at, at + 1))

    def _add(self, level: int, node: tuple[bytes, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        for place, (_, first, last) in enumerate(run):
            part = bytes((place, len(run))) + b"".join([d for k, (d, _, _) in enumerate(run) if k != place])
            for leaf in range(first, last):
                self.parts[leaf].append(part)
        self._add(level + 1, (joined([d for d, _, _ in run]), run[0][1], run[-1][2]))

    def finish(self, height: int | None = None) -> tuple[bytes, list[bytes]]:
        """(root, witnesses). ``height`` is the level of the root; without one it is the first level with a single node."""
        level = 0
        while level != height:
            run = self.open[level] if level < len(self.open) else []
            if height is None and len(run) == 1 and not any(self.open[level + 1 :]):
                break
            if run:
                self._close(level)
            level += 1
        return self.open[level][0][0], [b"".join(p) for p in self.parts]


def siblings(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place, siblings) of each level of a witness."""
    i = 0
    while i < len(witness):
        place, size = witness[i], witness[i + 1]
        i += 2
        yield place, [witness[i + 32 * k : i + 32 * (k + 1)] for k in range(size - 1)]
        i += 32 * (size - 1)


def fold(digest: bytes, witness: bytes) -> bytes:
    """The root that a node and its witness give."""
    for place, others in siblings(witness):
        digest = joined([*others[:place], digest, *others[place:]])
    return digest


def _append_blocks(arity: int, height: int):
    """Rows ordered by (tree, pos) -> the same rows with their witness inside the block, and one root row per block."""
    size = arity**height

    def run(batches):
        rows, key, whole = [], None, True

        def flush():
            stream = Appender(arity)
            for r in rows:
                stream.append(r["digest"])
            root, witnesses = stream.finish(None if whole else height)
            out = [{**r, "block": key[1], "witness": w, "top": None} for r, w in zip(rows, witnesses)]
            out.append({"tree": key[0], "pos": key[1], "digest": root, "top": whole})
            return pa.RecordBatch.from_pylist(out, schema=schema)

        schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("block", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()),
                            ("tampered", pa.binary()), ("witness", pa.binary()), ("top", pa.bool_())])
        for batch in batches:
            for r in batch.to_pylist():
                n = r.pop("n")
                found = (r["tree"], r["pos"] // size)
                if found != key and rows:
                    yield flush()
                    rows = []
                key, whole = found, n <= size
                rows.append(r)
        if rows:
            yield flush()

    return run


def _positions(nodes: DataFrame, order: list, name: str) -> DataFrame:
    """``nodes`` with ``pos``, the place of each row in its tree in the order of ``order``, and ``n``, the tree's nodes.

    Rows are sorted in ranges of (tree, order); a tree's rows before a range are a running sum over (tree, range).
    """
    nodes = nodes.withColumn("__tie", F.monotonically_increasing_id())
    order = [*order, F.asc("__tie")]
    sorted_rows = nodes.repartitionByRange(F.asc("tree"), *order).sortWithinPartitions(F.asc("tree"), *order)
    sorted_rows = materialise(sorted_rows.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", 33)
    ranges = sorted_rows.groupBy("tree", part.alias("__part")).agg(F.count("*").alias("__k"), F.min("__at").alias("__first"))
    of_tree = Window.partitionBy("tree")
    before = F.sum("__k").over(of_tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("tree", "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__k").over(of_tree).alias("n"))
    placed = sorted_rows.withColumn("__part", part).join(ranges, ["tree", "__part"])
    return placed.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def _witnesses(nodes: DataFrame, arity: int, height: int, name: str) -> list[DataFrame]:
    """Pass after pass over ``nodes(tree, pos, n, doc_id, digest, tampered)``: the written nodes and block roots of each.

    Stops when every tree is one block. A pass has at most 1 / ARITY ** HEIGHT of the nodes of the one before.
    """
    size, out = arity**height, []
    while True:
        dealt = nodes.withColumn("block", F.floor(F.col("pos") / size))
        dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "pos").select("tree", "pos", "n", "doc_id", "digest", "tampered")
        done = materialise(dealt.mapInArrow(_append_blocks(arity, height), _NODES), name)
        out.append(done)
        # A block root that is not its tree's root is a node of the next pass.
        further = done.where("top = false").select("tree", "pos", "doc_id", "digest", "tampered")
        counts = further.groupBy("tree").agg(F.count("*").alias("n"))
        if counts.isEmpty():
            return out
        nodes = further.join(counts, "tree")


def _extended(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first pass with ``further``, what extends their witness, and the columns of ``above(tree, further, ..)``.

    Goes from the last pass down: the witness of a block root extends those of all nodes of the block.
    """
    columns = [c for c in above.columns if c not in ("tree", "further")]
    inner = None
    for done in reversed(passes):
        ends = done.where("top = true").select("tree", F.col("pos").alias("block")).join(above, "tree").select("tree", "block", "further", *columns)
        inner = ends if inner is None else ends.unionByName(inner)
        nodes = done.where("top is null").join(inner, ["tree", "block"])
        if done is passes[0]:
            return nodes
        inner = nodes.select("tree", F.col("pos").alias("block"), F.concat("witness", "further").alias("further"), *columns)


def _fold_rows(batches):
    for batch in batches:
        witnesses = [a + b for a, b in zip(batch.column("witness").to_pylist(), batch.column("further").to_pylist())]
        leaves, tampered = batch.column("digest").to_pylist(), batch.column("tampered").to_pylist()
        proofs = [joined([s for _, others in siblings(w) for s in others]).hex() for w in witnesses]
        folded = [fold(t if t is not None else d, w) for d, t, w in zip(leaves, tampered, witnesses)]
        roots = batch.column("root").to_pylist()
        yield pa.record_batch({
            "doc_id": batch.column("doc_id"), "leaf": pa.array([d.hex() for d in leaves], pa.string()),
            "subroot": pa.array([d.hex() for d in batch.column("subroot").to_pylist()], pa.string()),
            "root": pa.array([d.hex() for d in roots], pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
            "folded_root": pa.array([d.hex() for d in folded], pa.string()),
            "verified": pa.array([f == r for f, r in zip(folded, roots)], pa.bool_()),
        })


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(text: Column) -> Column:
    """SHA-256 of a row's fields with the given text: each is ``-`` if null, else its UTF-8 length, ``:`` and the value."""
    fields = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return F.unhex(F.sha2(F.concat(*fields, _field(text)).cast("binary"), 256))


def witnessed(docs: DataFrame, tampered: Column | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """Every row of ``docs`` as (doc_id, digest, tampered, witness, further, subroot, root), digests as 32 bytes.

    ``witness`` and ``further`` together lead from the leaf over the subroot to the root. ``tampered`` is the text to be judged
    in place of the row's own (null: the row itself). Leaves of a source ascend by doc_id, rows without one first, rows that
    repeat a doc_id by leaf. A null source is a tree of its own, before all others.
    """
    rows = text_rows(docs, "doc_id", "source", "lang", "n_chars", "text")
    # '' is the tree of the null source, which sorts before '=' and any name.
    tree = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    other = F.lit(None).cast("binary") if tampered is None else F.when(tampered.isNotNull(), leaf_digest(tampered))
    leaves = rows.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(F.col("text")).alias("digest"), other.alias("tampered"))
    leaves = materialise(leaves, "leaves")
    passes = _witnesses(_positions(leaves, [F.asc("doc_id"), F.asc("digest")], "sorted"), arity, height, "blocks")

    empty = F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered")
    subroots = passes[0].where("top = true").select("tree", "digest")
    for done in passes[1:]:
        subroots = subroots.union(done.where("top = true").select("tree", "digest"))
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "digest", *empty)
    named = materialise(_positions(named, [F.asc("source_tree")], "subroots"), "subroots")
    top = _witnesses(named.drop("source_tree"), arity, height, "top")
    roots = top[0].where("top = true").select("tree", "digest")
    for done in top[1:]:
        roots = roots.union(done.where("top = true").select("tree", "digest"))
    whole = roots.select("tree", F.lit(b"").alias("further"), F.col("digest").alias("root"))
    paths = _extended(top, whole).select("pos", F.concat("witness", "further").alias("further"), F.col("digest").alias("subroot"), "root")
    above = named.select(F.col("source_tree").alias("tree"), "pos").join(paths, "pos").drop("pos")
    return _extended(passes, materialise(above, "above")).select("doc_id", "digest", "tampered", "witness", "further", "subroot", "root")


def manifest(docs: DataFrame, tampered: Column | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    proof_sha256 is H of all siblings from the leaf up to the root; folded_root is what they give with the tampered leaf
    (``tampered`` text where it is not null, else the row's own). Every row takes part, rows that repeat a doc_id one by one;
    nulls are fields like any other. An empty table gives no rows.
    """
    rows = witnessed(docs, tampered, arity, height)
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.mapInArrow(_fold_rows, schema)


def without_line_breaks(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The text without its line feeds on rows whose doc_id, written out, has an even CRC-32; null on all other rows."""
    return F.when(F.crc32(F.col(doc_id).cast("string")) % 2 == 0, F.translate(F.col(text), "\n", ""))
