"""Linear models over sparse text features whose optimiser holds one number per training row, never one per term.

With a quadratic penalty the coefficients stay a combination ``X' a`` of the training rows, and so do the gradients and all that L-BFGS
keeps. Products and margins then need ``X X' a`` only: one Spark job over column blocks of the rows, from a vector of the rows to a
vector of the rows. The driver's memory follows the number of labelled rows, whatever the vocabulary; the coefficients themselves are a
table ``(number, w)`` that Spark writes and joins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pulseframe.operators.termtable import packed, unpacked
from pulseframe.session import materialise

# --- fixed values -------------------------------------------------------------
HISTORY = 6
MARGIN_DIGITS = 10
TOLERANCE = 1e-8
#: Widths of the rounded corner of the hinge, each started from the solution of the one before.
HINGE_WIDTHS = (1.0, 0.1, 0.01, 0.001)
#: Entries of the feature matrix in one column block: at least, while there are cores left, and at most; bytes that a task deals out at once.
BLOCK_ENTRIES = (500_000, 8_000_000)
_BATCH_BYTES = 16_000_000
_DEALT = "block int, labels boolean, n int, i binary, r binary, v binary"
#: Coefficients that one scoring task holds; with fewer, as many tasks as there are cores.
MARGIN_TERMS = 2_000_000
_ENTRIES = "block int, w boolean, n int, rows int, ids binary, r binary, i binary, v binary"


def settled(margins: Column) -> Column:
    """Margins without their last bits, which follow the order of a sum: a score that equals the threshold does so on every run."""
    return F.transform(margins, lambda m: F.when(F.abs(m) < float("inf"), F.round(m, MARGIN_DIGITS)).otherwise(m))


def _sparse(df: DataFrame) -> tuple[Column, Column]:
    """Indices and values of the ``features`` column."""
    inner = F.unwrap_udt("features")
    return inner["indices"], inner["values"]


def with_rows(df: DataFrame) -> DataFrame:
    """``df`` with the number ``_row`` that a written feature table carries; a frame without it is written first."""
    return df if "_row" in df.columns else materialise(df.withColumn("_row", F.monotonically_increasing_id()), "rows")


def _deal(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut the entries of a batch of rows by column block; labels and weights go along as rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("_row").to_numpy()
            lists = batch.column("indices")
            index, value = lists.flatten().to_numpy().astype(np.int32), batch.column("values").flatten().to_numpy()
            row = np.repeat(ids, np.diff(lists.offsets.to_numpy()))
            block = index % blocks
            order = np.argsort(block, kind="stable")
            ends = np.searchsorted(block[order], np.arange(blocks + 1))
            parts = [order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            kept = [b for b in range(blocks) if len(parts[b])]
            label = batch.column("label").to_numpy().astype(np.int32)
            columns = [
                pa.array([*kept, int(ids[0] % blocks)], pa.int32()), pa.array([False] * len(kept) + [True]),
                pa.array([*(len(parts[b]) for b in kept), len(ids)], pa.int32()),
                pa.array([*(packed(index[parts[b]]) for b in kept), packed(label)], pa.binary()),
                pa.array([*(packed(row[parts[b]]) for b in kept), packed(ids)], pa.binary()),
                pa.array([*(packed(value[parts[b]]) for b in kept), packed(batch.column("_weight").to_numpy())], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "labels", "n", "i", "r", "v"])

    return run


def _joined(rows: list, column: str, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(unpacked(bytes(d[column]), d["n"], kind) for d in rows)])


def _deal_entries(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries of a batch of rows by column block, each with the rows' ids and the number of entries of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("indices")
            index, value = lists.flatten().to_numpy().astype(np.int64), batch.column("values").flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            block = index % blocks
            order, made, ids = np.argsort(block, kind="stable"), [], packed(batch.column("_row").to_numpy())
            ends = np.searchsorted(block[order], np.arange(blocks + 1))
            for b in range(blocks):
                own = order[ends[b]:ends[b + 1]]
                if len(own):
                    counts = np.bincount(row[own], minlength=batch.num_rows).astype(np.int32)
                    made.append((b, False, len(own), batch.num_rows, ids, packed(counts), packed((index[own] // blocks).astype(np.int32)), packed(value[own])))
            if made:
                yield _entry_rows(made)

    return run


def _deal_weights(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Coefficients by column block: places in ``i``, values of one margin after the other in ``v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column("number").to_numpy().astype(np.int64)
            w = batch.column("w").flatten().to_numpy().reshape(len(number), -1)
            own = [(b, np.flatnonzero(number % blocks == b)) for b in np.unique(number % blocks)]
            yield _entry_rows([(int(b), True, len(at), w.shape[1], None, None, packed((number[at] // blocks).astype(np.int32)), packed(w[at].T)) for b, at in own])

    return run


def _entry_rows(made: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], [c.split()[0] for c in _ENTRIES.split(", ")])


def _sum_entries(margins: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What the block's terms add to each row's margins; a block's coefficients come before its entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, given, held = None, [], None
        for batch in batches:
            for d in batch.to_pylist():
                if d["block"] != block:
                    block, given, held = d["block"], [], None
                if d["w"]:
                    given.append((unpacked(d["i"], d["n"], np.int32), unpacked(d["v"], d["n"] * margins, np.float64).reshape(margins, -1)))
                    continue
                if held is None:
                    held = np.zeros((margins, max((int(i.max()) + 1 for i, _ in given), default=0)))
                    for i, w in given:
                        held[:, i] = w
                at, v = unpacked(d["i"], d["n"], np.int32), unpacked(d["v"], d["n"], np.float64)
                row = np.repeat(np.arange(d["rows"]), unpacked(d["r"], d["rows"], np.int32))
                known = at < held.shape[1]
                row, at, v = row[known], at[known], v[known]
                sums = [np.bincount(row, v * held[k, at], d["rows"]) for k in range(margins)]
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(d["ids"], d["rows"], np.int64)), *(pa.array(s) for s in sums)],
                                                 ["_row", *(f"s{k}" for k in range(margins))])

    return run


class RowProducts:
    """Training rows in column blocks: their labels and weights, and products with ``X X'``.

    ``rows`` carries features, label (0, 1, ...) and _weight. Close it to release the blocks.
    """

    def __init__(self, rows: DataFrame):
        spark = self.spark = rows.sparkSession
        indices, values = _sparse(rows)
        rows = with_rows(rows).select("_row", "label", "_weight", indices.alias("indices"), values.alias("values"))
        entries = rows.agg(F.sum(F.size("indices"))).first()[0] or 0
        least, most = BLOCK_ENTRIES
        blocks = max(1, min(-(-entries // least), spark.sparkContext.defaultParallelism), -(-entries // most))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
        dealt = rows.mapInArrow(_deal(blocks), _DEALT).repartition(blocks, "block").rdd.coalesce(blocks)
        facts = dealt.filter(lambda d: d.labels).collect()  # 20 bytes a training row
        if not facts:
            raise ValueError("no training rows")
        ids, labels, weights = (_joined(facts, c, t) for c, t in (("r", np.int64), ("i", np.int32), ("v", np.float64)))
        order = np.argsort(ids)
        self.label, self.weight, self.n = labels[order], weights[order], len(ids)
        self._ids = spark.sparkContext.broadcast(ids[order])
        known = self._ids

        def pack(part: Iterator[Row]) -> Iterator[tuple]:
            rows = [d for d in part if not d.labels]
            number, local = np.unique(_joined(rows, "i", np.int32), return_inverse=True)
            place = np.searchsorted(known.value, _joined(rows, "r", np.int64)).astype(np.int32)
            yield number, local.astype(np.int32), place, _joined(rows, "v", np.float64)

        self._blocks = dealt.mapPartitions(pack).persist(StorageLevel.MEMORY_AND_DISK)

    def times(self, a: np.ndarray) -> np.ndarray:
        """``X X' a`` for the columns of ``a``."""
        sent, n = self.spark.sparkContext.broadcast(a), self.n

        def work(block: tuple) -> np.ndarray:
            number, local, place, v = block
            out = np.zeros(sent.value.shape)
            for k in range(out.shape[1]):
                of_term = np.bincount(local, v * sent.value[place, k], len(number))
                out[:, k] = np.bincount(place, v * of_term[local], n)
            return out

        made = self._blocks.map(work).treeReduce(np.add)
        sent.destroy()
        return made

    def coefficients(self, a: np.ndarray) -> DataFrame:
        """``X' a`` as a written table: term number and one value per column of ``a``."""
        sent = self.spark.sparkContext.broadcast(a)

        def work(block: tuple) -> Iterator[tuple]:
            number, local, place, v = block
            w = np.stack([np.bincount(local, v * sent.value[place, k], len(number)) for k in range(sent.value.shape[1])])
            for start in range(0, len(number), 100_000):
                yield number[start:start + 100_000].tolist(), w[:, start:start + 100_000].T.tolist()

        made = self.spark.createDataFrame(self._blocks.flatMap(work), "i array<int>, w array<array<double>>")
        out = materialise(made.select(F.inline(F.arrays_zip(F.col("i").alias("number"), F.col("w").alias("w")))), "coefficients")
        sent.destroy()
        return out

    def close(self) -> None:
        self._blocks.unpersist()
        self._ids.destroy()


# --- losses of margins: value, and its slope per margin; one column per class ---------------------------

def logistic_loss(y: np.ndarray):
    sign = np.where(y > 0, 1.0, -1.0)[:, None]

    def loss(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = sign * m
        return np.logaddexp(0.0, -z)[:, 0], -sign * np.exp(-np.logaddexp(0.0, z))

    return loss


def softmax_loss(y: np.ndarray, classes: int):
    at = np.arange(len(y))

    def loss(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = m.max(axis=1, keepdims=True)
        total = np.log(np.exp(m - top).sum(axis=1, keepdims=True)) + top
        slope = np.exp(m - total)
        slope[at, y] -= 1.0
        return total[:, 0] - m[at, y], slope

    return loss


def hinge_loss(y: np.ndarray, width: float):
    """Hinge with a corner rounded over ``width``; 0 leaves the corner."""
    sign = np.where(y > 0, 1.0, -1.0)[:, None]

    def loss(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = 1.0 - sign * m
        if not width:
            return np.maximum(z, 0.0)[:, 0], -sign * (z > 0)
        value = np.where(z <= 0, 0.0, np.where(z < width, z * z / (2 * width), z - width / 2))
        return value[:, 0], -sign * np.clip(z / width, 0.0, 1.0)

    return loss


# --- optimiser --------------------------------------------------------------------------------------

@dataclass
class _Point:
    """A vector of coefficients and intercepts: row weights ``a`` with the intercepts in a last row, and what ``X X'`` makes of them."""

    a: np.ndarray
    k: np.ndarray

    def plus(self, other: _Point, by: float = 1.0) -> _Point:
        return _Point(self.a + by * other.a, self.k + by * other.k)

    def dot(self, other: _Point) -> float:
        return float(np.sum(self.a * other.k))


def _step(value: Callable[[float], tuple[float, float]]) -> float:
    """Step at which a convex function's slope vanishes; rows only, so a trial costs no job."""
    low, high = 0.0, 1.0
    for _ in range(40):
        if value(high)[1] >= 0:
            break
        low, high = high, 2 * high
    first = abs(value(0.0)[1])
    for _ in range(40):
        middle = (low + high) / 2
        slope = value(middle)[1]
        if abs(slope) <= 0.01 * first or high - low <= 1e-9 * high:
            return middle
        low, high = (middle, high) if slope < 0 else (low, middle)
    return (low + high) / 2


def minimise(times: Callable[[np.ndarray], np.ndarray], loss, weight: np.ndarray, penalty: float, start: _Point, rounds: int, tolerance: float = TOLERANCE) -> tuple[_Point, int]:
    """L-BFGS for weighted mean loss plus half the penalty times the squared coefficients; returns the point and the rounds used."""
    share = (weight / weight.sum())[:, None]

    def margins(p: _Point) -> np.ndarray:
        return p.k[:-1] + p.a[-1]

    def at(p: _Point) -> tuple[float, np.ndarray]:
        value, slope = loss(margins(p))
        return float(value @ share[:, 0]) + penalty / 2 * float(np.sum(p.a[:-1] * p.k[:-1])), share * slope

    def gradient(p: _Point, slope: np.ndarray) -> _Point:
        ends = slope.sum(axis=0, keepdims=True)
        return _Point(np.vstack([slope + penalty * p.a[:-1], ends]), np.vstack([times(slope) + penalty * p.k[:-1], ends]))

    x = start
    f, slope = at(x)
    g = gradient(x, slope)
    kept: list[tuple[_Point, _Point, float]] = []
    for done in range(rounds):
        q, taken = g, []
        for s, y, rho in reversed(kept):
            by = rho * s.dot(q)
            taken.append(by)
            q = q.plus(y, -by)
        scale = 1 / (kept[-1][2] * kept[-1][1].dot(kept[-1][1])) if kept else 1.0
        q = _Point(scale * q.a, scale * q.k)
        for (s, y, rho), by in zip(kept, reversed(taken), strict=True):
            q = q.plus(s, by - rho * y.dot(q))
        d = _Point(-q.a, -q.k)
        if g.dot(d) >= 0:
            return x, done
        m, md = margins(x), margins(d)
        cross, square = float(np.sum(x.a[:-1] * d.k[:-1])), float(np.sum(d.a[:-1] * d.k[:-1]))

        def along(t: float, m=m, md=md, cross=cross, square=square) -> tuple[float, float]:
            value, change = loss(m + t * md)
            return float(value @ share[:, 0]), float(np.sum(share * change * md)) + penalty * (cross + t * square)

        t = _step(along)
        new = x.plus(d, t)
        f_new, slope = at(new)
        if f_new >= f:
            return x, done + 1
        g_new = gradient(new, slope)
        s, y = _Point(t * d.a, t * d.k), g_new.plus(g, -1.0)
        if s.dot(y) > 1e-300:
            kept = [*kept[1 - HISTORY:], (s, y, 1 / s.dot(y))]
        small, x, g, f = f - f_new <= tolerance * abs(f_new), new, g_new, f_new
        if small:
            return x, done + 1
    return x, rounds


def _start(n: int, shifts: np.ndarray) -> _Point:
    zero = np.vstack([np.zeros((n, len(shifts))), shifts[None, :]])
    return _Point(zero, zero.copy())


# --- models ------------------------------------------------------------------------------------------

@dataclass
class LinearModel:
    """Coefficients as a table ``(number, w)`` with one value per margin, and the intercepts."""

    weights: DataFrame
    shifts: list[float]

    def margins(self, df: DataFrame, name: str = "margins") -> DataFrame:
        """``df`` with an array of margins; packed entries meet the coefficients of their column block, only sums come back."""
        df = with_rows(df)
        indices, values = _sparse(df)
        rows, count = df.select("_row", indices.alias("indices"), values.alias("values")), len(self.shifts)
        spark = df.sparkSession
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
        blocks = max(spark.sparkContext.defaultParallelism, -(-self.weights.count() // MARGIN_TERMS))
        both = rows.mapInArrow(_deal_entries(blocks), _ENTRIES).unionByName(self.weights.select("number", "w").mapInArrow(_deal_weights(blocks), _ENTRIES))
        dealt = both.repartitionById(blocks, "block").sortWithinPartitions("block", F.desc("w"))
        parts = [f"s{k}" for k in range(count)]
        summed = dealt.mapInArrow(_sum_entries(count), ", ".join(["_row long", *(f"{p} double" for p in parts)]))
        found = summed.groupBy("_row").agg(F.array(*[F.sum(p) for p in parts]).alias("_sums"))
        made = [F.coalesce(F.get("_sums", F.lit(k)), F.lit(0.0)) + F.lit(x) for k, x in enumerate(self.shifts)]
        return df.join(found, "_row", "left").withColumn(name, settled(F.array(*made))).drop("_sums")

    def save(self, path: str) -> None:
        self.weights.write.parquet(f"{path}/weights")
        text = self.weights.sparkSession.createDataFrame([(json.dumps(self.shifts),)], "shifts string")
        text.coalesce(1).write.text(f"{path}/shifts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        return LinearModel(spark.read.parquet(f"{path}/weights"), json.loads(spark.read.text(f"{path}/shifts").first()[0]))


def _model(products: RowProducts, point: _Point) -> LinearModel:
    return LinearModel(products.coefficients(point.a[:-1]), [float(x) for x in point.a[-1]])


def _constant(products: RowProducts, shifts: list[float]) -> LinearModel:
    return LinearModel(products.coefficients(np.zeros((products.n, len(shifts)))), shifts)


def fit_logistic(rows: DataFrame, c: float, rounds: int, classes: int = 2) -> LinearModel:
    """Logistic model with L2 penalty ``1 / (c n)``: one margin for two classes, else one per class. Intercepts are not penalised."""
    products = RowProducts(rows)
    try:
        y, n = products.label, products.n
        shares = np.bincount(y, products.weight, classes) / products.weight.sum()
        if classes <= 2:
            if not 0 < shares[-1] < 1:
                return _constant(products, [float("inf") if shares[-1] > 0 else float("-inf")])
            loss, shifts = logistic_loss(y), np.array([np.log(shares[1] / shares[0])])
        else:
            logs = np.log(shares)
            loss, shifts = softmax_loss(y, classes), logs - logs.mean()
        point, _ = minimise(products.times, loss, products.weight, 1 / (c * n), _start(n, shifts), rounds)
        return _model(products, point)
    finally:
        products.close()


def _hinge(products: RowProducts, y: np.ndarray, penalty: float, rounds: int) -> _Point:
    """Hinge through ever sharper corners; the point with the least true objective."""
    share = products.weight / products.weight.sum()
    point, best, least, left = _start(products.n, np.zeros(1)), None, np.inf, rounds
    for k, width in enumerate(HINGE_WIDTHS):
        allowed = left // (len(HINGE_WIDTHS) - k)
        point, used = minimise(products.times, hinge_loss(y, width), products.weight, penalty, point, allowed, 1e-6)
        left -= used
        value = float(hinge_loss(y, 0.0)(point.k[:-1] + point.a[-1])[0] @ share) + penalty / 2 * float(np.sum(point.a[:-1] * point.k[:-1]))
        if value < least:
            best, least = point, value
    return best


def fit_svm(rows: DataFrame, c: float, rounds: int, rest: int = 0) -> LinearModel:
    """Linear SVM with L2 penalty ``1 / (c n)``: one margin of label 1, or with ``rest`` classes one of each against the rest."""
    products = RowProducts(rows)
    try:
        penalty = 1 / (c * products.n)
        targets = [(products.label == k).astype(np.int32) for k in range(rest)] if rest else [products.label]
        points = [_hinge(products, y, penalty, rounds) for y in targets]
        return _model(products, _Point(np.hstack([p.a for p in points]), np.hstack([p.k for p in points])))
    finally:
        products.close()

