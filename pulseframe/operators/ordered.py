"""Global-order kit: running totals and row positions without one big window."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.session import keyed, materialise

#: Quantile slices of a table of values.
SLICES = 64


def _slice_of(value: Column, bounds: Sequence[float]) -> Column:
    if not bounds:
        return F.lit(0)
    edges = F.array(*[F.lit(float(b)) for b in bounds])
    return F.size(F.filter(edges, lambda e: e <= value))


def running_totals(
    df: DataFrame, keys: Sequence[str], order_col: str, sums: Mapping[str, str], descending: bool = True
) -> DataFrame:
    """Running sums per key over distinct values of a numeric ``order_col``.

    ``df`` should be a written table (see ``materialise``) because it is read three times. The values are cut at fixed
    quantiles, summed per slice, and each slice starts at the total of the slices before it.
    """
    direction = F.col(order_col).desc() if descending else F.col(order_col).asc()
    probabilities = [i / SLICES for i in range(1, SLICES)]
    # At most SLICES numbers reach the driver; as literals they are the same in every branch of the plan.
    bounds = df.agg(F.percentile_approx(order_col, probabilities, 10_000)).first()[0] or []
    sliced = df.withColumn("_slice", _slice_of(F.col(order_col), sorted(set(bounds))))
    inner = Window.partitionBy(*keys, "_slice").orderBy(direction).rowsBetween(Window.unboundedPreceding, 0)
    outer_order = F.col("_slice").desc() if descending else F.col("_slice").asc()
    outer = Window.partitionBy(*keyed(keys)).orderBy(outer_order).rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    offsets = totals.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_t_{out}").over(outer), F.lit(0)).alias(f"_o_{out}") for out in sums]
    )
    local = sliced.withColumns({out: F.sum(col).over(inner) for out, col in sums.items()})
    joined = local.join(offsets, [*keys, "_slice"])
    return joined.withColumns({out: F.col(out) + F.col(f"_o_{out}") for out in sums}).drop(
        "_slice", *[f"_o_{out}" for out in sums]
    )


def ranked_rows(df: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """``position`` and running positives ``found`` of every row by (score descending, ``tie`` ascending).

    Rows are range-partitioned by (score, tie), so one hot score is many tasks and ``tie`` may be of any type; each
    range starts at the totals of the ranges before it. ``tie`` should be unique.
    """
    order = [F.col(score).desc(), F.col(tie).asc()]
    placed = df.repartitionByRange(*order).select("*", F.col(label).cast("bigint").alias("_y"), F.spark_partition_id().alias("_range"))
    placed = materialise(placed, "ranges")
    sums = placed.groupBy("_range").agg(F.count("*").alias("_n"), F.sum("_y").alias("_p"))
    # One row per range.
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_p")])
    inner = Window.partitionBy("_range").orderBy(*order)
    found = F.sum("_y").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return (
        placed.join(starts, "_range")
        .withColumns({"position": F.col("_n_before") + F.row_number().over(inner), "found": F.col("_p_before") + found})
        .drop("_range", "_y", "_n_before", "_p_before")
    )


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, str] | None = None, peaks: Mapping[str, str] | None = None
) -> DataFrame:
    """``df`` with running sums and running maxima (``out: column``) per key in the given order, current row included.

    Rows are cut into ranges of (keys, order), so one key is many tasks; each range starts with the state at the end of the
    ranges before it. Rows that are equal in the order may count each other or not. Keys must not be null.
    """
    wanted: list[tuple[str, str, Callable]] = [(o, c, F.sum) for o, c in (sums or {}).items()] + [(o, c, F.max) for o, c in (peaks or {}).items()]
    placed = df.repartitionByRange(*[F.asc(k) for k in keys], *order).withColumn("_range", F.spark_partition_id())
    placed = materialise(placed, "ranges")
    ends = placed.groupBy(*keys, "_range").agg(*[f(c).alias(f"_e_{o}") for o, c, f in wanted])
    before = Window.partitionBy(*keyed(keys)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, "_range", *[f(f"_e_{o}").over(before).alias(f"_s_{o}") for o, _, f in wanted])
    inner = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({o: f(c).over(inner) for o, c, f in wanted}).join(starts, [*keys, "_range"])
    zero = F.lit(0)
    whole = {o: F.coalesce(o, zero) + F.coalesce(f"_s_{o}", zero) if f is F.sum else F.greatest(o, f"_s_{o}") for o, _, f in wanted}
    return local.withColumns(whole).drop("_range", *[f"_s_{o}" for o, _, _ in wanted])


def numbered_values(df: DataFrame, column: str, name: str = "number") -> DataFrame:
    """The distinct values of a column that are not null, numbered from 0 in ascending order."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    return running(values, [], [F.asc(column)], {name: "_one"}).select(column, (F.col(name) - 1).alias(name))
