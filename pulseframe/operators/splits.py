"""Group-aware, temporal and hashed splits and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions import intent, text
from pulseframe.operators.evaluation import score_table
from pulseframe.operators.ordered import ranked_rows, running_totals
from pulseframe.session import materialise

# --- fixed values -------------------------------------------------------------
FRACTIONS = {"train": 0.70, "validation": 0.15, "test": 0.15}
SAMPLE_PER_CLASS = 60
GROUP_MODE, DEVELOPMENT_MODE = "group_holdout", "development_only"


def hashed(key: Column, seed: int | str) -> Column:
    """Text whose order is a reproducible shuffle of the keys."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def effective_groups(df: DataFrame, group: str = "parent_id", record: str = "record_id") -> DataFrame:
    """H4: rows without a group become groups of their own and make the split development-only."""
    fallback = F.concat(F.lit("row:"), F.col(record).cast("string"))
    return df.withColumns(
        {"group_key": F.coalesce(F.col(group).cast("string"), fallback), "used_fallback": F.col(group).isNull()}
    )


def sample_per_class(df: DataFrame, label: str, key: str, n: int = SAMPLE_PER_CLASS, seed: int = 42) -> DataFrame:
    """H1: up to ``n`` rows per class in hashed order; the rank limit is applied before the shuffle."""
    order = Window.partitionBy(label).orderBy(hashed(F.col(key), seed), key)
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def audit_sample(df: DataFrame, key: str, recall_n: int, precision_n: int, seed: int = 42, label: str = "intent_label") -> DataFrame:
    """H2: recall rows from the general class and precision rows per other predicted label."""
    is_recall = F.col(label) == intent.GENERAL
    quota = F.when(is_recall, recall_n).otherwise(precision_n)
    order = Window.partitionBy(label).orderBy(hashed(F.col(key), seed), key)
    ranked = df.filter(F.col(label).isNotNull()).withColumn("_rank", F.row_number().over(order))
    kept = ranked.filter(F.col("_rank") <= max(recall_n, precision_n)).filter(F.col("_rank") <= quota)
    return kept.drop("_rank").withColumn("sample_type", F.when(is_recall, "recall").otherwise("precision"))


def audit_shortage(df: DataFrame, sample: DataFrame, recall_n: int, precision_n: int, label: str = "intent_label") -> DataFrame:
    """H2: requested against available rows per label."""
    wanted = F.when(F.col(label) == intent.GENERAL, recall_n).otherwise(precision_n)
    have = sample.groupBy(label).agg(F.count("*").alias("selected"))
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("available")).join(have, label).select(
        label, wanted.alias("requested"), "available", "selected", (wanted > F.col("available")).alias("short")
    )


def patch_missing_classes(sample: DataFrame, audited: DataFrame, label: str, audited_label: str, taxonomy: Sequence[str] = intent.TAXONOMY) -> DataFrame:
    """Audited rows are added only for classes the sample lacks."""
    wanted = audited.filter(F.col(audited_label).isin(*taxonomy)).withColumn(label, F.col(audited_label))
    extra = wanted.join(sample.select(label).distinct(), label, "left_anti")
    return sample.unionByName(extra, allowMissingColumns=True)


def assign_groups(df: DataFrame, seed: int = 42, fractions: Mapping[str, float] = FRACTIONS) -> DataFrame:
    """H3: split of every group, whole groups: the running row count in hashed order is cut at the target shares.

    A group falls to the split that holds the middle of its rows. The same rule holds for any number of groups.
    """
    if abs(sum(fractions.values()) - 1.0) > 1e-9:
        raise ValueError(f"the shares {dict(fractions)} must add up to 1")
    sizes = materialise(df.groupBy("group_key").agg(F.count("*").alias("rows")), "groups")
    return _splits_by_seed(sizes, [seed], fractions).drop("seed")


def _splits_by_seed(sizes: DataFrame, seeds: Sequence[int], fractions: Mapping[str, float]) -> DataFrame:
    """(seed, group_key, split) of all seeds at once, from ``sizes (group_key, rows)``."""
    place = F.lit(None).cast("double")
    for seed in seeds:
        place = F.when(F.col("seed") == seed, F.conv(F.substring(hashed(F.col("group_key"), seed), 1, 13), 16, 10).cast("double")).otherwise(place)
    every = F.explode(F.array(*[F.lit(seed) for seed in seeds])).alias("seed")
    sized = materialise(sizes.select("group_key", "rows", every).withColumn("place", place), "seeded")
    by_hash = materialise(sized.groupBy("seed", "place").agg(F.sum("rows").alias("rows")), "places")
    placed = running_totals(by_hash, ["seed"], "place", {"_upto": "rows"}, descending=False)
    total = F.lit(sizes.agg(F.sum("rows")).first()[0])
    middle = (F.col("_upto") - F.col("rows") / 2.0) / total
    cut, split = 0.0, None
    for name, share in fractions.items():
        cut += share
        split = F.when(middle < cut, name) if split is None else split.when(middle < cut, name)
    places = placed.select("seed", "place", split.otherwise(list(fractions)[-1]).alias("split"))
    return sized.join(places, ["seed", "place"]).select("seed", "group_key", "split")


def group_split(df: DataFrame, seed: int = 42, group: str = "parent_id", record: str = "record_id", fractions: Mapping[str, float] = FRACTIONS) -> DataFrame:
    """H3: rows with the split of their group; refused when a split gets no group."""
    rows = effective_groups(df, group, record)
    groups = materialise(assign_groups(rows, seed, fractions), "splits")
    have = {r["split"] for r in groups.select("split").distinct().collect()}
    if empty := sorted(name for name, share in fractions.items() if share > 0 and name not in have):
        raise ValueError(f"no group falls to {', '.join(empty)}")
    return rows.join(groups, "group_key")


def hashed_group_split(df: DataFrame, seed: int = 42, group: str = "group_key", fractions: Mapping[str, float] = FRACTIONS) -> DataFrame:
    """H3 without any shuffle: the split follows from the hash of the group alone."""
    place = F.conv(F.substring(hashed(F.col(group), seed), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    cut, split = 0.0, None
    for name, share in fractions.items():
        cut += share
        split = F.when(place < cut, name) if split is None else split.when(place < cut, name)
    return df.withColumn("split", split.otherwise(list(fractions)[-1]))


def split_manifest(df: DataFrame, group: str = "parent_id", seed: int = 42) -> DataFrame:
    """H6: rows, groups and evaluation mode per split."""
    mode = F.when(F.bool_or("used_fallback"), DEVELOPMENT_MODE).otherwise(GROUP_MODE)
    any_fallback = df.agg(mode.alias("evaluation_mode"))
    counts = df.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"))
    return counts.withColumn("seed", F.lit(seed)).withColumn("evaluation_mode", any_fallback.scalar())


def split_support(df: DataFrame, seeds: Sequence[int], label: str, part: str = "test", taxonomy: Sequence[str] = intent.TAXONOMY) -> DataFrame:
    """Class support of one split for each seed. The rows are read once, into class counts per group."""
    groups = effective_groups(df).groupBy("group_key").agg(F.count("*").alias("rows"), *[F.count_if(F.col(label) == c).alias(c) for c in taxonomy])
    groups = materialise(groups, "support")
    placed = groups.join(_splits_by_seed(groups.select("group_key", "rows"), seeds, FRACTIONS), "group_key")
    mine = F.col("split") == part
    counts = [F.coalesce(F.sum(F.when(mine, F.col(c))), F.lit(0)).cast("bigint").alias(c) for c in taxonomy]
    return placed.groupBy("seed").agg(
        F.coalesce(F.sum(F.when(mine, F.col("rows"))), F.lit(0)).cast("bigint").alias("test_rows"), F.count_if(mine).alias("test_groups"), *counts)


def zero_support(support: DataFrame, taxonomy: Sequence[str] = intent.TAXONOMY) -> DataFrame:
    """Number of seeds in which a class has no test row."""
    long = support.unpivot(["seed"], list(taxonomy), "label", "rows")
    return long.groupBy("label").agg(F.count_if(F.col("rows") == 0).alias("seeds_with_zero_support"))


def temporal_split(df: DataFrame, ts: str, tie: str, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """H5: earlier rows train, later rows test, cut at exact positions; every row needs a time."""
    if df.filter(F.col(ts).isNull()).limit(1).count():
        raise ValueError(f"temporal split needs {ts} on every row")
    # Positions come from counts per time, so no window spans the table.
    base = df.withColumns({"_late": (-F.unix_micros(ts)).cast("double"), "_zero": F.lit(0)})
    table = score_table(base, "_zero", "_late")
    total = table.agg(F.sum("n")).first()[0] or 0
    ranked = ranked_rows(base, "_late", "_zero", tie)
    position = F.col("position") - 1
    split = F.when(position < int(total * train), "train").when(position < int(total * (train + validation)), "validation")
    return ranked.withColumn("split", split.otherwise("test")).drop("_late", "_zero", "position", "found")


def group_folds(df: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """H7: fold of every group, from the hash of its key alone, so any number of groups is dealt alike."""
    place = F.conv(F.substring(hashed(F.col("group_key"), seed), 1, 8), 16, 10).cast("bigint")
    return df.select("group_key").distinct().withColumn("fold", (place % max(2, folds)).cast("int"))


def fold_split(df: DataFrame, fold: int, seed: int = 42) -> DataFrame:
    """H8: the fold is held out; of the rest the validation groups calibrate, all others train.

    ``df`` carries ``group_key`` and ``fold``.
    """
    rest = df.filter(F.col("fold") != fold)
    inner = assign_groups(rest, seed).withColumn("split", F.when(F.col("split") == "validation", "validation").otherwise("train"))
    held = df.filter(F.col("fold") == fold).withColumn("split", F.lit("held_out"))
    return rest.join(inner, "group_key").unionByName(held)


def leakage(df: DataFrame, group: str = "parent_id") -> DataFrame:
    """Number of groups and of texts that two splits share, without a self join."""
    rows = df.select("split", F.col(group).cast("string").alias("g"), F.sha2(text.casefold(F.trim("text")), 256).alias("t"))
    kinds = F.array(F.struct(F.lit("group").alias("kind"), F.col("g").alias("key")), F.struct(F.lit("text").alias("kind"), F.col("t").alias("key")))
    long = rows.select("split", F.inline(kinds)).filter(F.col("key").isNotNull())
    # At most one entry per split.
    splits = long.groupBy("kind", "key").agg(F.array_sort(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    pairs = F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("first"), b.alias("second"))))))
    return splits.select("kind", pairs.alias("p")).groupBy("kind", "p.first", "p.second").agg(F.count("*").alias("shared"))
