"""Binary, ranking and calibration metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions import scoring
from pulseframe.operators.ordered import ranked_rows, running, running_totals
from pulseframe.session import keyed, materialise, side_by_side

# --- fixed values -------------------------------------------------------------
K_VALUES = (10, 25, 50, 100)
PERCENTAGES = (0.05, 0.10, 0.20)
CONFIDENT_ERRORS = 50
BOOTSTRAPS = 1000
MIN_CANDIDATE_SHIFT = 1e-9


def score_table(
    df: DataFrame, y: str, score: str, keys: Sequence[str] = (), pred: str | None = None
) -> DataFrame:
    """One row per distinct (key, score[, prediction]) with its rows and positives, written once.

    Every metric below is computed from this table, so the rows are scanned and shuffled a single time
    and a score shared by many rows arrives already counted.
    """
    extra = [F.col(pred).cast("int").alias("pred")] if pred else []
    grouped = df.groupBy(*keys, F.col(score).cast("double").alias("score"), *extra).agg(
        F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("positives")
    )
    return materialise(grouped, "scores")


def _merge(keys: Sequence[str], frames: list[DataFrame]) -> DataFrame:
    if not keys:
        return side_by_side(*frames)
    out = frames[0]
    for frame in frames[1:]:
        out = out.join(frame, list(keys), "left")
    return out


def confusion(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 and the four counts; empty denominators give 0."""
    positives, negatives = F.col("positives"), F.col("n") - F.col("positives")
    predicted = F.col("pred") == 1

    def total(condition, value):
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))

    counts = table.groupBy(*keys).agg(
        total(predicted, positives).alias("tp"),
        total(predicted, negatives).alias("fp"),
        total(~predicted, positives).alias("fn"),
        total(~predicted, negatives).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return counts.withColumns(
        {
            "support_total": tp + fp + fn + tn,
            "support_positive": tp + fn,
            "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
            "precision": F.coalesce(F.try_divide(tp, tp + fp), zero),
            "recall": F.coalesce(F.try_divide(tp, tp + fn), zero),
            "f1": F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero),
        }
    )


def _by_score(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    if "pred" not in table.columns:
        return table
    return table.groupBy(*keys, "score").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))


def ranking_areas(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC with tied scores and average precision; null with a single class."""
    cumulative = running_totals(_by_score(table, keys), keys, "score", {"cum_n": "n", "cum_pos": "positives"})
    pos = F.col("positives").cast("double")
    neg = (F.col("n") - F.col("positives")).cast("double")
    area = neg * (F.col("cum_pos") - F.col("positives") + pos / 2.0)
    step = pos * F.col("cum_pos") / F.col("cum_n")
    sums = cumulative.groupBy(*keys).agg(
        F.sum(area).alias("_area"), F.sum(step).alias("_step"), F.sum(pos).alias("_p"), F.sum(neg).alias("_q")
    )
    both = (F.col("_p") > 0) & (F.col("_q") > 0)
    return sums.select(
        *keys,
        F.when(both, F.try_divide("_area", F.col("_p") * F.col("_q"))).alias("roc_auc"),
        F.when(both, F.try_divide("_step", "_p")).alias("pr_auc"),
    )


def bin_edges(bins: int) -> list[float]:
    """Inner edges of equal-width bins over [0, 1], as multiples of the step."""
    step = 1.0 / bins
    return [i * step for i in range(1, bins)]


def bin_of(p: Column, bins: int) -> Column:
    """Bin number from 0; the last bin is closed. Compares with the edges, not with ``floor``."""
    inside = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    number = F.lit(0)
    for edge in bin_edges(bins):
        number = number + F.when(inside >= F.lit(edge), 1).otherwise(0)
    return number


def calibration_bins(table: DataFrame, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Rows, mean probability and observed rate per non-empty bin."""
    clipped = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return (
        table.groupBy(*keys, bin_of(F.col("score"), bins).alias("bin"))
        .agg(
            F.sum("n").alias("n"),
            F.sum("positives").alias("positives"),
            (F.sum(clipped * F.col("n")) / F.sum("n")).alias("mean_predicted"),
        )
        .withColumn("observed_rate", F.col("positives") / F.col("n"))
    )


def calibration_error(table: DataFrame, keys: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Expected calibration error."""
    gap = F.abs(F.col("observed_rate") - F.col("mean_predicted"))
    return calibration_bins(table, keys, bins).groupBy(*keys).agg(
        (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece")
    )


def brier(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of the clipped probability, from counts per score."""
    p = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    pos, neg = F.col("positives"), F.col("n") - F.col("positives")
    error = pos * (F.lit(1.0) - p) * (F.lit(1.0) - p) + neg * p * p
    return table.groupBy(*keys).agg((F.sum(error) / F.sum("n")).alias("brier_score"))


def reliability_table(spark, table: DataFrame, bins: int = 5) -> DataFrame:
    """Equal-width bins including empty ones, with Wilson intervals."""
    edges = [0.0, *bin_edges(bins), 1.0]
    names = [(i, f"{edges[i]:.1f}-{edges[i + 1]:.1f}") for i in range(bins)]
    spine = spark.createDataFrame(names, "bin int, label string")
    filled = spine.join(calibration_bins(table, (), bins), "bin", "left").fillna(0, ["n", "positives"])
    low, high = scoring.wilson(F.col("positives"), F.col("n"))
    return filled.select(
        F.col("label").alias("bin"), "n", "mean_predicted", "observed_rate",
        low.alias("observed_95_low"), high.alias("observed_95_high"),
    )


def binary_metrics(
    df: DataFrame, y: str, pred: str, p: str, keys: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """D25-D29 per key from one pass over the rows."""
    table = score_table(df, y, p, keys, pred)
    return _merge(
        keys, [confusion(table, keys), ranking_areas(table, keys), brier(table, keys), calibration_error(table, keys, bins)]
    )


def _cutoffs(total: Column, ks: Sequence[int], percentages: Sequence[float]) -> list[tuple[str, Column]]:
    fixed = [(f"at_{k}", F.when(total >= k, F.lit(k))) for k in ks]
    shares = [
        (f"at_{int(round(q * 100))}pct", F.greatest(F.lit(1), F.bround(total * F.lit(q)).cast("bigint")))
        for q in percentages
    ]
    return fixed + shares


def ranking_metrics(
    df: DataFrame, y: str, score: str, tie: str,
    ks: Sequence[int] = K_VALUES, percentages: Sequence[float] = PERCENTAGES,
) -> DataFrame:
    """Precision, recall and lift at each cut-off; ties by ``tie``, shares round half to even."""
    table = score_table(df, y, score)
    rows = df.select(F.col(score).cast("double").alias("score"), F.col(y).cast("bigint").alias("y"), tie)
    ranked = ranked_rows(rows, "score", "y", tie)
    totals = table.agg(F.sum("n").alias("total"), F.sum("positives").alias("all_positives")).first()
    n, positives = totals["total"] or 0, totals["all_positives"] or 0
    cuts = _cutoffs(F.lit(n), ks, percentages)
    hits = ranked.agg(*[F.coalesce(F.sum(F.when(F.col("position") <= k, F.col("y"))), F.lit(0)).alias(name) for name, k in cuts])
    structs = [
        F.struct(F.lit(name).alias("cutoff"), k.cast("bigint").alias("k"), F.col(name).alias("hits")) for name, k in cuts
    ]
    long = hits.select(F.inline(F.array(*structs))).filter(F.col("k").isNotNull())
    base = F.lit(positives) / F.lit(n or 1)
    precision = F.try_divide(F.col("hits"), F.least("k", F.lit(n)))
    return long.select(
        "cutoff", "k",
        precision.alias("precision"),
        F.coalesce(F.try_divide(F.col("hits"), F.lit(positives)), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(precision, base), F.lit(0.0)).alias("lift"),
    )


def gains_curve(df: DataFrame, y: str, score: str, tie: str) -> DataFrame:
    """Reviewed fraction, gain, precision and lift at every position."""
    table = score_table(df, y, score)
    rows = df.select(F.col(score).cast("double").alias("score"), F.col(y).cast("bigint").alias("y"), tie)
    totals = table.agg(F.sum("n").alias("n"), F.sum("positives").alias("p")).first()
    n, positives = totals["n"] or 1, totals["p"] or 0
    base = max(positives / n, 1e-9)
    precision = F.col("found") / F.col("position")
    return ranked_rows(rows, "score", "y", tie).select(
        tie, "position",
        (F.col("position") / F.lit(n)).alias("fraction_reviewed"),
        (F.col("found") / F.lit(max(positives, 1))).alias("gain"),
        precision.alias("precision"),
        (precision / F.lit(base)).alias("lift"),
    )


def threshold_table(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of ``score > threshold`` at every distinct score and below the lowest."""
    cumulative = running_totals(_by_score(table, keys), keys, "score", {"cum_n": "n", "cum_pos": "positives"})
    totals = table.groupBy(*keys).agg(
        F.sum("positives").alias("_all_pos"), F.sum("n").alias("_all"), F.min("score").alias("_lowest")
    )
    at = cumulative.select(
        *keys, F.col("score").alias("threshold"),
        (F.col("cum_n") - F.col("n")).alias("_picked"),
        (F.col("cum_pos") - F.col("positives")).alias("_tp"),
    )
    below = totals.select(
        *keys, (F.col("_lowest") - F.lit(MIN_CANDIDATE_SHIFT)).alias("threshold"),
        F.col("_all").alias("_picked"), F.col("_all_pos").alias("_tp"),
    )
    both = at.unionByName(below)
    small = totals.select(*keys, "_all_pos")
    joined = both.join(small, list(keys)) if keys else both.withColumn("_all_pos", F.lit(table.agg(F.sum("positives")).first()[0]))
    zero = F.lit(0.0)
    return joined.select(
        *keys, "threshold",
        F.coalesce(F.try_divide("_tp", "_picked"), zero).alias("precision"),
        F.coalesce(F.try_divide("_tp", "_all_pos"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("_tp"), F.col("_picked") + F.col("_all_pos")), zero).alias("f1"),
    )


def select_threshold(
    df: DataFrame, y: str, score: str, objective: str = "f1",
    min_precision: float | None = None, min_recall: float | None = None, keys: Sequence[str] = (),
) -> DataFrame:
    """Best threshold, the lowest of equals; without a candidate that meets the constraint best F1."""
    if objective == "min_precision":
        if min_precision is None:
            raise ValueError("min_precision objective requires a min_precision value")
        value = F.when(F.col("precision") >= min_precision, F.col("recall"))
    elif objective == "min_recall":
        if min_recall is None:
            raise ValueError("min_recall objective requires a min_recall value")
        value = F.when(F.col("recall") >= min_recall, F.col("precision"))
    elif objective == "f1":
        value = F.col("f1")
    else:
        raise ValueError(f"Unknown threshold objective: {objective!r}")
    candidates = threshold_table(score_table(df, y, score, keys), keys)

    def best(v: Column) -> Column:
        return F.max(F.when(v.isNotNull(), F.struct(v.alias("value"), (-F.col("threshold")).alias("minus"))))

    picked = candidates.groupBy(*keys).agg(best(value).alias("_best"), best(F.col("f1")).alias("_f1"))
    chosen = F.coalesce("_best", "_f1")
    return picked.select(
        *keys,
        (-chosen.getField("minus")).alias("selected_threshold"),
        F.when(F.col("_best").isNotNull(), objective).otherwise("f1").alias("selection_metric"),
        chosen.getField("value").alias("validation_score"),
    )


def scalar_metrics(df: DataFrame, y: str, pred: str, p: str, tie: str) -> DataFrame:
    """One row of headline metrics with base rate and lifts."""
    core = binary_metrics(df, y, pred, p).select(
        "pr_auc", "roc_auc", F.col("brier_score").alias("brier"), "ece", "precision", "recall", "f1",
        (F.col("support_positive") / F.col("support_total")).alias("base_rate"),
    )
    ranking = ranking_metrics(df, y, p, tie, ks=(), percentages=(0.10, 0.20))
    at = lambda cut, value: F.max(F.when(F.col("cutoff") == cut, F.col(value)))
    lifts = ranking.agg(
        at("at_10pct", "precision").alias("precision_at_10pct"),
        at("at_10pct", "lift").alias("lift_at_10pct"),
        at("at_20pct", "lift").alias("lift_at_20pct"),
    )
    return side_by_side(core, lifts)


def error_slices(df: DataFrame, dimensions: Sequence[str], y: str, pred: str, p: str, correct: str, keys: Sequence[str] = ()) -> DataFrame:
    """Error rates per value of each dimension, one shuffle for all dimensions."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    long = df.select(*keys, F.inline(pairs), F.col(y).alias("y"), F.col(pred).alias("pred"), F.col(p).alias("p"), F.col(correct).alias("ok"))
    hit = F.when(F.col("pred") == 1, 1.0).otherwise(0.0)
    return long.filter(F.col("value").isNotNull()).groupBy(*keys, "dimension", "value").agg(
        F.count("*").alias("n"),
        F.sum(F.col("y").cast("bigint")).alias("actionable"),
        F.avg(F.when(F.col("y") == 1, hit)).alias("recall"),
        F.avg(F.when(F.col("y") == 0, hit)).alias("false_positive_rate"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
        F.avg(F.col("ok").cast("double")).alias("e2e_accuracy"),
    )


def group_stability(df: DataFrame, group: str, y: str, pred: str, p: str, correct: str, keys: Sequence[str] = ()) -> DataFrame:
    """Size, observed rate, mean probability and accuracy per discussion group."""
    return df.filter(F.col(group).isNotNull()).groupBy(*keys, group).agg(
        F.count("*").alias("n"),
        F.sum(F.col(y).cast("bigint")).alias("actionable"),
        F.avg(F.col(y).cast("double")).alias("observed_rate"),
        F.avg(p).alias("mean_p_actionable"),
        F.avg((F.col(pred) == F.col(y)).cast("double")).alias("stage1_accuracy"),
        F.avg(F.col(correct).cast("double")).alias("e2e_accuracy"),
    )


def seeds_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sample deviation (0 for one value) and median of each metric per model."""
    aggregates = []
    for metric in metrics:
        deviation = F.when(F.count(metric) > 1, F.stddev_samp(metric)).when(F.count(metric) == 1, 0.0)
        aggregates += [
            F.avg(metric).alias(f"{metric}_mean"), deviation.alias(f"{metric}_std"), F.median(metric).alias(f"{metric}_median"),
        ]
    return df.groupBy(*keys).agg(F.count("*").alias("n_seeds"), *aggregates)


def stage_errors(df: DataFrame, y: str, pred: str) -> DataFrame:
    """False positives and false negatives with their kind."""
    kind = F.when((F.col(pred) == 1) & (F.col(y) == 0), "false_positive").when(
        (F.col(pred) == 0) & (F.col(y) == 1), "false_negative"
    )
    return df.withColumn("error_kind", kind).filter(F.col("error_kind").isNotNull())


def confident_errors(df: DataFrame, y: str, pred: str, p: str, tie: str, n: int = CONFIDENT_ERRORS) -> DataFrame:
    """the ``n`` errors with the most extreme probability."""
    errors = stage_errors(df, y, pred).withColumn("error_confidence", F.abs(F.col(p) - F.lit(0.5)))
    return errors.orderBy(F.desc("error_confidence"), tie).limit(n)


def group_bootstrap(
    df: DataFrame, group: str, y: str, p: str, replicates: int = BOOTSTRAPS, seed: int = 0
) -> DataFrame:
    """95% intervals from resampling whole groups with replacement.

    Rows collapse to counts per (group, score) first. A replicate is a table of group weights (as many hashed
    picks as there are groups), never a copy of the rows; the sum by (replicate, score) combines map-side.
    """
    collapsed = materialise(
        df.groupBy(F.col(group).cast("string").alias("g"), F.col(p).cast("double").alias("score")).agg(
            F.count("*").alias("n"), F.sum(F.col(y).cast("bigint")).alias("positives")
        ),
        "bootstrap",
    )
    groups = collapsed.select("g").distinct()
    # Picks address groups by the rank of their hash, counted in ranges of it.
    numbered = groups.withColumns({"_h": F.xxhash64("g"), "_one": F.lit(1).cast("bigint")})
    ranked = running(numbered, [], [F.asc("_h"), F.asc("g")], {"slot": "_one"}).select("g", (F.col("slot") - 1).alias("slot"))
    count = groups.count()
    if count == 0:
        raise ValueError("no groups to resample")
    spark = df.sparkSession
    picks = spark.range(replicates * count).select(
        (F.col("id") % replicates).alias("replicate"),
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).alias("slot"),
    )
    weights = picks.groupBy("replicate", "slot").agg(F.count("*").alias("w"))
    weighted = collapsed.join(ranked, "g").join(weights, "slot")
    table = weighted.groupBy("replicate", "score").agg(
        F.sum(F.col("n") * F.col("w")).alias("n"), F.sum(F.col("positives") * F.col("w")).alias("positives")
    )
    table = materialise(table, "replicates")
    per = _merge(["replicate"], [ranking_areas(table, ["replicate"]), brier(table, ["replicate"]), _lift_of(table, 0.10)])
    valid = per.filter(F.col("pr_auc").isNotNull())
    metrics = ["pr_auc", "roc_auc", "brier_score", "lift_at_10pct"]
    long = valid.unpivot(["replicate"], metrics, "metric", "value")
    return long.groupBy("metric").agg(
        F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high")
    )


def _lift_of(table: DataFrame, share: float) -> DataFrame:
    """Lift at a share of each replicate; a score cut by the limit counts in proportion."""
    keys = ["replicate"]
    cumulative = running_totals(table, keys, "score", {"cum_n": "n", "cum_pos": "positives"})
    whole = Window.partitionBy(*keyed(keys))
    k = F.greatest(F.lit(1.0), F.bround(F.sum("n").over(whole) * F.lit(share)))
    taken = F.least(F.greatest(F.col("_k") - (F.col("cum_n") - F.col("n")), F.lit(0)), F.col("n"))
    found = F.col("positives") * taken / F.col("n")
    sized = cumulative.withColumn("_k", k)
    return sized.groupBy(*keys).agg(
        F.try_divide(F.sum(found) / F.max("_k"), F.sum("positives") / F.sum("n")).alias("lift_at_10pct")
    )
