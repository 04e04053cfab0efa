"""Label quality, annotator agreement and multiclass metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions import intent, text
from pulseframe.session import side_by_side

# --- fixed values -------------------------------------------------------------
TOP_REVISIONS = 10
TOP_GROUPS = 3
MIN_ROWS_FOR_EVALUATION = 30


def label_pairs(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per (first label, second label): the only shuffle of rows behind every measure below."""
    return df.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def per_label(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Support, predictions and hits per label from pair counts, without a self join."""
    same = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)
    roles = F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), same.alias("hits")),
        F.struct(F.col("b").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )
    return pairs.select(*keys, F.inline(roles)).groupBy(*keys, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )


def agreement(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Raw agreement and Cohen's kappa; kappa is null when chance agreement is complete."""
    sums = per_label(pairs, keys).groupBy(*keys).agg(
        F.sum("hits").alias("_same"), F.sum("support").alias("n"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("_chance"),
    )
    observed = F.try_divide("_same", "n")
    chance = F.try_divide("_chance", F.col("n").cast("double") * F.col("n"))
    return sums.select(
        *keys, "n", observed.alias("raw_agreement"), F.try_divide(observed - chance, F.lit(1.0) - chance).alias("kappa")
    )


def cross_table(df: DataFrame, row: str, column: str, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Counts of known values, zero-filled; the value lists keep the width fixed."""
    cells = [F.count_if(F.col(column) == c).alias(c) for c in columns]
    counted = df.groupBy(F.col(row).alias(row)).agg(*cells)
    spine = df.sparkSession.createDataFrame([(r,) for r in rows], f"{row} string")
    return F.broadcast(spine).join(counted, row, "left").fillna(0, list(columns))


def multiclass_per_class(pairs: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; classes of ``labels`` never seen are zero rows."""
    stats = per_label(pairs)
    if labels is not None:
        spine = pairs.sparkSession.createDataFrame([(c,) for c in labels], "label string")
        stats = F.broadcast(spine).join(stats, "label", "left").fillna(0, ["support", "predicted", "hits"])
    zero = F.lit(0.0)
    return stats.select(
        "label", "support",
        F.coalesce(F.try_divide("hits", "predicted"), zero).alias("precision"),
        F.coalesce(F.try_divide("hits", "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("hits"), F.col("predicted") + F.col("support")), zero).alias("f1"),
    )


def multiclass_summary(pairs: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Accuracy, macro and weighted F1, and macro F1 over the classes that occur."""
    classes = multiclass_per_class(pairs, labels).agg(
        F.avg("f1").alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_observed"),
    )
    accuracy = pairs.agg(
        F.try_divide(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy")
    )
    return side_by_side(classes, accuracy)


def top_revisions(pairs: DataFrame, n: int = TOP_REVISIONS) -> DataFrame:
    """Most frequent changes from the first to the final label."""
    changed = pairs.filter(F.col("a") != F.col("b"))
    return changed.select(F.col("a").alias("first_pass"), F.col("b").alias("final"), F.col("n").alias("rows")).orderBy(
        F.desc("rows"), "first_pass", "final"
    ).limit(n)


def revision_summary(df: DataFrame, first: str, final: str) -> DataFrame:
    """Rows with both passes, unchanged share and kappa of the two passes."""
    a, b = F.trim(F.col(first)), F.trim(F.col(final))
    both = a.isNotNull() & (a != "") & b.isNotNull()
    trimmed = df.select(a.alias("_a"), b.alias("_b"), F.coalesce(both, F.lit(False)).alias("_both"))
    counts = trimmed.agg(
        F.count_if("_both").alias("rows_with_both_passes"), F.count_if(~F.col("_both")).alias("rows_without_first_pass"),
        F.count_if(F.col("_both") & (F.col("_a") != F.col("_b"))).alias("revised_rows"),
    )
    measured = agreement(label_pairs(trimmed.filter("_both"), "_a", "_b")).select(
        F.col("raw_agreement").alias("unchanged_share"), F.col("kappa").alias("first_pass_vs_final_kappa")
    )
    return side_by_side(counts, measured)


def validation_report(df: DataFrame, label: str = "corrected_label") -> DataFrame:
    """One row of checks on the labelled corpus.

    Repeats are counted on a hash of the text, so whole texts never travel through the shuffle.
    """
    value = F.col(label)
    present = value.isNotNull()
    rows = df.agg(
        F.count("*").alias("total_rows"),
        F.count_if(text.is_blank(F.col("text"))).alias("missing_text"),
        F.count_if(~present).alias("missing_labels"),
        F.count_if(present & ~value.isin(*intent.TAXONOMY)).alias("unknown_labels"),
        F.count_if(F.col("parent_id").isNull()).alias("missing_parent_ids"),
    )
    ids = df.groupBy("record_id").agg(F.count("*").alias("c")).agg(
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_ids")
    )
    groups = df.filter(F.col("parent_id").isNotNull()).agg(F.count_distinct("parent_id").alias("unique_groups"))
    key = F.sha2(text.casefold(F.trim(F.coalesce(F.col("text"), F.lit("nan")))), 256)
    texts = df.groupBy(key.alias("k")).agg(
        F.count("*").alias("c"), F.min(label).alias("lo"), F.max(label).alias("hi")
    ).agg(
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_texts"),
        F.count_if((F.col("c") > 1) & (F.col("lo") != F.col("hi"))).alias("conflicting_labels"),
    )
    classes = df.filter(present).groupBy(label).agg(F.count("*").alias("c"))
    known = F.count_if(F.col(label).isin(*intent.TAXONOMY))
    shape = classes.agg(
        (F.lit(len(intent.TAXONOMY)) - known).alias("empty_classes"),
        F.try_divide(F.max("c"), F.greatest(F.min("c"), F.lit(1))).alias("class_imbalance_ratio"),
    )
    out = side_by_side(rows, ids, groups, texts, shape)
    bad = ["missing_text", "missing_labels", "unknown_labels", "duplicate_ids", "conflicting_labels"]
    valid = F.lit(True)
    for name in bad:
        valid = valid & (F.col(name) == 0)
    return out.withColumn("valid", valid)


def missing_classes(df: DataFrame, label: str, taxonomy: Sequence[str] = intent.TAXONOMY) -> DataFrame:
    """Taxonomy classes without a single row."""
    spine = df.sparkSession.createDataFrame([(c,) for c in taxonomy], f"{label} string")
    return spine.join(df.select(label).distinct(), label, "left_anti")


def group_table(df: DataFrame, group: str = "parent_id", label: str = "corrected_label") -> DataFrame:
    """Rows, actionable share, classes and source per discussion group."""
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("rows"),
        F.avg(intent.is_actionable(F.col(label)).cast("double")).alias("actionable_share"),
        F.count_distinct(label).alias("classes"),
        F.min("source").alias("source"),
    )


def group_concentration(groups: DataFrame, total_rows: int | None = None, top: int = TOP_GROUPS) -> DataFrame:
    """Share of the largest groups and number of single-row groups."""
    largest = groups.orderBy(F.desc("rows")).limit(top).agg(F.sum("rows").alias("_top"))
    whole = groups.agg(F.sum("rows").alias("_all"), F.count_if(F.col("rows") == 1).alias("single_row_groups"))
    total = F.lit(total_rows) if total_rows is not None else F.col("_all")
    return side_by_side(largest, whole).select(F.try_divide("_top", total).alias("top3_group_share"), "single_row_groups")


def rule_agreement(df: DataFrame, by: str, rule: str, label: str) -> DataFrame:
    """Share of rows on which the rules agree with the final label, per sampling strategy."""
    same = F.coalesce(F.col(rule) == F.col(label), F.lit(False)).cast("double")
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.avg(same).alias("agreement"))


def first_two_annotations(df: DataFrame, item: str, annotator: str, label: str) -> DataFrame:
    """The labels of the first two annotators (by name) of every item with at least two."""
    pair = F.slice(F.sort_array(F.collect_set(F.struct(F.col(annotator).alias("who"), F.col(label).alias("label")))), 1, 2)
    # A set of one label per annotator and item; bounded by the number of annotators.
    once = df.groupBy(item, annotator).agg(F.min(label).alias(label))
    return (
        once.groupBy(item).agg(pair.alias("_pair")).filter(F.size("_pair") >= 2)
        .select(item, F.get("_pair", F.lit(0)).getField("label").alias("label_a"), F.get("_pair", F.lit(1)).getField("label").alias("label_b"))
    )


def batch_checks(
    completed: DataFrame, provenance: DataFrame, labelled_texts: DataFrame, taxonomy: Sequence[str] = intent.TAXONOMY
) -> DataFrame:
    """Labelled rows of a finished batch with their problems and their provenance.

    ``labelled_texts (text)`` is the corpus. Repeats of (queue id, annotator) reject every copy; they are
    counted before the shuffle and matched back on the key.
    """
    names = ["human_label", "annotator_id", "secondary_label"]
    clean = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in completed.columns else F.lit("") for c in names}
    rows = completed.withColumns(clean).withColumn("text_key", text.text_key(F.col("text")))
    rows = rows.filter(F.col("human_label") != "")
    repeated = rows.groupBy("queue_id", "annotator_id").agg((F.count("*") > 1).alias("duplicate_queue_id_per_annotator"))
    known = provenance.drop("stratum").withColumn("_known", F.lit(True))
    seen = labelled_texts.select(text.text_key(F.col("text")).alias("text_key")).distinct().withColumn("_seen", F.lit(True))
    joined = (
        rows.join(repeated, ["queue_id", "annotator_id"])
        .join(known, "queue_id", "left")
        .join(seen, "text_key", "left")
    )
    secondary = F.col("secondary_label")
    flags = {
        "missing_annotator_id": F.col("annotator_id") == "",
        "label_not_in_taxonomy": ~F.col("human_label").isin(*taxonomy),
        "secondary_not_in_taxonomy": (secondary != "") & ~secondary.isin(*taxonomy),
        "unknown_queue_id": F.col("_known").isNull(),
        "already_in_corpus": F.col("_seen").isNotNull(),
    }
    rejected = F.col("duplicate_queue_id_per_annotator")
    for flag in flags:
        rejected = rejected | F.col(flag)
    return joined.withColumns(flags).withColumn("rejected", rejected).drop("_known", "_seen", "text_key")


BATCH_PROBLEMS = (
    "missing_annotator_id", "label_not_in_taxonomy", "secondary_not_in_taxonomy", "unknown_queue_id",
    "already_in_corpus", "duplicate_queue_id_per_annotator",
)


def batch_summary(completed: DataFrame, checked: DataFrame) -> DataFrame:
    """Rows received, accepted, unlabelled and affected by each problem."""
    received = completed.agg(
        F.count("*").alias("rows_received"),
        F.count_if(text.is_blank(F.col("human_label"))).alias("unlabelled_rows"),
    )
    problems = checked.agg(
        F.count_if(~F.col("rejected")).alias("rows_accepted"), *[F.count_if(F.col(n)).alias(n) for n in BATCH_PROBLEMS]
    )
    return side_by_side(received, problems)


def accepted_counts(checked: DataFrame) -> DataFrame:
    return checked.filter(~F.col("rejected")).groupBy(F.col("human_label").alias("label")).agg(F.count("*").alias("n"))


def align_predictions(predictions: DataFrame, rules: DataFrame, key: str = "record_id") -> DataFrame:
    """Predictions with the rule label of the same record."""
    return predictions.join(rules, key)


def rule_model_summary(df: DataFrame, true: str, model: str, rule: str) -> DataFrame:
    """Agreement of rule and model and who is right where."""
    agree = F.col(model) == F.col(rule)
    rule_ok, model_ok = F.col(rule) == F.col(true), F.col(model) == F.col(true)
    return df.agg(
        F.count("*").alias("rows"),
        F.avg(agree.cast("double")).alias("agreement_rate"),
        F.avg((~agree).cast("double")).alias("disagreement_rate"),
        F.count_if(rule_ok & model_ok).alias("both_correct"),
        F.count_if(~rule_ok & ~model_ok).alias("both_wrong"),
        F.count_if(rule_ok & ~model_ok).alias("rule_correct_model_wrong"),
        F.count_if(~rule_ok & model_ok).alias("model_correct_rule_wrong"),
    )


def disagreements_by_class(df: DataFrame, true: str, model: str, rule: str) -> DataFrame:
    return df.filter(F.col(model) != F.col(rule)).groupBy(true).agg(F.count("*").alias("n"))


def reviewed_rows(df: DataFrame) -> DataFrame:
    manual = F.trim(F.coalesce(F.col("manual_label"), F.lit("")))
    return df.withColumn("manual_label", manual).filter(F.col("manual_label") != "")


def audit_summary(df: DataFrame, kinds: Sequence[str] = ("recall", "precision")) -> DataFrame:
    """Reviewed rows and misclassification per sample type, empty types included."""
    spine = df.sparkSession.createDataFrame([(k,) for k in kinds], "sample_type string")
    wrong = F.count_if(F.col("manual_label") != F.coalesce("intent_label", F.lit("")))
    counts = reviewed_rows(df).groupBy("sample_type").agg(
        F.count("*").alias("total_reviewed_rows"), wrong.alias("misclassification_count")
    )
    filled = F.broadcast(spine).join(counts, "sample_type", "left").fillna(0)
    rate = F.coalesce(F.try_divide("misclassification_count", "total_reviewed_rows"), F.lit(0.0))
    return filled.withColumn("misclassification_rate", rate)


def audit_precision(df: DataFrame) -> DataFrame:
    """Precision per predicted label on the precision sample."""
    picked = reviewed_rows(df).filter((F.col("sample_type") == "precision") & F.col("intent_label").isNotNull())
    right = F.count_if(F.col("manual_label") == F.col("intent_label"))
    return picked.groupBy("intent_label").agg(
        F.count("*").alias("total_predictions"), right.alias("correct_predictions"),
        (right / F.count("*")).alias("precision"),
    )


def best_model(df: DataFrame, model: str, metric: str) -> DataFrame:
    """Model with the highest mean metric over its seeds, ties to the first name."""
    means = df.groupBy(F.col(model).alias("model")).agg(F.avg(metric).alias("mean_metric"))
    return means.orderBy(F.desc_nulls_last("mean_metric"), "model").limit(1)


def usable_labels(df: DataFrame, label: str) -> DataFrame:
    """Rows with a label and a text."""
    return df.filter(F.col(label).isNotNull() & ~text.is_blank(F.col("text")))


def labelled_corpus(raw: DataFrame, version: str = "audit_v1_2025") -> DataFrame:
    """Canonical labelled corpus: names, defaults, group id and actionable flag.

    Missing metadata stays null. Group ids are taken as given when the table has any, else from permalinks.
    """
    columns = raw.columns

    def optional(name: str, default: Column | None = None) -> Column:
        if name in columns:
            return F.col(name)
        return F.lit(None).cast("string") if default is None else default

    source = optional("source")
    given = "parent_id" in columns and raw.filter(F.col("parent_id").isNotNull()).limit(1).count() > 0
    if given:
        group, origin = F.col("parent_id"), F.lit("provided")
    else:
        group = text.group_from_permalink(optional("permalink"), source)
        origin = F.when(group.isNotNull(), "permalink_derived").otherwise("missing")
    label = optional("corrected_label")
    return raw.select(
        optional("id").cast("string").alias("record_id"),
        optional("text").alias("text"),
        label.alias("corrected_label"),
        intent.is_actionable(label).alias("actionable"),
        source.alias("source"),
        group.alias("parent_id"),
        origin.alias("group_id_source"),
        optional("created_at").alias("created_at"),
        optional("annotator_id", F.lit("annotator_1")).alias("annotator_id"),
        F.lit(version).alias("annotation_version"),
        optional("sample_type").alias("sample_strategy"),
        optional("intent_label").alias("original_rule_label"),
        optional("secondary_label").alias("secondary_label"),
        optional("multi_intent_flag").alias("multi_intent_flag"),
    )
