"""Text classifiers: features, two-stage training, calibration, out-of-fold scoring."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.util import inheritable_thread_target

from pulseframe.functions import intent, text
from pulseframe.operators import agreement, evaluation, probabilities, splits, termtable, vectors
from pulseframe.plans import linear
from pulseframe.session import by_key, materialise, side_by_side, work_path

# --- fixed values -------------------------------------------------------------
MODELS = ("majority", "rules", "logistic", "linear_svm", "char_word_svm")
PROBABILITY, MARGIN, INDICATOR = "probability", "decision_score", "rule_indicator"
SCORE_TYPES = {"majority": PROBABILITY, "rules": INDICATOR, "logistic": PROBABILITY, "linear_svm": MARGIN, "char_word_svm": MARGIN}
BLOCKS = {"logistic": ("word",), "linear_svm": ("word",), "char_word_svm": ("word", "char")}
C = 1.0
MAX_ITERATIONS = 100
#: Folds trained at the same time.
FOLD_WORKERS = 5


def _lists(blocks: Sequence[str], text_col: str) -> dict[str, Column]:
    made = {"word": vectors.word_terms(F.col(text_col), 2), "char": vectors.char_grams(F.col(text_col))}
    return {b: made[b] for b in blocks}


def _terms(df: DataFrame, blocks: Sequence[str], text_col: str) -> DataFrame:
    made = _lists(blocks, text_col)
    parts = F.array(*[F.struct(F.lit(i).alias("block"), made[b].alias("terms")) for i, b in enumerate(blocks)])
    long = by_key(df.select("doc", text_col), "doc").select("doc", F.inline(parts)).select("doc", "block", F.explode("terms").alias("term"))
    return long.groupBy("doc", "block", "term").agg(F.count("*").alias("tf"))


def _as_vectors(df: DataFrame, name: str) -> DataFrame:
    """Give the struct column ``features`` the vector type: same layout on disk, read back as vectors."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    fields = [StructField(f.name, VectorUDT() if f.name == "features" else f.dataType, True) for f in df.schema.fields]
    return df.sparkSession.read.schema(StructType(fields)).parquet(path)


def _numbered(terms: DataFrame) -> DataFrame:
    """Dense numbers for the rows of a written table with an increasing ``_id``: place in the partition behind those before."""
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = terms.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("_n"))
    # One row per partition.
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return terms.withColumn("_part", part).join(starts, "_part").select("block", "term", "df", (F.col("_start") + place).alias("number"))


@dataclass
class TextFeatures:
    """Sublinear TF-IDF blocks (words 1-2, characters 3-5), each block with length 1."""

    blocks: Sequence[str] = ("word",)
    frequency: DataFrame | None = None
    n: int = 0
    size: int = 0

    def fit(self, df: DataFrame, text_col: str = "text") -> TextFeatures:
        self.frequency, self.size, self.n = termtable.vocabulary(df, "doc", text_col, _lists(self.blocks, text_col))
        return self

    def transform(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``df`` with a sparse ``features`` vector; ``doc`` is its unique key. Unknown terms are dropped."""
        joined = termtable.features(df, "doc", text_col, _lists(self.blocks, text_col), self.frequency, self.n)
        vector = F.struct(
            F.lit(0).cast("tinyint").alias("type"), F.lit(max(self.size, 1)).alias("size"), F.col("_i").alias("indices"), F.col("_w").alias("values"),
        )
        numbered = joined.withColumns({"features": vector, "_row": F.monotonically_increasing_id()})
        return _as_vectors(numbered.drop("_i", "_w"), "features")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight of each class so that all classes count the same."""
    classes = df.groupBy(label).agg(F.count("*").alias("_c"))
    shape = {r[0]: r["_c"] for r in classes.collect()}  # one row per class
    total, k = sum(shape.values()), max(len(shape), 1)
    weight = F.lit(1.0)
    for value, count in shape.items():
        weight = F.when(F.col(label) == value, total / (k * count)).otherwise(weight)
    return df.withColumn("_weight", weight)


def _logistic(n: int) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features", weightCol="_weight", regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0,
        standardization=False, maxIter=MAX_ITERATIONS,
    )


@dataclass
class BinaryStage:
    """Actionable score, optional calibration and threshold."""

    name: str
    model: object = None
    calibrator: object = None
    isotonic: bool = False
    threshold: float = 0.5
    constant: float | None = None
    notes: list[str] = field(default_factory=list)

    def fit(self, train: DataFrame, label: str = "actionable") -> BinaryStage:
        rows = train.withColumn("label", F.col(label).cast("double"))
        if self.name == "majority":
            self.constant = rows.agg(F.avg("label")).first()[0]
        elif self.name != "rules":
            weighted = balanced_weights(rows, "label")
            self.model = (linear.fit_logistic if self.name == "logistic" else linear.fit_svm)(weighted, C, MAX_ITERATIONS)
        return self

    def raw_scores(self, df: DataFrame) -> DataFrame:
        if self.name == "majority":
            return df.withColumn("raw_score", F.lit(float(self.constant or 0.0)))
        if self.name == "rules":
            hit = intent.intent_label(F.col("text")) != intent.GENERAL
            return df.withColumn("raw_score", hit.cast("double"))
        made = self.model.margins(df, "_margins")
        margin = F.col("_margins")[0]
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)) if self.name == "logistic" else margin
        return made.withColumn("raw_score", score).drop("_margins")

    def calibrate(self, validation: DataFrame, label: str = "actionable", method: str = "sigmoid") -> BinaryStage:
        """Fit on validation rows only; both classes are needed."""
        if method not in ("sigmoid", "isotonic"):
            raise ValueError(f"Unknown calibration method: {method!r}")
        scored = self.raw_scores(validation).select(F.col("raw_score"), F.col(label).cast("double").alias("label"))
        if scored.select("label").distinct().count() < 2:
            self.notes.append("calibration skipped: one class only")
            return self
        if method == "sigmoid":
            rows = scored.select(array_to_vector(F.array("raw_score")).alias("features"), "label")
            self.calibrator = LogisticRegression(regParam=1e-6, standardization=False, maxIter=1000).fit(rows)
        else:
            self.isotonic = True
            # Rows of one score count as their mean with their number as weight, which gives the same fit from fewer rows.
            by_score = scored.groupBy("raw_score").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
            self.calibrator = IsotonicRegression(featuresCol="raw_score", labelCol="label", weightCol="weight").fit(by_score)
        return self

    def scores(self, df: DataFrame) -> DataFrame:
        """``score``: calibrated probability where a calibrator exists, else the raw score."""
        made = self.raw_scores(df)
        if self.calibrator is None:
            return made.withColumn("score", F.col("raw_score"))
        if self.isotonic:
            out = self.calibrator.transform(made)
            return out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction")
        # One feature: the calibrated value is a formula of the raw score.
        slope, shift = float(self.calibrator.coefficients[0]), float(self.calibrator.intercept)
        return made.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(slope) * F.col("raw_score") + F.lit(shift)))))

    def choose_threshold(self, validation: DataFrame, label: str = "actionable", objective: str = "f1", **limits) -> BinaryStage:
        best = evaluation.select_threshold(self.scores(validation), label, "score", objective, **limits).first()
        self.threshold = float(best["selected_threshold"])
        return self

    @property
    def yields_probabilities(self) -> bool:
        return self.calibrator is not None or SCORE_TYPES[self.name] == PROBABILITY


def train_stage1(name: str, rows: DataFrame, label: str = "actionable", method: str = "sigmoid") -> BinaryStage:
    """Fit on train, calibrate margins and choose the threshold on validation. ``rows`` carries ``split``."""
    y = F.col(label).cast("int")
    rows = rows.withColumn(label, y)
    train, validation = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    stage = BinaryStage(name).fit(train, label)
    if SCORE_TYPES[name] != PROBABILITY or method == "isotonic":
        stage.calibrate(validation, label, method)
    return stage.choose_threshold(validation, label)


@dataclass
class ClassStage:
    """Stage 2: label of the actionable rows."""

    name: str
    model: object = None
    indexer: object = None
    single: str | None = None

    def fit(self, rows: DataFrame, label: str = "corrected_label") -> ClassStage:
        classes = sorted(r[0] for r in rows.select(label).distinct().collect())  # at most the taxonomy
        if not classes:
            raise ValueError("No actionable training rows for stage 2")
        if self.name == "majority" or len(classes) == 1:
            counts = rows.groupBy(label).agg(F.count("*").alias("n"))
            self.single = counts.orderBy(F.desc("n"), label).first()[0]
            return self
        if self.name == "rules":
            return self
        self.indexer = StringIndexer(inputCol=label, outputCol="label", handleInvalid="skip").fit(rows)
        weighted = balanced_weights(self.indexer.transform(rows), "label")
        k = len(self.indexer.labels)
        if self.name == "logistic":
            self.model = linear.fit_logistic(weighted, C, MAX_ITERATIONS, k)
        else:
            self.model = linear.fit_svm(weighted, C, MAX_ITERATIONS, rest=k)
        return self

    def label_of(self, margins: Column) -> Column:
        """Label of the largest margin, the first of equal ones; a single margin is that of the second label."""
        single = len(self.model.shifts) == 1
        place = (F.get(margins, F.lit(0)) > 0).cast("int") if single else (F.array_position(margins, F.array_max(margins)) - 1).cast("int")
        return F.get(F.array(*[F.lit(x) for x in self.indexer.labels]), place)

    def predict(self, df: DataFrame, output: str = "stage2_label") -> DataFrame:
        if self.single is not None:
            return df.withColumn(output, F.lit(self.single))
        if self.name == "rules":
            return df.withColumn(output, intent.intent_label(F.col("text")))
        return self.model.margins(df, "_margins").withColumn(output, self.label_of(F.col("_margins"))).drop("_margins")


@dataclass
class TwoStage:
    """Stage 1 score above the threshold, then the stage 2 label, else general discussion."""

    stage1: BinaryStage
    stage2: ClassStage

    @property
    def name(self) -> str:
        return f"hier[{self.stage1.name}+{self.stage2.name}]"

    def transform(self, df: DataFrame) -> DataFrame:
        made = self.stage2.predict(self.stage1.scores(df))
        picked = F.col("score") > F.lit(self.stage1.threshold)
        value = F.col("score")
        own = self.stage1.yields_probabilities
        return made.withColumns(
            {
                "is_actionable": picked,
                "intent_label": F.when(picked, F.col("stage2_label")).otherwise(intent.GENERAL),
                "actionable_probability": value if own else F.lit(None).cast("double"),
                "actionable_score_uncalibrated": F.lit(None).cast("double") if own else value,
                "model_name": F.lit(self.name),
            }
        ).drop("stage2_label", "raw_score", "score")


def train_two_stage(name: str, rows: DataFrame, method: str = "sigmoid", label: str = "corrected_label") -> TwoStage:
    stage1 = train_stage1(name, rows, "actionable", method)
    actionable = rows.filter((F.col("split") == "train") & (F.col("actionable").cast("int") == 1))
    return TwoStage(stage1, ClassStage(name).fit(actionable, label))


def with_features(df: DataFrame, name: str) -> DataFrame:
    """Features of a model family, fitted on the training rows only when ``split`` exists."""
    if name not in BLOCKS:
        return df
    fitted = TextFeatures(BLOCKS[name]).fit(df.filter("split = 'train'") if "split" in df.columns else df)
    return fitted.transform(df)


def prediction_record(df: DataFrame, label: Column, score: Column, score_type: str) -> DataFrame:
    """One shape for every model; an indicator is never called a probability."""
    return df.withColumn("prediction_record", F.struct(label.alias("label"), score.alias("score"), F.lit(score_type).alias("score_type")))


def majority_baseline(train: DataFrame, df: DataFrame, label: str) -> DataFrame:
    """Most frequent class for every row, with the class priors as scores."""
    counts = train.groupBy(label).agg(F.count("*").alias("n"))
    best = counts.agg(F.max_by(label, F.struct(F.col("n"), F.col(label)))).scalar()
    # One entry per class.
    priors = counts.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col("n"))))).scalar()
    total = counts.agg(F.sum("n")).scalar()
    rows = df.withColumns({"predicted_label": best, "_priors": priors, "_total": total})
    scores = F.transform("_priors", lambda c: F.struct(c.getField("label").alias("label"), (c.getField("n") / F.col("_total")).alias("score")))
    return rows.withColumn("scores", scores).drop("_priors", "_total")


def rule_baseline(df: DataFrame, binary: bool = False) -> DataFrame:
    """Rule label, or whether it is actionable, with the rule indicator as score."""
    label = intent.intent_label(F.col("text"))
    out = df.withColumn("rule_label", label).withColumn("score", intent.intent_confidence(F.col("rule_label")))
    if binary:
        return out.withColumn("predicted_label", F.when(F.col("rule_label") == intent.GENERAL, intent.GENERAL).otherwise("actionable"))
    return out.withColumn("predicted_label", F.col("rule_label"))


def out_of_fold(corpus: DataFrame, name: str = "logistic", folds: int = 5, seed: int = 42) -> DataFrame:
    """Probability of every labelled row from a model that saw none of its group.

    ``corpus`` carries record_id, text, corrected_label, actionable, parent_id. Each fold trains once; the result
    keeps id and text so that both keys can be matched.
    """
    usable = agreement.usable_labels(corpus, "corrected_label")
    rows = splits.effective_groups(usable).withColumn("doc", F.col("record_id"))
    rows = materialise(rows.join(splits.group_folds(rows, folds, seed), "group_key"), "folds")
    present = sorted(r[0] for r in rows.select("fold").distinct().collect())  # at most the number of folds

    def one(fold: int) -> DataFrame | None:
        placed = splits.fold_split(rows, fold, seed)
        if placed.filter("split = 'train'").select("corrected_label").distinct().count() < 2:
            return None
        featured = with_features(placed, name)
        stage = train_stage1(name, featured)
        if not stage.yields_probabilities:
            return None
        return stage.scores(featured.filter("split = 'held_out'")).select(
            "record_id", "text", "group_key", F.lit(fold).alias("fold"), F.col("score").alias("oof_probability"),
            (F.col("score") > F.lit(stage.threshold)).cast("int").alias("pred_actionable"),
        )

    out = None
    with ThreadPoolExecutor(FOLD_WORKERS) as pool:  # the rounds of one training seldom fill a cluster
        tasks = [pool.submit(inheritable_thread_target(rows.sparkSession)(one), fold) for fold in present]
        for scored in (task.result() for task in tasks):
            if scored is not None:
                out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("no fold could be scored")
    return materialise(out, "oof")


def build_probabilities(signals: DataFrame, corpus: DataFrame, name: str = "logistic", folds: int = 5, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Out-of-fold values for the corpus, the model for everything else, with provenance."""
    oof = out_of_fold(corpus, name, folds, seed).select("record_id", "oof_probability")
    training = corpus.select("record_id", "text").join(oof, "record_id", "left")
    split = splits.group_split(corpus, seed).withColumn("doc", F.col("record_id"))
    features = TextFeatures(BLOCKS.get(name, ("word",))).fit(split.filter("split = 'train'"))
    stage = train_stage1(name, features.transform(split))
    scored = stage.scores(features.transform(signals.withColumn("doc", F.col(id_col).cast("string")))).withColumn("_model", F.col("score"))
    made = probabilities.attach_probabilities(scored, training, F.col("_model") if stage.yields_probabilities else None, id_col)
    return made.drop("_model", "score", "raw_score", "features", "doc", "_row")


def rule_scores(df: DataFrame) -> DataFrame:
    """Rule labels in the columns of a scored batch, for when no model is there."""
    label = intent.intent_label(F.col("text"))
    return df.withColumns(
        {
            "intent_label": label, "is_actionable": label != intent.GENERAL,
            "actionable_probability": F.lit(None).cast("double"), "model_name": F.lit("rules"),
        }
    )


def benchmark(corpus: DataFrame, models: Sequence[str] = MODELS, seeds: Sequence[int] = (42,)) -> DataFrame:
    """One row of stage 1 and end-to-end test metrics per (model, seed)."""
    out = None
    for seed in seeds:
        split = materialise(splits.group_split(corpus, seed).withColumn("doc", F.col("record_id")), "split")
        for name in models:
            rows = with_features(split, name)
            model = train_two_stage(name, rows)
            scored = materialise(_test_rows(model, rows.filter("split = 'test'")), "predictions")
            row = _metric_row(scored).withColumns({"model": F.lit(name), "seed": F.lit(seed)})
            out = row if out is None else out.unionByName(row)
    return out


def _test_rows(model: TwoStage, test: DataFrame) -> DataFrame:
    score = F.coalesce("actionable_probability", "actionable_score_uncalibrated")
    return model.transform(test).select(
        "record_id", "parent_id", "corrected_label", "intent_label", F.col("actionable").cast("int").alias("y"),
        F.col("is_actionable").cast("int").alias("pred"), score.alias("p"),
    )


def _metric_row(scored: DataFrame) -> DataFrame:
    stage1 = evaluation.binary_metrics(scored, "y", "pred", "p").select("accuracy", "precision", "recall", "f1", "pr_auc", "roc_auc", "brier_score")
    pairs = agreement.label_pairs(scored, "corrected_label", "intent_label")
    end_to_end = agreement.multiclass_summary(pairs).select(F.col("macro_f1_observed").alias("e2e_macro_f1"), F.col("accuracy").alias("e2e_accuracy"))
    return side_by_side(stage1, end_to_end)


def group_cv(corpus: DataFrame, models: Sequence[str] = ("logistic",), seeds: Sequence[int] = (42,), folds: int = 5) -> DataFrame:
    """Stage 1 metrics of out-of-fold predictions per (model, seed)."""
    out = None
    for name in models:
        for seed in seeds:
            oof = out_of_fold(corpus, name, folds, seed).select("record_id", "oof_probability", "pred_actionable")
            joined = corpus.join(oof, "record_id").withColumn("y", F.col("actionable").cast("int"))
            row = evaluation.binary_metrics(joined, "y", "pred_actionable", "oof_probability").withColumns({"model": F.lit(name), "seed": F.lit(seed)})
            out = row if out is None else out.unionByName(row)
    return out


def embedding_head(df: DataFrame, embedding: str, label: str) -> LogisticRegressionModel:
    """Logistic head over precomputed embeddings."""
    rows = df.select(array_to_vector(F.col(embedding).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    weighted = balanced_weights(rows, "label")
    return _logistic(weighted.count()).fit(weighted)
