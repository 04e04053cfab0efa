"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is trained on one half of all rows that are labelled good. A document's perplexity is compared with a threshold of its
language, a quantile of the perplexities of the other half in that language, which did not train the model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm import gramtable, kneser
from pulseframe.llm.words import text_rows
from pulseframe.session import materialise

ORDER = 2
#: The threshold of a language: this share of its trusted rows lies at or below it.
KEPT_SHARE = 0.995
#: Trusted rows that a language needs for a threshold of its own; others take that of all languages.
LEAST_ROWS = 20
#: Bins of one unit of log10 perplexity in which quantiles are first looked for.
BINS = 256


def quantiles(values: DataFrame, wanted: list[float]) -> DataFrame:
    """(lang, n, q0, q1, ...) of ``values(lang, v, k)``, k rows of value v: for each language the least value at or below which
    the wanted shares of its rows lie. Exact; only the counts of bins and the values of the bins found are sorted."""
    binned = values.withColumn("bin", F.floor(F.col("v") * BINS))
    order = Window.partitionBy("lang").orderBy("bin")
    bins = binned.groupBy("lang", "bin").agg(F.sum("k").alias("k"))
    bins = bins.withColumns({"upto": F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(Window.partitionBy("lang"))})
    rank = F.greatest(F.ceil(F.col("n") * F.col("share") - 1e-9), F.lit(1))
    ranks = bins.select("*", F.posexplode(F.array(*[F.lit(q) for q in wanted])).alias("i", "share")).withColumn("rank", rank)
    ranks = ranks.where("upto >= rank and upto - k < rank").select(F.col("lang").alias("l"), F.col("bin").alias("b"), "n", "i", (F.col("rank") - F.col("upto") + F.col("k")).alias("rank"))
    found = binned.join(ranks, F.col("lang").eqNullSafe(F.col("l")) & (F.col("bin") == F.col("b")))
    inner = Window.partitionBy("lang", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("upto", F.sum("k").over(inner)).where("upto >= rank").groupBy("lang", "i").agg(F.min("v").alias("v"), F.first("n").alias("n"))
    return found.groupBy("lang").agg(F.first("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"q{i}") for i in range(len(wanted))])


def quality(docs: DataFrame, labels: DataFrame, trusted_rows: int | None = None, order: int = ORDER) -> DataFrame:
    """(doc_id, tag, lang, n_tokens, log10_perplexity, threshold, kept) for every row of ``docs(doc_id, lang, text)``.

    Trusted are rows whose label ``quality`` is 1; about half of them, chosen by a hash of the id, train the model, and all others
    set the thresholds; every document is scored. With ``trusted_rows`` at most so many, about, train the model. A doc_id with
    several labels counts with the least. Texts without words (null, empty) have only their end token and are kept, there is
    nothing to judge. A null language is a language. Without trusted rows there is no threshold and all rows are kept. ``tag``
    tells apart rows that repeat a doc_id.
    """
    good = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"))
    # Written, so that its size is known when it is joined: only a small one is sent to all tasks.
    good = materialise(good.where("q = 1").select("doc_id"), "good")
    half = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(2))
    chosen = good if trusted_rows is None else materialise(kneser.bounded_rows(good, 2 * trusted_rows), "chosen")
    training = chosen.where(half == 0)
    tag = F.hash(F.coalesce(docs["text"], F.lit("")))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), tag.alias("tag"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"))
    rows = text_rows(rows, "doc_id", "tag", "lang", "text")
    # Written: the texts meet the labels once, and are read twice.
    learn = materialise(rows.where(half == 0).join(training, "doc_id", "left_semi").select("text"), "learn")
    model = gramtable.train(learn, order)
    scored = materialise(gramtable.perplexities(rows, model), "perplexities")
    # All trusted rows that the model has not seen: ids and numbers, combined to one row per value before they are ordered.
    trusted = good.join(training, "doc_id", "left_anti") if trusted_rows is not None else good.where(half == 1)
    told = scored.where("n_tokens > 1").join(trusted, "doc_id").groupBy("lang", F.col("log10_perplexity").alias("v")).agg(F.count("*").alias("k"))
    told = materialise(told, "trusted")
    by_lang = quantiles(told, [KEPT_SHARE]).where(F.col("n") >= LEAST_ROWS).select(F.col("lang").alias("l"), F.col("q0").alias("cut"))
    every = quantiles(told.withColumn("lang", F.lit("")), [KEPT_SHARE]).first()
    overall = every["q0"] if every else None
    joined = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["l"]), "left")
    threshold = F.coalesce("cut", F.lit(overall).cast("double"))
    kept = F.coalesce((F.col("log10_perplexity") <= threshold) | (F.col("n_tokens") <= 1), F.lit(True))
    return joined.select("doc_id", "tag", "lang", "n_tokens", "log10_perplexity", threshold.alias("threshold"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns. Rows without doc_id stay."""
    bad = quality(docs, labels, **options).where("not kept").select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).distinct()
    return docs.join(bad, (docs["doc_id"] == bad["__id"]) & (F.hash(F.coalesce(docs["text"], F.lit(""))) == bad["__tag"]), "left_anti")
