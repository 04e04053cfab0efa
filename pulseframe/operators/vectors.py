"""TF-IDF in long form, near-duplicate joins and slice drift."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.functions import text as tx
from pulseframe.operators import termtable
from pulseframe.operators.termtable import packed, unpacked
from pulseframe.session import by_key, materialise, side_by_side, spread

# --- fixed values -------------------------------------------------------------
NEAR_DUPLICATE = 0.80
GRAM_SIZES = (3, 5)
VOCABULARY_TOP = 200
MIN_SLICE_ROWS = 30
WORD = r"(?U)\b\w\w+\b"

#: Slices a hot term is spread over when the term table is too large to broadcast.
TERM_SALTS = 8
#: Texts whose postings one task holds while others pass.
POSTINGS_PER_BLOCK = 4000
#: Norm of the frequent grams left out of the candidate join, as a share of the threshold.
REST_SHARE = 0.95
#: Document frequencies at which a text notes the norm of its more frequent grams.
LEVELS = np.unique(np.concatenate([[0], np.floor(2 ** (np.arange(0, 124) / 4))])).astype(np.int64)


def _windows(items: Column, size: Column, n: int, take) -> Column:
    """All windows of ``n`` items, given ``take(items, start, n)``; none when there are fewer."""
    starts = F.sequence(F.lit(1), size - n + 1)
    return F.when(size >= n, F.transform(starts, lambda i: take(items, i, n))).otherwise(F.array().cast("array<string>"))


def word_terms(body: Column, ngrams: int = 1) -> Column:
    """Words of two or more characters in lower case, and their n-grams up to ``ngrams``."""
    words = F.regexp_extract_all(F.lower(F.coalesce(body, F.lit(""))), F.lit(WORD), 0)
    join = lambda items, i, n: F.array_join(F.slice(items, i, n), " ")
    if ngrams == 1:
        return words
    # The words are bound once as a lambda argument; inside the windows they would be extracted again per step.
    return F.flatten(
        F.transform(F.array(words), lambda w: F.concat(w, *[_windows(w, F.size(w), n, join) for n in range(2, ngrams + 1)]))
    )


def char_grams(body: Column, low: int = GRAM_SIZES[0], high: int = GRAM_SIZES[1]) -> Column:
    """Character n-grams inside space-padded words; a word no longer than n counts once.

    A padded word has at least three characters, so with ``low`` of 3 a short word yields itself at n = its length.
    """
    padded = F.transform(
        F.filter(F.split(tx.collapse_spaces(tx.casefold(F.coalesce(body, F.lit("")))), " "), lambda w: w != ""),
        lambda w: F.concat(F.lit(" "), w, F.lit(" ")),
    )
    cut = lambda w, i, n: F.substring(w, i, F.lit(n))
    return F.flatten(
        F.transform(padded, lambda w: F.concat(*[_windows(w, F.length(w), n, cut) for n in range(low, high + 1)]))
    )


def term_counts(df: DataFrame, id_col: str, terms: Column) -> DataFrame:
    return by_key(df, id_col).select(F.col(id_col).alias("doc"), F.explode(terms).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def _join_terms(left: DataFrame, terms: DataFrame) -> DataFrame:
    """Join on the term, each term spread over salts."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(TERM_SALTS)).cast("int"))
    spread = terms.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1))))
    return salted.join(spread, ["term", "_salt"]).drop("_salt")


def tfidf(counts: DataFrame, n_docs: int, sublinear: bool = False, copies: str | None = None, numbered: bool = False) -> DataFrame:
    """L2-normalised weights with smooth idf ``ln((1+n)/(1+df))+1``, one row per (doc, term).

    ``copies`` names a column that says how many rows a document stands for. ``numbered`` replaces terms by
    numbers given once when the vocabulary is written, so that joins on them compare integers.
    """
    seen = F.sum(copies) if copies else F.count("*")
    frequency = counts.groupBy("term").agg(seen.alias("df"))
    if numbered:
        frequency = materialise(frequency.withColumn("_no", F.monotonically_increasing_id()), "vocabulary")
    tf = F.lit(1.0) + F.log(F.col("tf")) if sublinear else F.col("tf").cast("double")
    raw = tf * (F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0)
    joined = _join_terms(counts, frequency).withColumn("_raw", raw)
    if numbered:
        joined = joined.withColumn("term", F.col("_no")).drop("_no")
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy("doc")))
    return joined.withColumn("weight", F.col("_raw") / norm).drop("_raw")


def text_tfidf(df: DataFrame, id_col: str, terms: Column, n_docs: int, sublinear: bool = False) -> DataFrame:
    """``tfidf`` of the ``term_counts`` of ``df``, one row per (doc, term number), from texts that are dealt by document: no row per term is shuffled."""
    weighed = termtable.document_weights(df, id_col, "text", terms, sublinear, n_docs=n_docs)
    return weighed.select("doc", F.inline(F.arrays_zip(*termtable.WEIGHTS.names)))


_GRAMS = "top int, rest array<float>, term array<long>, weight array<double>, n int, terms binary, weights binary, rare binary"


def _ranked(rest_norm: float, carried: Sequence[str]):
    """The rarest terms of each document, up to the point where the others have at most ``rest_norm``, and all terms that others have, packed.

    A pair at the threshold must reach it with what both prefixes share and the product of the norms of what is more frequent than
    ``LEVELS[top]``, the highest level that both prefixes cover. No such pair is missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(c) for c in ("term", "df", "weight")}
            bounds = lists["term"].offsets.to_numpy()
            terms, dfs, weights = (lists[c].flatten().to_numpy() for c in ("term", "df", "weight"))
            bounds, copies, made = bounds - bounds[0], batch.column("copies").to_numpy(), []
            for d in range(batch.num_rows):
                own = slice(bounds[d], bounds[d + 1])
                order = np.lexsort((terms[own], dfs[own]))
                term, df, w = terms[own][order], dfs[own][order], weights[own][order]
                left = 1.0 - np.concatenate([[0.0], np.cumsum(w * w)])
                rare = int(np.count_nonzero(left[:-1] >= rest_norm * rest_norm - 1e-9))
                top = int(np.searchsorted(LEVELS, df[rare] - 1, "right")) - 1 if rare < len(df) else len(LEVELS) - 1
                rest = np.sqrt(np.maximum(left[np.searchsorted(df, LEVELS, "right")], 0.0)) + 1e-6
                shared = df > copies[d]  # a term that no other text has joins nothing
                few = shared[:rare]
                by = np.argsort(term[shared])
                first = (np.arange(len(df)) < rare)[shared][by]
                made.append((top, rest.astype(np.float32), term[:rare][few], w[:rare][few], int(shared.sum()), packed(np.diff(term[shared][by], prepend=0)),
                             packed(w[shared][by]), packed(first)))
            kinds = [pa.int32(), pa.list_(pa.float32()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            columns = list(zip(*made, strict=True)) or [[]] * len(kinds)
            names = ["doc", *carried]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                             [*names, *(c.split()[0] for c in _GRAMS.split(", "))])

    return run


def _rare(weights: DataFrame) -> DataFrame:
    """(doc, term, weight[, side]) of the rare terms that several texts have."""
    sides = [c for c in ("side",) if c in weights.columns]
    return weights.select("doc", *sides, F.inline(F.arrays_zip("term", "weight")))


def _possible(pairs: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, part) that may reach the threshold, by the norms of what is more frequent than both prefixes."""
    known = pairs.where(F.col("part") >= threshold * (1.0 - REST_SHARE) - 1e-6)
    for side in "ab":
        known = known.join(weights.select(F.col("doc").alias(side), F.col("top").alias(f"top_{side}"), F.col("rest").alias(f"rest_{side}")), side)
    level = F.least("top_a", "top_b")
    upper = F.col("part") + F.get("rest_a", level).cast("double") * F.get("rest_b", level).cast("double")
    return known.where(upper >= threshold - 1e-6).select("a", "b")


def _entries(r: dict, side: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Terms of a packed text in order, and their weights."""
    n = r[f"n{side}"]
    return np.cumsum(unpacked(r[f"terms{side}"], n, np.int64)), unpacked(r[f"weights{side}"], n, np.float64)


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for r in batch.drop_columns(["a", "b"]).to_pylist():
            (terms_a, weights_a), (terms_b, weights_b) = _entries(r, "_a"), _entries(r, "_b")
            _, x, y = np.intersect1d(terms_a, terms_b, True, True)
            sums.append(float(weights_a[x] @ weights_b[y]))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sums, pa.float64())], ["a", "b", "similarity"])


def cosines(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Exact cosine of the pairs (a, b); each pair meets the packed terms of its texts."""
    met = pairs.select("a", "b")
    for side in "ab":
        met = met.join(weights.select(F.col("doc").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "terms", "weights")]), side)
    met.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16000000")
    return met.mapInArrow(_dots, "a long, b long, similarity double")


class _Held:
    """Texts that a task holds: postings of their rare terms, and all their terms by place in a common vocabulary."""

    def __init__(self, rows: list[dict]):
        self.doc, self.component, self.top = (np.array([r[c] for r in rows], np.int64) for c in ("doc", "component", "top"))
        self.rest = np.array([r["rest"] for r in rows], np.float64).reshape(len(rows), -1)
        entries = [_entries(r) for r in rows]
        self.terms, place = np.unique(np.concatenate([np.zeros(0, np.int64), *(e[0] for e in entries)]), return_inverse=True)
        weight, ends = np.concatenate([np.zeros(0), *(e[1] for e in entries)]), np.cumsum([0, *(len(e[0]) for e in entries)])
        self.entries = [(place[a:b], weight[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        rare = np.concatenate([np.zeros(0, bool), *(unpacked(r["rare"], r["n"], bool) for r in rows)])
        owner, order = np.repeat(np.arange(len(rows)), np.diff(ends))[rare], np.argsort(place[rare], kind="stable")
        self.owner, self.weight = owner[order], weight[rare][order]
        self.starts = np.searchsorted(place[rare][order], np.arange(len(self.terms) + 1))
        self.dense = np.zeros(len(self.terms))

    def close(self, r: dict, same: bool, threshold: float) -> list[tuple[int, int, float]]:
        """(a, b, cosine) of the passing text with each held one of another component that reaches the threshold."""
        if (self.component == r["component"]).all():
            return []
        terms, weight = _entries(r)
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == terms[known]
        at, weight, rare = at[known], weight[known], unpacked(r["rare"], r["n"], bool)[known]
        first, counts = self.starts[at[rare]], self.starts[at[rare] + 1] - self.starts[at[rare]]
        posting = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        part = np.bincount(self.owner[posting], self.weight[posting] * np.repeat(weight[rare], counts), len(self.doc))
        level, rest = np.minimum(self.top, r["top"]), np.array(r["rest"], np.float64)
        likely = (part + self.rest[np.arange(len(self.doc)), level] * rest[level] >= threshold - 1e-6) & (self.component != r["component"])
        likely &= self.doc < r["doc"] if same else self.doc != r["doc"]
        self.dense[at] = weight
        found = [(i, float(self.dense[self.entries[i][0]] @ self.entries[i][1])) for i in np.flatnonzero(likely)]
        self.dense[at] = 0.0
        return [(int(self.doc[i]), r["doc"], x) for i, x in found if x >= threshold]


def _passing(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, given, held = None, [], None
        for batch in batches:
            found: list[tuple] = []
            for r in batch.to_pylist():
                if r["cell"] != cell:
                    cell, given, held = r["cell"], [], None
                if not r["passing"]:  # come first
                    given.append(r)
                    continue
                if held is None:
                    if not given:
                        continue
                    held, given = _Held(given), []
                found += held.close(r, r["same"], threshold)
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])

    return run


def close_pairs(held: DataFrame, passing: DataFrame | None, threshold: float) -> DataFrame:
    """(a, b, similarity) of the packed texts of ``held`` and ``passing`` whose cosine reaches the threshold; without ``passing`` each pair of ``held`` once, the lesser first.

    Texts of one ``component`` are not compared. Groups of ``POSTINGS_PER_BLOCK`` texts are held by tasks, all others pass them: what is shuffled are
    packed texts, once per group, never a row per common term. Rare terms rule out pairs, the others are compared exactly.
    """
    spark, alone, columns = held.sparkSession, passing is None, ["doc", "component", "top", "rest", "n", "terms", "weights", "rare"]
    held, cores = held.select(*columns), spark.sparkContext.defaultParallelism
    count = held.count()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16000000")
    if passing is None:
        # At least some 1.5 cells a core where texts are few: groups meet in pairs.
        groups = max(1, -(-count // POSTINGS_PER_BLOCK), min(int((3 * cores) ** 0.5), count // 100))
        of = F.pmod(F.xxhash64("doc"), F.lit(groups)).cast("int")
        cell = lambda low, high: low * F.lit(groups) + high
        every = F.sequence(F.lit(0), F.lit(groups - 1))
        dealt = held.withColumn("_g", of)
        stay = dealt.select(*columns, "_g", F.explode(F.filter(every, lambda g: g >= F.col("_g"))).alias("_o")).select(
            *columns, cell(F.col("_g"), F.col("_o")).alias("cell"), F.lit(False).alias("passing"), F.lit(False).alias("same"))
        go = dealt.select(*columns, "_g", F.explode(F.filter(every, lambda g: g <= F.col("_g"))).alias("_o")).select(
            *columns, cell(F.col("_o"), F.col("_g")).alias("cell"), F.lit(True).alias("passing"), (F.col("_o") == F.col("_g")).alias("same"))
        cells = groups * groups
    else:
        if passing.count() < count:  # the fewer texts are held
            return close_pairs(passing, held, threshold).select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")
        groups = max(1, -(-count // POSTINGS_PER_BLOCK))
        parts = max(1, -(-2 * cores // groups))
        stay = held.withColumn("_g", F.pmod(F.xxhash64("doc"), F.lit(groups)).cast("int")).select(
            *columns, F.explode(F.sequence(F.col("_g") * parts, F.col("_g") * parts + parts - 1)).alias("cell"), F.lit(False).alias("passing"), F.lit(False).alias("same"))
        part = F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int")
        go = passing.select(*columns, part.alias("_p")).select(
            *columns, F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * parts + F.col("_p"))).alias("cell"), F.lit(True).alias("passing"), F.lit(False).alias("same"))
        cells = groups * parts
    both = stay.unionByName(go).repartitionById(cells, F.col("cell").cast("int")).sortWithinPartitions("cell", "passing")
    found = both.mapInArrow(_passing(threshold), "a long, b long, similarity double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity") if alone else found


def _weights(texts: DataFrame, threshold: float) -> DataFrame:
    """Written gram weights of ``texts (no, text, copies[, side])``, one row per text with grams."""
    carried = [c for c in ("copies", "side") if c in texts.columns]
    n = texts.agg(F.sum("copies")).first()[0] or 0
    weighed = termtable.document_weights(texts, "no", "text", char_grams(F.col("text")), copies="copies", n_docs=n, carried=carried)
    kinds = ["doc long", *[f"{c} {texts.schema[c].dataType.simpleString()}" for c in carried]]
    return materialise(weighed.mapInArrow(_ranked(REST_SHARE * threshold, carried), ", ".join([*kinds, _GRAMS])), "grams")


def _numbered(texts: DataFrame) -> DataFrame:
    """Texts written once with a number per row, in at least one partition per core."""
    return spread(materialise(texts.withColumn("no", F.monotonically_increasing_id()), "texts"))


def distinct_texts(df: DataFrame, id_col: str, attributes: Sequence[str] = ()) -> DataFrame:
    """One row per casefolded text: representative id, number of copies and the range of each attribute.

    Copies are counted, never paired with each other: a text that fills a third of the table is one row.
    """
    spans = [f(c).alias(f"{c}_{n}") for c in attributes for n, f in (("min", F.min), ("max", F.max))]
    key = F.sha2(tx.casefold(F.coalesce(F.col("text"), F.lit(""))), 256)
    first = F.min(id_col)
    return df.groupBy(key.alias("text_hash")).agg(
        first.alias("doc"), F.count("*").alias("copies"), F.min_by("text", id_col).alias("text"), *spans
    )


def near_duplicate_pairs(
    df: DataFrame, id_col: str, group_col: str, label_col: str, threshold: float = NEAR_DUPLICATE
) -> DataFrame:
    """Pairs of distinct texts whose gram cosine reaches the threshold, with leakage flags.

    Exact copies appear as ``copies_a`` / ``copies_b`` of their representative (see ``copy_groups`` for the
    rows behind it), so the output does not grow with the square of a copied text. Distinct texts that are all alike
    give all their pairs; ``neighbours.near_duplicate_groups`` gives one row per document instead.
    """
    texts = _numbered(distinct_texts(df, id_col, [group_col, label_col]))
    close = close_pairs(_weights(texts, threshold).withColumn("component", F.col("doc")), None, threshold)
    found = close.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "similarity")
    info = texts.drop("text", "text_hash").withColumnRenamed("doc", "record_id").withColumnRenamed("no", "doc")
    a = info.select(*[F.col(c).alias(f"{c}_a") for c in info.columns])
    b = info.select(*[F.col(c).alias(f"{c}_b") for c in info.columns])
    full = found.join(a, "doc_a").join(b, "doc_b")

    def differs(column: str) -> Column:
        low_a, high_a, low_b, high_b = (F.col(f"{column}_{e}_{s}") for s in "ab" for e in ("min", "max"))
        return ~(low_a.eqNullSafe(high_a) & low_b.eqNullSafe(high_b) & low_a.eqNullSafe(low_b))

    # Numbers order the join; the output names the smaller id first.
    swap = F.col("record_id_a") > F.col("record_id_b")
    return full.select(
        F.least("record_id_a", "record_id_b").alias("record_id_a"),
        F.greatest("record_id_a", "record_id_b").alias("record_id_b"),
        F.when(swap, F.col("copies_b")).otherwise(F.col("copies_a")).alias("copies_a"),
        F.when(swap, F.col("copies_a")).otherwise(F.col("copies_b")).alias("copies_b"),
        F.round("similarity", 3).alias("similarity"),
        differs(group_col).alias("crosses_groups"), differs(label_col).alias("labels_differ"),
    )


def copy_groups(df: DataFrame, id_col: str) -> DataFrame:
    """Every row whose text occurs more than once, with the representative of its copies."""
    keyed = df.select(F.col(id_col).alias("record_id"), F.sha2(tx.casefold(F.coalesce(F.col("text"), F.lit(""))), 256).alias("k"))
    groups = keyed.groupBy("k").agg(F.min("record_id").alias("representative"), F.count("*").alias("copies"))
    return keyed.join(groups.filter("copies > 1"), "k").select("record_id", "representative", "copies")


# --- drift between slices ----------------------------------------------------------------

def class_shares(df: DataFrame, slice_col: str, label_col: str) -> DataFrame:
    counted = df.filter(F.col(label_col).isNotNull()).groupBy(slice_col, label_col).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(slice_col)))


def prevalence_shift(df: DataFrame, slice_col: str, label_col: str, a: str, b: str) -> DataFrame:
    """Difference of class shares between two slices."""
    shares = class_shares(df.filter(F.col(slice_col).isin(a, b)), slice_col, label_col)
    part = lambda s: F.coalesce(F.sum(F.when(F.col(slice_col) == s, F.col("share"))), F.lit(0.0))
    return shares.groupBy(label_col).agg(F.round(part(a) - part(b), 4).alias("shift"))


def length_profile(df: DataFrame, slice_col: str) -> DataFrame:
    """Mean and median text length per slice."""
    size = F.length(F.coalesce(F.col("text"), F.lit("")))
    return df.groupBy(slice_col).agg(F.count("*").alias("rows"), F.avg(size).alias("mean_length"), F.median(size).alias("median_length"))


def top_vocabulary(df: DataFrame, slice_col: str, top: int = VOCABULARY_TOP) -> DataFrame:
    """Most frequent words per slice, ties by word."""
    counts = df.select(slice_col, F.explode(word_terms(F.col("text"))).alias("term")).groupBy(slice_col, "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(slice_col).orderBy(F.desc("n"), "term"))
    return counts.withColumn("_rank", rank).filter(F.col("_rank") <= top).drop("_rank")


def vocabulary_overlap(vocabulary: DataFrame, slice_col: str, a: str, b: str) -> DataFrame:
    """Shared words, all words and their ratio."""
    per_term = vocabulary.filter(F.col(slice_col).isin(a, b)).groupBy("term").agg(F.count_distinct(slice_col).alias("s"))
    shared, every = F.count_if(F.col("s") == 2), F.count("*")
    return per_term.agg(
        shared.alias("shared_terms"), every.alias("all_terms"),
        F.coalesce(F.try_divide(shared, every), F.lit(0.0)).alias("vocabulary_jaccard"),
    )


def centroid_distance(df: DataFrame, id_col: str, slice_col: str, a: str, b: str) -> DataFrame:
    """Cosine distance of the mean TF-IDF vectors of two slices, idf over both."""
    both = df.filter(F.col(slice_col).isin(a, b))
    counts = term_counts(both, id_col, word_terms(F.col("text")))
    sizes = {r[0]: r[1] for r in both.groupBy(slice_col).count().collect()}  # two rows
    weights = tfidf(counts, sum(sizes.values()))
    of = both.select(F.col(id_col).alias("doc"), F.col(slice_col).alias("_slice"))
    sums = weights.join(of, "doc").groupBy("term").agg(
        (F.coalesce(F.sum(F.when(F.col("_slice") == a, F.col("weight"))), F.lit(0.0)) / F.lit(sizes.get(a, 1))).alias("x"),
        (F.coalesce(F.sum(F.when(F.col("_slice") == b, F.col("weight"))), F.lit(0.0)) / F.lit(sizes.get(b, 1))).alias("y"),
    )
    x, y = F.col("x"), F.col("y")
    cosine = F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y)))
    return sums.agg((F.lit(1.0) - cosine).alias("tfidf_centroid_cosine_distance"))


def slice_shift(df: DataFrame, id_col: str, slice_col: str, label_col: str, a: str, b: str) -> DataFrame:
    """One row of shift measures for a pair of slices; small slices carry a warning."""
    shift = prevalence_shift(df, slice_col, label_col, a, b).agg(F.max(F.abs("shift")).alias("max_prevalence_shift"))
    lengths = length_profile(df.filter(F.col(slice_col).isin(a, b)), slice_col)
    pick = lambda s, c: F.max(F.when(F.col(slice_col) == s, F.col(c)))
    sizes = lengths.agg(
        pick(a, "rows").alias("rows_a"), pick(b, "rows").alias("rows_b"),
        pick(a, "mean_length").alias("mean_length_a"), pick(b, "mean_length").alias("mean_length_b"),
    )
    words = vocabulary_overlap(top_vocabulary(df.filter(F.col(slice_col).isin(a, b)), slice_col), slice_col, a, b).select("vocabulary_jaccard")
    out = side_by_side(sizes, shift, words, centroid_distance(df, id_col, slice_col, a, b))
    small = F.least(F.coalesce("rows_a", F.lit(0)), F.coalesce("rows_b", F.lit(0))) < MIN_SLICE_ROWS
    return out.select(F.lit(a).alias("slice_a"), F.lit(b).alias("slice_b"), "*", small.alias("small_sample"))
