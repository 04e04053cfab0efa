"""Likelihood of texts under a hidden Markov language model trained on the corpus.

Symbols: the ``FREQUENT`` most frequent training words have their own, all other words share ``CLASSES`` symbols by their last
two bytes, and each text ends with an end symbol. A state emits a symbol; inside a class a word has its share of the
class's training tokens, with an equal part for one unknown word. So every text has an exact probability, and the model's
arrays are bounded while the counts that they come from cover the whole corpus.

Training is incremental Baum-Welch over all training texts. A hash of the text deals them into ``SHARDS`` shards. A step takes one
shard: each partition adds up the expected counts of its pieces, Spark sums them by symbol, they replace the shard's counts of the
pass before, and the model follows from the counts of all shards. So a pass renews the model once a shard, not once, and few passes
do. The iteration starts from the words' shares, moved apart at random with a fixed seed, so neither the size nor the layout of a
table changes what it learns from. The score of a text is the scaled forward recursion over the whole text. Counts of words outside
the frequent ones are joined by a shuffle: each batch of texts asks once for each of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.kneser import distinct_words, text_sums
from pulseframe.llm.words import Words, slices, text_rows
from pulseframe.session import materialise, work_path

STATES = 8
FREQUENT = 32_000
CLASSES = 256
#: Shards of the training texts, at every size; the driver holds one table of expected counts for each.
SHARDS = 16
#: Passes over all training texts. From five random starts on sf0.1 three passes reach -2.939 a training token on average (log10), 18 rounds
#: that renew the model once a pass -2.943; the optima differ by more than that from start to start.
ROUNDS = 3
#: Training tokens of a task, and of one call of the recursions.
TASK_TOKENS, CALL_TOKENS = 2_000_000, 400_000
#: Training texts are cut into pieces of so many tokens, each a sequence of its own; scored texts are never cut.
PIECE = 256
#: Bytes of text that are encoded, and asked for, as one batch.
ENCODE_BYTES = 2_500_000
#: Added to each count of a word.
ADD = 0.1
#: Pseudo-tokens with the corpus's shares in each state.
PRIOR = 50.0
HELD_OUT_OF = 10


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


def _count_batches(batches):
    for rows, texts in slices(batches):
        words = Words(texts, lower=True)
        names, _, inverse = distinct_words(words)
        yield pa.record_batch({"word": pa.array([None, *names], pa.binary()),
                               "n": pa.array([rows.num_rows, *np.bincount(inverse, minlength=len(names)).tolist()], pa.int64())})


def _class_of(words: list[bytes]) -> np.ndarray:
    return np.array([(w[-1] * 31 + (w[-2] if len(w) > 1 else 0) * 7) % CLASSES for w in words], np.int64)


def _class_batches(batches):
    for batch in batches:
        which, n = _class_of(batch.column("word").to_pylist()), batch.column("n").to_numpy()
        tokens, kinds = np.bincount(which, n, CLASSES), np.bincount(which, minlength=CLASSES)
        yield pa.record_batch({"class": pa.array(range(CLASSES), pa.int32()), "tokens": pa.array(tokens.astype(np.int64)), "kinds": pa.array(kinds, pa.int64())})


class Vocabulary:
    """Training counts: totals, the frequent words with their counts, and tokens and words of each class."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("word").alias("words"),
                           F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)).alias("texts")).first()
        self.ends, self.tokens = total["texts"], total["n"]
        self.kinds = total["words"] + (self.ends > 0)
        top = counts.where("word is not null").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
        self.frequent = [bytes(r["word"]) for r in top]
        self.counts = np.array([r["n"] for r in top], np.int64)
        # Words behind the last frequent one, in the same order.
        rest = counts.where("word is not null")
        if top:
            last = F.lit(bytearray(self.frequent[-1]))
            rest = rest.where((F.col("n") < int(self.counts[-1])) | (F.col("n") == int(self.counts[-1])) & (F.col("word") > last))
        sums = rest.mapInArrow(_class_batches, "class int, tokens long, kinds long").groupBy("class").agg(F.sum("tokens").alias("t"), F.sum("kinds").alias("k"))
        self.class_tokens, self.class_kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in sums.collect():
            self.class_tokens[r["class"]], self.class_kinds[r["class"]] = r["t"], r["k"]
        self.symbols = len(self.frequent) + CLASSES + 1
        shares = np.concatenate([self.counts, self.class_tokens, [self.ends]]) + ADD
        self.shares = shares / shares.sum()

    def base(self, c: np.ndarray) -> np.ndarray:
        """log10 of the add-0.1 share of a word with count c among all training tokens."""
        return np.log10((c + ADD) / (self.tokens + ADD * (self.kinds + 1)))


def _encoder(frequent: list[bytes], classes_at: int):
    def encode(batches):
        known = Words([b" ".join(frequent)]).hashes()
        order = np.argsort(known)
        known = known[order]
        for rows, texts in slices(batches, size=ENCODE_BYTES):
            words = Words(texts, lower=True)
            codes = words.hashes()
            at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
            hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            symbol = np.zeros(len(codes), np.int16)
            symbol[hit] = order[at[hit]]
            rare = np.flatnonzero(~hit)
            _, first, inverse = np.unique(codes[rare], return_index=True, return_inverse=True)
            names = [words.word(i) for i in rare[first].tolist()]
            classes = _class_of(names)
            symbol[rare] = (classes[inverse] + classes_at).astype(np.int16) if len(names) else 0
            # Symbols with an end behind each text.
            n = words.counts + 1
            out = np.full(int(n.sum()), classes_at + CLASSES, np.int16)
            out[np.arange(len(symbol)) + words.text] = symbol
            key, times = np.unique(words.text[rare] * np.int64(max(1, len(names))) + inverse, return_counts=True)
            one = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())
            yield pa.record_batch({
                "docs": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())), "held": pa.array([rows.column("held").to_pylist()], pa.list_(pa.bool_())),
                "shards": one(rows.column("shard").to_numpy(), np.int16), "sizes": one(n, np.int32), "symbols": one(out, np.int16), "words": pa.array([names], pa.list_(pa.binary())), "classes": one(classes, np.int16),
                "owner": one(key // max(1, len(names)), np.int32), "word": one(key % max(1, len(names)), np.int32), "times": one(times, np.int32)})

    return encode


class Model:
    """start (states), move (states x states), emit (symbols x states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


def _matrix(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences as columns, longest first: step by sequence, the number of sequences at each step, and the order."""
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    alive = np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left") if len(sizes) else np.zeros(0, np.int64)
    return begin, alive, order


def forward(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence; sizes are at least 1."""
    begin, alive, order = _matrix(symbols, sizes)
    total, a = np.zeros(len(sizes)), None
    for t, n in enumerate(alive.tolist()):
        seen = model.emit[symbols[begin[:n] + t]]
        a = (model.start if a is None else a[:n] @ model.move) * seen
        scale = a.sum(axis=1)
        total[:n] += np.log10(scale)
        a /= scale[:, None]
    out = np.zeros(len(sizes))
    out[order] = total
    return out


def expected(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions of the sequences, and their log10 probability together.

    Works step by step through all sequences at once; what a step needs lies side by side in memory.
    """
    begin, alive, _ = _matrix(symbols, sizes)
    states, ones = len(model.start), np.ones(len(model.start))
    starts, moves = np.zeros(states), np.zeros((states, states))
    if not len(alive):
        return starts, moves, np.zeros(model.emit.shape), 0.0
    offset = np.concatenate([[0], np.cumsum(alive)])
    step = np.repeat(np.arange(len(alive)), alive)
    ordered = symbols[begin[np.arange(len(symbols)) - offset[step]] + step]
    seen = model.emit[ordered]
    alphas, scales, before = np.empty_like(seen), np.empty(len(symbols)), None
    for a, b in zip(offset[:-1].tolist(), offset[1:].tolist()):
        here, scale = alphas[a:b], scales[a:b]
        if before is None:
            np.multiply(model.start, seen[a:b], out=here)
        else:
            np.matmul(before[: b - a], model.move, out=here)
            here *= seen[a:b]
        np.matmul(here, ones, out=scale)
        here /= scale[:, None]
        before = here
    seen /= scales[:, None]
    back, later = model.move.T.copy(), np.ones((int(alive[0]), states))
    # Sequences that end at a later step come first; those that end here start from ones.
    for t in range(len(alive) - 1, -1, -1):
        a, b = offset[t], offset[t + 1]
        ahead = seen[a:b]
        ahead *= later[: b - a]
        alphas[a:b] *= later[: b - a]
        if t:
            # The posterior of the step before is not made yet, so its alphas are still those of the forward pass.
            moves += alphas[offset[t - 1] : offset[t - 1] + b - a].T @ ahead
            np.matmul(ahead, back, out=later[: b - a])
    starts = alphas[: offset[1]].sum(axis=0)
    emissions = np.stack([np.bincount(ordered, column, len(model.emit)) for column in np.ascontiguousarray(alphas.T)], axis=1)
    return starts, moves * model.move, emissions, float(np.log10(scales).sum())


def _updated(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, shares: np.ndarray) -> Model:
    emissions = emissions + PRIOR * shares[:, None]
    return Model((starts + 0.1) / (starts + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))


def _pieces(sizes: np.ndarray) -> np.ndarray:
    """Sizes of the pieces that sequences of these sizes are cut into."""
    n = -(-sizes // PIECE)
    out = np.full(int(n.sum()), PIECE, np.int64)
    out[np.cumsum(n) - 1] = sizes - (n - 1) * PIECE
    return out


def _training_batches(batches):
    """One row per batch of texts and shard: symbols and piece sizes of its texts that are not held out."""
    for batch in batches:
        for row in batch.to_pylist():
            symbols, sizes = np.frombuffer(row["symbols"], np.int16), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
            shards = np.where(np.array(row["held"], bool), -1, np.frombuffer(row["shards"], np.int16))
            of_symbol = np.repeat(shards, sizes)
            for shard in np.unique(shards[shards >= 0]).tolist():
                yield pa.record_batch({
                    "batch": pa.array([row["batch"]], pa.int64()), "shard": pa.array([shard], pa.int32()),
                    "symbols": pa.array([symbols[of_symbol == shard].tobytes()], pa.binary()),
                    "pieces": pa.array([_pieces(sizes[shards == shard]).astype(np.int16).tobytes()], pa.binary())})


def training_table(encoded: DataFrame, tokens: int) -> DataFrame:
    """(symbols, pieces, shard), written by shard in files of about ``TASK_TOKENS``; a shard of equal texts is spread like any other."""
    spark = encoded.sparkSession
    rows = encoded.select("batch", "symbols", "sizes", "held", "shards").mapInArrow(_training_batches, "batch long, shard int, symbols binary, pieces binary")
    files = 1 + tokens // (SHARDS * TASK_TOKENS)
    path = work_path(spark, "training")
    dealt = rows.repartition(SHARDS * files, "shard", F.pmod(F.xxhash64("batch"), F.lit(files)))
    dealt.drop("batch").write.partitionBy("shard").parquet(path)
    return spark.read.schema("symbols binary, pieces binary, shard int").parquet(path)


def _calls(batches):
    """Symbols and piece sizes of rows put together up to ``CALL_TOKENS``, as a step over few sequences costs as much as over many."""
    symbols, pieces, held = [], [], 0
    for batch in batches:
        for row in batch.to_pylist():
            symbols.append(np.frombuffer(row["symbols"], np.int16))
            pieces.append(np.frombuffer(row["pieces"], np.int16))
            held += len(symbols[-1])
            if held >= CALL_TOKENS:
                yield np.concatenate(symbols).astype(np.int64), np.concatenate(pieces).astype(np.int64)
                symbols, pieces, held = [], [], 0
    if held:
        yield np.concatenate(symbols).astype(np.int64), np.concatenate(pieces).astype(np.int64)


def _expectation_batches(model: Model):
    """Expected counts of a partition: rows of symbol >= 0 are emissions, -1 the starts, -2 - k the moves from state k."""

    def run(batches):
        starts, moves, emissions, some = 0.0, 0.0, 0.0, False
        for symbols, sizes in _calls(batches):
            s, m, e, _ = expected(model, symbols, sizes)
            starts, moves, emissions, some = starts + s, moves + m, emissions + e, True
        if some:
            used = np.flatnonzero(emissions.any(axis=1))
            key = np.concatenate([used, [-1], -2 - np.arange(len(moves))])
            value = np.concatenate([emissions[used], starts[None], moves])
            yield pa.record_batch({"symbol": pa.array(key, pa.int32())} | {f"v{k}": pa.array(value[:, k]) for k in range(value.shape[1])})

    return run


def _first(vocabulary: Vocabulary, states: int) -> Model:
    rng = np.random.default_rng(3)
    emit = vocabulary.shares[:, None] * rng.uniform(0.5, 1.5, (vocabulary.symbols, states))
    move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _shard_counts(rows: DataFrame, model: Model) -> np.ndarray | None:
    """Expected counts of starts (first row), moves (a row per state) and emissions (a row per symbol); None without rows."""
    states = len(model.start)
    columns = [f"v{k}" for k in range(states)]
    sums = rows.select("symbols", "pieces").mapInArrow(_expectation_batches(model), "symbol int, " + ", ".join(f"{c} double" for c in columns))
    table = sums.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    if not len(table):
        return None
    key = table.column("symbol").to_numpy()
    out = np.zeros((1 + states + len(model.emit), states))
    out[np.where(key >= 0, key + 1 + states, -1 - key)] = np.stack([table.column(c).to_numpy() for c in columns], axis=1)
    return out


def train(training: DataFrame, vocabulary: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Incremental Baum-Welch over all rows of ``training(symbols, pieces, shard)``.

    In the first pass the model follows from the shards seen so far, later from all, each with its latest counts.
    """
    model = _first(vocabulary, states)
    latest: dict[int, np.ndarray] = {}
    for done in range(rounds):
        for shard in list(latest) if done else range(SHARDS):
            counts = _shard_counts(training.where(F.col("shard") == shard), model)
            if counts is not None:
                latest[shard] = counts
                total = sum(latest.values())
                model = _updated(total[0], total[1 : 1 + states], total[1 + states :], vocabulary.shares)
    return model


def _forward_batches(model: Model, frequent_base: np.ndarray, frequent: int, end_known: bool):
    """Per text: tokens, known tokens, base and model score as far as the frequent words go."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                symbols, sizes = np.frombuffer(row["symbols"], np.int16).astype(np.int64), np.frombuffer(row["sizes"], np.int32).astype(np.int64)
                text = np.repeat(np.arange(len(sizes)), sizes)
                known = text_sums(((symbols < frequent) | (symbols == frequent + CLASSES) & end_known).astype(float), text, len(sizes))
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                yield pa.record_batch({
                    "batch": pa.array([row["batch"]], pa.int64()), "docs": one(row["docs"], pa.int64()), "held": one(row["held"], pa.bool_()),
                    "tokens": one(sizes, pa.int64()), "known": one(known.astype(np.int64), pa.int64()),
                    "base": one(text_sums(frequent_base[symbols], text, len(sizes)), pa.float64()), "score": one(forward(model, symbols, sizes), pa.float64()),
                    "classes": pa.array([row["classes"]], pa.binary()), "owner": pa.array([row["owner"]], pa.binary()), "word": pa.array([row["word"]], pa.binary()), "times": pa.array([row["times"]], pa.binary())})

    return run


def _final_batches(tokens: int, kinds: int, class_base: np.ndarray):
    """Adds the words outside the frequent ones, whose counts have been joined; those without an answer were counted once."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                owner, word, times = (np.frombuffer(row[c], np.int32) for c in ("owner", "word", "times"))
                which = np.frombuffer(row["classes"], np.int16)
                count = np.ones(len(which))
                for f in row["found"] or []:
                    count[f["i"]] = f["n"]
                n = len(row["docs"])
                add = lambda x: text_sums(x * times, owner, n)
                base = np.array(row["base"]) + add(np.log10((count + ADD) / (tokens + ADD * (kinds + 1)))[word])
                score = np.array(row["score"]) + add((np.log10(count + ADD) - class_base[which])[word])
                known = np.array(row["known"]) + add((count > 0).astype(float)[word]).astype(np.int64)
                yield pa.record_batch({
                    "doc_id": pa.array(row["docs"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(row["tokens"], pa.int64()),
                    "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([tokens] * n, pa.int64()), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def _asked_batches(batches):
    for batch in batches:
        for row in batch.to_pylist():
            names = row["words"]
            yield pa.record_batch({"batch": pa.array([row["batch"]] * len(names), pa.int64()), "i": pa.array(range(len(names)), pa.int32()),
                                   "word": pa.array(names, pa.binary())})


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs(doc_id, text)``.

    A row is held out if crc32 of its doc_id leaves 0 modulo 10; all others train the model, rows without doc_id and repeated
    rows as well. Null and empty texts are one end token. Without training rows every word has the same share. Scores are
    log10. An empty table gives no rows.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    shard = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(SHARDS)).cast("int")
    rows = text_rows(texts.withColumns({"held": held_out(), "shard": shard}), "doc_id", "held", "shard", "text")
    counts = rows.where("not held").select("text").mapInArrow(_count_batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "words")
    vocabulary = Vocabulary(counts)
    frequent = len(vocabulary.frequent)
    encoded = rows.mapInArrow(_encoder(vocabulary.frequent, frequent),
                              "docs array<long>, held array<boolean>, shards binary, sizes binary, symbols binary, words array<binary>, classes binary, owner binary, word binary, times binary")
    encoded = materialise(encoded.withColumn("batch", F.monotonically_increasing_id()), "encoded")
    model = train(training_table(encoded, vocabulary.tokens), vocabulary, states, rounds)
    base = np.concatenate([vocabulary.base(vocabulary.counts), np.zeros(CLASSES), [vocabulary.base(np.array(vocabulary.ends))]])
    scored = encoded.drop("words", "shards").mapInArrow(_forward_batches(model, base, frequent, vocabulary.ends > 0),
                               "batch long, docs array<long>, held array<boolean>, tokens array<long>, known array<long>, base array<double>, score array<double>, "
                               "classes binary, owner binary, word binary, times binary")
    asked = encoded.select("batch", "words").mapInArrow(_asked_batches, "batch long, i int, word binary")
    # Most words outside the frequent ones occur once in the corpus, so that is the count of a word without an answer.
    answers = asked.join(counts.where("word is not null"), "word", "left").select("batch", "i", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")
    found = answers.groupBy("batch").agg(F.collect_list(F.struct("i", "n")).alias("found"))
    class_base = np.log10(vocabulary.class_tokens + ADD * (vocabulary.class_kinds + 1))
    return scored.join(found, "batch", "left").mapInArrow(
        _final_batches(vocabulary.tokens, vocabulary.kinds, class_base),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
