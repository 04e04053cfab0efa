"""Quality rules judged by host: failure counts by source, shrunk towards a common rate, joined back to the documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.words import Words, slices, text_rows, windows
from pulseframe.session import materialise

#: A text fails with fewer words, or if over half of its words lie in repeated 3-word windows.
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 50, 3, 50
#: A host is rejected if its shrunk failure rate is over this.
HOST_RATE = 0.5
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _equal_windows(words: Words, place: np.ndarray, value: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks the windows whose word sequence occurs twice or more in their text; sequences are compared as words."""
    order = np.lexsort((value, owner))
    same = (value[order][1:] == value[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(place), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    candidates = np.flatnonzero(twice).tolist()
    keys = [(int(owner[i]), *(words.word(place[i] + k) for k in range(WINDOW))) for i in candidates]
    for key in keys:
        seen[key] = seen.get(key, 0) + 1
    twice[[i for i, key in zip(candidates, keys) if seen[key] < 2]] = False
    return twice


def _line_counts(texts: list) -> list[int]:
    out = []
    for text in texts:
        seen, n = set(), 0
        for line in (text or b"").split(b"\n"):
            if line in seen:
                n += 1
            elif line.strip(b" \t\n\r\x0b\x0c"):
                seen.add(line)
        out.append(n)
    return out


def _measure_batches(batches):
    for rows, texts in slices(batches):
        words = Words(texts)
        n, size = words.counts, len(texts)
        inside = np.zeros(len(words.bytes) + 1, np.int32)
        inside[words.starts] += 1
        inside[words.ends] -= 1
        # Code points: every byte that does not continue one.
        letter = (np.cumsum(inside[:-1]) > 0) & ((words.bytes & 0xC0) != 0x80)
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.concatenate([[0], ends])])
        left = np.repeat(words.first[1:], n) - np.arange(len(words.starts))
        place = np.flatnonzero(left >= WINDOW)
        covered = np.zeros(len(words.starts) + 1, np.int32)
        if len(place):
            twice = place[_equal_windows(words, place, windows(words.hashes(), WINDOW)[place], words.text[place])]
            covered[twice] += 1
            np.subtract.at(covered, twice + WINDOW, 1)
        repeated = np.bincount(words.text, np.cumsum(covered[:-1]) > 0, size).astype(np.int64) if len(words.starts) else np.zeros(size, np.int64)
        failed = (n < LEAST_WORDS) | (100 * repeated > REPEAT_PERCENT * n)
        yield pa.record_batch({
            "doc_id": rows.column("doc_id"), "source": rows.column("source").cast(pa.string()), "n_words": pa.array(n, pa.int64()), "word_chars": pa.array(total(letter), pa.int64()),
            "n_symbols": pa.array(total(_SYMBOL[words.bytes]), pa.int64()), "n_dup_lines": pa.array(_line_counts(texts), pa.int64()),
            "n_repeat_words": pa.array(repeated), "base_failed": pa.array(failed)})


def host_rates(measures: DataFrame) -> DataFrame:
    """(source, n, failed, rate, shrunk): failures by host, with a beta prior fitted to all hosts by moments.

    The prior's mean is the failure rate of all rows. Its weight (in rows) follows from how much more the hosts' rates
    differ than chance allows; hosts that differ no more than by chance all get the common rate. A null source is a host.
    """
    hosts = measures.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = materialise(hosts, "hosts")
    all_ = hosts.agg(F.sum("n").alias("rows"), F.sum("failed").alias("bad"), F.count("*").alias("hosts"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    mean = F.col("bad") / F.col("rows")
    spread = F.sum(F.col("n") * (F.col("failed") / F.col("n") - F.col("mean")) ** 2)
    with_mean = hosts.join(F.broadcast(all_.select(mean.alias("mean"), "rows", "hosts", "squares")))
    one = with_mean.groupBy("mean", "rows", "hosts", "squares").agg(spread.alias("spread"))
    # Expected spread: mean (1 - mean) (hosts - 1) by chance, and the prior's variance times (rows - squares / rows).
    chance = F.col("mean") * (1 - F.col("mean"))
    between = (F.col("spread") - chance * (F.col("hosts") - 1)) / F.nullif(F.col("rows") - F.col("squares") / F.col("rows"), F.lit(0.0))
    weight = F.when((F.col("hosts") > 1) & (between > 0) & (between < chance), chance / between - 1).when(between >= chance, F.lit(0.0))
    prior = one.select("mean", weight.alias("weight"))
    shrunk = F.when(F.col("weight").isNull(), F.col("mean")).otherwise((F.col("failed") + F.col("weight") * F.col("mean")) / (F.col("n") + F.col("weight")))
    return hosts.join(F.broadcast(prior)).select("source", "n", "failed", (F.col("failed") / F.col("n")).alias("rate"), shrunk.alias("shrunk"))


def host_rules(docs: DataFrame, limit: float = HOST_RATE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, kept) per row of ``docs``.

    ``docs(doc_id, source, text)``; the source is the host. A null text has no words and fails. A row is kept if it does not
    fail itself and its host's shrunk failure rate is at most ``limit``. Null sources are one host. Rows that repeat a
    doc_id are judged one by one. An empty table gives no rows.
    """
    measures = text_rows(docs, "doc_id", "source", "text").withColumn("text", F.col("text").cast("string")).mapInArrow(
        _measure_batches, f"doc_id {dict(docs.dtypes)['doc_id']}, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    measures = materialise(measures, "measures")
    rates = host_rates(measures).select(F.col("source").alias("host"), "shrunk")
    joined = measures.join(rates, measures["source"].eqNullSafe(rates["host"]), "left")
    kept = ~F.col("base_failed") & (F.col("shrunk") <= limit)
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("shrunk").alias("host_rate"), kept.alias("kept"))
