"""Registered queries of this subpackage, with their DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm import extract, fptree, hmm, hosts, merkle, mixing, quality, simhash, similarity, superkmers, tiling, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its DuckDB equivalent."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_minhash_near_dedup", """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS sh FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), link AS MATERIALIZED (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)
), edge AS MATERIALIZED (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, edge.y FROM reach JOIN edge ON reach.y = edge.x
), root AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM root LEFT JOIN n USING (doc_id)
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return similarity.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_substring_dedup", """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), hit AS (
  SELECT doc_id, i FROM win JOIN (SELECT s, min(doc_id) AS first_doc FROM win GROUP BY s) USING (s) WHERE first_doc < doc_id
), gone AS (
  SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM hit)
), word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS s FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by a 13-word window of an earlier document, over all documents."""
    return superkmers.removal_digest(table(spark, sf_dir, "documents"))


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents at the target weights takes of each document."""
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


@query("op1_benchmark_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items leaked by any document: one row per document and item."""
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and verdict of all documents."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("tag")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_quality_rules", """
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3)
), twice AS (
  SELECT doc_id, a, b, c FROM win GROUP BY ALL HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM win JOIN twice USING (doc_id, a, b, c)) GROUP BY doc_id
), line AS (
  SELECT doc_id, line, count(*) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line
), lines AS (
  SELECT doc_id, sum(k - 1) AS n FROM line GROUP BY doc_id
), m AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), host AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS bad FROM f GROUP BY source
), total AS (
  SELECT sum(n) AS r, sum(bad) / sum(n) AS mean, CAST(count(*) AS DOUBLE) AS h, sum(n * n) AS sq FROM host
), spread AS (
  SELECT r, mean, h, sq, mean * (1 - mean) AS chance, (SELECT sum(n * (bad / n - mean) * (bad / n - mean)) FROM host) AS s FROM total
), prior AS (
  SELECT mean, h, chance, (s - chance * (h - 1)) / (r - sq / r) AS v FROM spread
), rate AS (
  SELECT source, CASE WHEN h > 1 AND v > 0 AND v < chance THEN (bad + (chance / v - 1) * mean) / (n + chance / v - 1)
    WHEN v >= chance THEN bad / n ELSE mean END AS shrunk FROM host, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND shrunk <= 0.5 AS kept
FROM f JOIN rate ON f.source IS NOT DISTINCT FROM rate.source
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, line and host rules of all documents."""
    return hosts.host_rules(table(spark, sf_dir, "documents")).drop("host_rate")


@query("op6_warc_salvage", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
), top AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS t FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < t THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < t THEN t END AS refers_to
FROM top
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op8_html_extraction")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract.extract_pages(table(spark, sf_dir, "pages"))


@query("op3_lm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of all documents under a hidden Markov model of the corpus."""
    return hmm.score_texts(table(spark, sf_dir, "documents"))


@query("op11_simhash_near_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and their components, over all documents."""
    return simhash.simhash_near_duplicates(table(spark, sf_dir, "documents"))


@query("op12_ranked_search", """
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), c AS (
  SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), total AS (
  SELECT count(DISTINCT doc_id) AS docs, count(*) AS len FROM t
), d AS (
  SELECT doc_id, 25 + (75 * count(*) * any_value(docs)) // any_value(len) AS m FROM t, total GROUP BY doc_id
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM c, total GROUP BY term
), s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM i JOIN c USING (term) JOIN w USING (term) JOIN d USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item, among all documents."""
    return fptree.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_merkle_manifest", """
WITH RECURSIVE c AS (
  SELECT doc_id, coalesce('=' || source, '') AS s, text, xor(4294967295, list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END)) AS crc,
    concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head
  FROM documents
), l AS (
  SELECT doc_id, s, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(bad) || ':' || bad, '-')) AS tampered
  FROM (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS bad FROM c)
), nodes AS (
  SELECT s, 0 AS level, row_number() OVER (PARTITION BY s ORDER BY doc_id) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY s) AS n FROM l
  UNION ALL
  SELECT s, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY s, level, pos // 3
), subroots AS (
  SELECT s, h, row_number() OVER (ORDER BY s) - 1 AS pos FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, pos // 3
), sides AS (
  SELECT s, level, pos, coalesce(string_agg(h, '') OVER (PARTITION BY s, level, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER (PARTITION BY s, level, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM (SELECT s, level, pos, h, n FROM nodes UNION ALL SELECT '/', level, pos, h, n FROM tops) WHERE n > 1
), low AS (
  SELECT l.doc_id, l.s, 0 AS level, row_number() OVER (PARTITION BY l.s ORDER BY doc_id) - 1 AS pos, l.tampered AS folded, '' AS proof FROM l
  UNION ALL
  SELECT doc_id, s, level + 1, pos // 3, sha256(before || folded || after), proof || before || after FROM low JOIN sides USING (s, level, pos)
), high AS (
  SELECT doc_id, 0 AS level, subroots.pos, arg_max(folded, low.level) AS folded, arg_max(proof, low.level) AS proof
  FROM low JOIN subroots USING (s) GROUP BY doc_id, subroots.pos
  UNION ALL
  SELECT doc_id, level + 1, pos // 3, sha256(before || folded || after), proof || before || after
  FROM high JOIN (SELECT level, pos, before, after FROM sides WHERE s = '/') USING (level, pos)
), done AS (
  SELECT doc_id, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM high GROUP BY doc_id
)
SELECT doc_id, leaf, subroots.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.h AS verified
FROM l JOIN subroots USING (s) JOIN done USING (doc_id), (SELECT h FROM tops WHERE n = 1) AS root
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and witness of every document, and what a tampered text folds to."""
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.without_line_breaks())
