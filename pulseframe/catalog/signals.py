"""Cleaning, scoring and ranking of signals (B, C1-C9, D1-D3, D11-D13, E3, E15, F1-F4, G1, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.catalog.base import (
    calendar,
    events,
    labelled_signals,
    query,
    rnd,
    rsql,
    scored_signals,
    signals,
    ssql,
    stamp,
    table,
    with_views,
    TEXT_KEY_SQL,
)
from pulseframe.functions import intent, scoring, text, timing
from pulseframe.operators import calendar as cal_ops
from pulseframe.operators import cleaning, lexicon, scores

NOW = "2024-06-01 00:00:00"

# --- raw rows with the defects the given tables lack --------------------------------

_RAW_TS = """CASE event_id % 8
    WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    WHEN 1 THEN cast(unix_timestamp(ts) AS string)
    WHEN 2 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
    WHEN 3 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss')
    WHEN 4 THEN CASE WHEN k < 50 THEN '' WHEN k < 75 THEN 'nan' ELSE NULL END
    WHEN 5 THEN '0' WHEN 6 THEN 'soon' ELSE '2999-01-01T00:00:00Z' END"""

RAW_TS_SQL = """rawts AS (
  SELECT *, CASE event_id % 8 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
    WHEN 1 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR)
    WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00')
    WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 4 THEN CASE WHEN k < 50 THEN '' WHEN k < 75 THEN 'nan' ELSE NULL END
    WHEN 5 THEN '0' WHEN 6 THEN 'soon' ELSE '2999-01-01T00:00:00Z' END AS raw FROM ev),
parsed0 AS (
  SELECT *, raw IS NULL OR trim(raw) IN ('', 'nan', 'None', 'NaT') AS blank,
    regexp_matches(raw, '^[0-9.]+$') AS numeric,
    regexp_matches(raw, '([Zz]|[+-][0-9]{2}:?[0-9]{2})$') AS zoned FROM rawts),
parsed1 AS (
  SELECT *, CASE WHEN numeric THEN TIMESTAMP '1970-01-01' + to_seconds(CAST(raw AS BIGINT))
    WHEN zoned THEN try_cast(substr(raw, 1, 19) AS TIMESTAMP)
         - CASE WHEN raw LIKE '%+02:00' THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END END AS t FROM parsed0),
parsed AS (
  SELECT *, CASE WHEN blank THEN 'missing' WHEN NOT numeric AND NOT zoned THEN 'naive' WHEN t IS NULL THEN 'unparsed'
    WHEN t < TIMESTAMP '1971-01-01' THEN 'epoch_zero' WHEN t > TIMESTAMP '2024-06-02' THEN 'future'
    ELSE 'valid' END AS outcome FROM parsed1)"""


def raw_times(spark, d):
    return events(spark, d).withColumn("timestamp", F.expr(_RAW_TS))


@query("b3_parse_timestamps", with_views("ev", f", {RAW_TS_SQL} SELECT event_id, {ssql('t')} AS ts FROM parsed WHERE outcome = 'valid'"
       " UNION ALL SELECT event_id, NULL FROM parsed WHERE outcome <> 'valid'"))
def _(spark, d):
    return raw_times(spark, d).select("event_id", stamp(timing.parse_timestamp(F.col("timestamp"), NOW)).alias("ts"))


@query("b4_timestamp_status", with_views("ev", f", {RAW_TS_SQL} SELECT event_id, CASE outcome WHEN 'valid' THEN 'valid'"
       " WHEN 'missing' THEN 'missing' ELSE 'invalid' END AS status FROM parsed"))
def _(spark, d):
    return cleaning.with_parsed_time(raw_times(spark, d), "timestamp", NOW).select(
        "event_id", F.col("timestamp_status").alias("status"))


@query("b5_timestamp_report", with_views("ev", f""", {RAW_TS_SQL} SELECT count(*) AS total,
  count(*) FILTER (outcome = 'valid') AS valid, count(*) FILTER (outcome = 'missing') AS missing,
  count(*) FILTER (outcome NOT IN ('valid', 'missing')) AS invalid, count(*) FILTER (outcome = 'naive') AS naive,
  count(*) FILTER (outcome = 'epoch_zero') AS epoch_zero, count(*) FILTER (outcome = 'future') AS future,
  {ssql("min(t) FILTER (outcome = 'valid')")} AS earliest, {ssql("max(t) FILTER (outcome = 'valid')")} AS latest
  FROM parsed"""))
def _(spark, d):
    return cleaning.timestamp_report(raw_times(spark, d), "timestamp", NOW).withColumns(
        {"earliest": stamp("earliest"), "latest": stamp("latest")})


@query("b6_serialise_timestamps", with_views("ev", """ SELECT event_id,
  CASE WHEN k < 10 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS iso FROM ev"""))
def _(spark, d):
    ts = F.when(F.col("k") >= 10, F.col("ts"))
    return events(spark, d).select("event_id", timing.serialise_timestamp(ts).alias("iso"))


@query("i11_period_starts", with_views("ev", f""" SELECT event_id, {ssql("date_trunc('week', ts)")} AS week,
  {ssql("date_trunc('day', ts)")} AS day FROM ev"""))
def _(spark, d):
    ts = F.col("ts")
    return events(spark, d).select("event_id", stamp(timing.period_start(ts)).alias("week"),
                                   stamp(timing.period_start(ts, "D")).alias("day"))


@query("i12_timezone_naive", with_views("ev", f", {RAW_TS_SQL} SELECT event_id, coalesce(NOT blank AND NOT zoned OR raw = 'nan', false) AS naive FROM parsed"))
def _(spark, d):
    return raw_times(spark, d).select("event_id", F.coalesce(timing.is_zone_naive(F.col("timestamp")), F.lit(False)).alias("naive"))


@query("i13_epoch_seconds", with_views("ev", f" SELECT event_id, {ssql('''CASE WHEN k >= 5 THEN date_trunc('second', ts) END''')} AS ts FROM ev"))
def _(spark, d):
    seconds = F.when(F.col("k") < 5, F.lit(0)).otherwise(F.unix_timestamp("ts"))
    return events(spark, d).select("event_id", stamp(timing.epoch_to_timestamp(seconds)).alias("ts"))


@query("i14_iso_timestamps", with_views("ev", f" SELECT event_id, {ssql('''CASE WHEN k >= 5 THEN date_trunc('second', ts) END''')} AS ts FROM ev"))
def _(spark, d):
    iso = F.when(F.col("k") < 5, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return events(spark, d).select("event_id", stamp(timing.iso_to_timestamp(iso)).alias("ts"))


# --- cleaning ------------------------------------------------------------------------

_CLEAN_SQL = """, raw AS (
  SELECT doc_id * 2 AS pos, CASE WHEN k < 5 THEN '   ' WHEN k < 10 THEN ' [Deleted] ' WHEN k < 15 THEN NULL ELSE text END AS text,
         CASE WHEN k BETWEEN 90 AND 94 THEN NULL ELSE id END AS id, source, doc_id FROM sig
  UNION ALL SELECT doc_id * 2 + 1, 'see https://a.example/x?y=1  again ' || phrase0, id, source, doc_id
  FROM (SELECT *, 'copy' AS phrase0 FROM sig) WHERE k < 30)"""


def raw_signals(spark, d):
    sig = signals(spark, d)
    k = F.col("k")
    body = F.when(k < 5, "   ").when(k < 10, " [Deleted] ").when(k >= 15, F.col("text"))
    first = sig.select((F.col("doc_id") * 2).alias("pos"), body.alias("text"),
                       F.when(~k.between(90, 94), F.col("id")).alias("id"), "source", "doc_id", "timestamp")
    again = sig.filter(k < 30).select((F.col("doc_id") * 2 + 1).alias("pos"), F.lit("see https://a.example/x?y=1  again copy").alias("text"),
                                      "id", "source", "doc_id", "timestamp")
    return cleaning.union_all(first, again)


@query("b1_clean_signals", with_views("sig", _CLEAN_SQL + """ SELECT pos, id, md5(trim(regexp_replace(regexp_replace(text,
    'https?://[^\\s]+', ' ', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g'))) AS text_md5, 'valid' AS timestamp_status
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM raw)
  WHERE rn = 1 AND trim(coalesce(text, '')) NOT IN ('', '[Deleted]')"""))
def _(spark, d):
    return cleaning.clean_signals(raw_signals(spark, d), "pos").select(
        "pos", "id", F.md5("text").alias("text_md5"), "timestamp_status")


@query("e15_keep_first", """SELECT min(doc_id) AS doc_id FROM documents GROUP BY text""")
def _(spark, d):
    return cleaning.keep_first(table(spark, d, "documents"), ["text"], "doc_id").select("doc_id")


@query("b2_normalise_text", """SELECT page_id, md5(trim(regexp_replace(regexp_replace(url || '  ' || html,
    'https?://[^\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+', ' ', 'g'))) AS text_md5 FROM pages""")
def _(spark, d):
    body = text.normalise_text(F.concat("url", F.lit("  "), "html"))
    return table(spark, d, "pages").select("page_id", F.md5(body).alias("text_md5"))


@query("b7_filter_values", with_views("sig lsig", " SELECT id FROM lsig WHERE source IN ('src1', 'src3', 'src7') AND quality IN (1)"))
def _(spark, d):
    picked = {"source": ["src1", "src3", "src7"], "quality": ["1"], "intent_label": []}
    return cleaning.filter_values(labelled_signals(spark, d), picked).select("id")


@query("b8_distinct_values", "SELECT DISTINCT CAST(quality AS VARCHAR) AS value FROM labels WHERE quality IS NOT NULL")
def _(spark, d):
    return cleaning.distinct_values(table(spark, d, "labels"), "quality").orderBy("value")


@query("b9_drop_identifying", with_views("sig", """ SELECT source, record_type, engagement, parent_id, lang FROM sig"""))
def _(spark, d):
    slim = signals(spark, d).select("id", "metadata", "source", "record_type", "engagement", "parent_id", "lang")
    return cleaning.drop_columns(slim)


@query("b10_strip_metadata", with_views("ev", """ SELECT event_id,
  CASE WHEN k < 10 THEN 'not json' WHEN k < 20 THEN '[1,2]' ELSE '{"k":' || k || '}' END AS metadata FROM ev"""))
def _(spark, d):
    meta = F.when(F.col("k") < 10, "not json").when(F.col("k") < 20, "[1,2]").otherwise(
        F.concat(F.lit('{"author":"u'), "user_id", F.lit('","k":'), "k", F.lit("}")))
    return events(spark, d).select("event_id", cleaning.strip_metadata_keys(meta).alias("metadata"))


@query("g1_union_frames", """SELECT doc_id, lang, NULL::VARCHAR AS role FROM documents
  UNION ALL SELECT conv_id, NULL, role FROM conversations""")
def _(spark, d):
    return cleaning.union_all(table(spark, d, "documents").select("doc_id", "lang"),
                              table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "role"))


_ENRICH_SQL = """, base AS (SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN 'youtube' WHEN 1 THEN 'reddit' ELSE 'forum' END AS source,
    ts, k, CASE WHEN k < 30 THEN '' WHEN k < 40 THEN '0' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS raw FROM ev),
  found AS (SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS t FROM base WHERE k % 2 = 0),
  enr AS (SELECT CAST(b.id AS VARCHAR) AS id, source, CASE WHEN source = 'youtube' THEN coalesce(f.t, '') ELSE '' END AS "timestamp",
    CASE WHEN source = 'youtube' THEN CASE WHEN f.t IS NOT NULL THEN 'resolved' ELSE 'unresolved' END
         WHEN source = 'reddit' THEN 'skipped_source_not_enabled' ELSE 'unresolved' END AS status
    FROM base b LEFT JOIN found f USING (id) WHERE k < 40)"""


def _enrichment(spark, d):
    ev = events(spark, d)
    k, iso = F.col("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    source = F.when(F.col("user_id") % 3 == 0, "youtube").when(F.col("user_id") % 3 == 1, "reddit").otherwise("forum")
    base = ev.select(F.col("event_id").cast("string").alias("id"), source.alias("source"),
                     F.when(k < 30, "").when(k < 40, "0").otherwise(iso).alias("timestamp"))
    lookup = ev.filter(k % 2 == 0).select(F.col("event_id").cast("string").alias("id"), iso.alias("raw_timestamp"))
    return base, cleaning.enrichment_table(base, lookup, NOW, skipped=["reddit"])


@query("c8_enrichment_table", with_views("ev", _ENRICH_SQL + " SELECT * FROM enr"))
def _(spark, d):
    return _enrichment(spark, d)[1]


@query("c9_apply_enrichment", with_views("ev", _ENRICH_SQL + f""" SELECT CAST(b.id AS VARCHAR) AS id,
  CASE WHEN k >= 40 OR e.status = 'resolved' THEN {ssql('ts')} END AS "timestamp",
  CASE WHEN k >= 40 THEN 'valid' WHEN e.status = 'resolved' THEN 'recovered' WHEN k < 30 THEN 'missing' ELSE 'invalid' END AS timestamp_status
  FROM base b LEFT JOIN enr e ON e.id = CAST(b.id AS VARCHAR)"""))
def _(spark, d):
    base, table_ = _enrichment(spark, d)
    return cleaning.apply_enrichment(base, table_, NOW).select("id", stamp("timestamp").alias("timestamp"), "timestamp_status")


@query("a16_signal_profile", with_views("ev", f""", {RAW_TS_SQL} SELECT event_type AS source, count(*) AS rows,
  count(*) FILTER (outcome = 'valid') AS valid_times, count(*) FILTER (outcome = 'missing') AS missing_times,
  count(*) FILTER (outcome NOT IN ('valid', 'missing')) AS invalid_times, 'text' AS missing_columns FROM parsed GROUP BY 1"""))
def _(spark, d):
    frame = raw_times(spark, d).withColumn("source", F.col("event_type"))
    return cleaning.signal_profile(frame, ["source", "timestamp", "text"], NOW)


# --- labels and scores ----------------------------------------------------------------

@query("i1_intent_label", with_views("sig lsig", """ SELECT id, intent_label,
  CASE WHEN intent_label = 'general_discussion' THEN 0.3 ELSE 0.7 END::DOUBLE AS intent_confidence FROM lsig"""))
def _(spark, d):
    return labelled_signals(spark, d).select("id", "intent_label", intent.intent_confidence(F.col("intent_label")).alias("intent_confidence"))


@query("i2_sentiment_label", with_views("sig lsig", " SELECT id, sentiment_label FROM lsig"))
def _(spark, d):
    return labelled_signals(spark, d).select("id", "sentiment_label")


_LEXICON_SQL = """, tok AS (
    SELECT doc_id, pos, w[pos] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS pos FROM
      (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents))),
  lex AS (SELECT * FROM (VALUES ('the', 0.4), ('and', -0.6), ('that', 1.1), ('of', -1.9), ('on', 2.3)) v(word, valence)),
  hit AS (SELECT t.doc_id, t.pos, l.valence, lag(t.word, 1) OVER w AS w1, lag(t.word, 2) OVER w AS w2, lag(t.word, 3) OVER w AS w3
    FROM tok t LEFT JOIN lex l USING (word) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  val AS (SELECT doc_id, pos, (valence + sign(valence) * (
      CASE WHEN w1 IN ('in') THEN 0.293 ELSE 0 END + CASE WHEN w2 IN ('in') THEN 0.293 * 0.95 ELSE 0 END
      + CASE WHEN w3 IN ('in') THEN 0.293 * 0.9 ELSE 0 END))
      * CASE WHEN 'it' IN (w1, w2, w3) THEN -0.74 ELSE 1 END AS v FROM hit WHERE valence IS NOT NULL),
  tot AS (SELECT d.doc_id, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(n, 0) AS n, words - coalesce(c, 0) AS z
    FROM (SELECT doc_id, count(*) AS words FROM tok GROUP BY 1) d LEFT JOIN
    (SELECT doc_id, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS p,
            sum(CASE WHEN v < 0 THEN v - 1 ELSE 0 END) AS n, count(*) AS c FROM val GROUP BY 1) USING (doc_id))"""


@query("i3_lexicon_sentiment", _LEXICON_SQL.replace(", tok", "WITH tok", 1) + f""" SELECT doc_id, {rsql('s / sqrt(s * s + 15)', 4)} AS compound,
  {rsql('p / (p - n + z)', 3)} AS pos, {rsql('-n / (p - n + z)', 3)} AS neg, {rsql('z / (p - n + z)', 3)} AS neu FROM tot""")
def _(spark, d):
    docs = table(spark, d, "documents")
    words = spark.createDataFrame([("the", 0.4), ("and", -0.6), ("that", 1.1), ("of", -1.9), ("on", 2.3)], "word string, valence double")
    scored = lexicon.lexicon_sentiment(docs, "doc_id", "text", words, negations=["it"], boosters={"in": 0.293})
    return scored.select("doc_id", rnd("compound", 4).alias("compound"), rnd("pos", 3).alias("pos"),
                         rnd("neg", 3).alias("neg"), rnd("neu", 3).alias("neu"))


_MARK = "!-/:-@\\[-`{-~"
_BOOST = {"the": 0.293, "de": -0.293, "der": 0.293}
_NEGATE = ("of", "la", "und")


def _boost_sql(back: int) -> str:
    """Strength of the word before, signed by the valence, louder in capitals."""
    cases = " ".join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in _BOOST.items())
    b = f"(CASE w{back} {cases} ELSE 0 END)"
    return f"((CASE WHEN v < 0 THEN -1 ELSE 1 END) * {b} + CASE WHEN {b} <> 0 AND u{back} AND caps THEN CASE WHEN v > 0 THEN 0.733::DOUBLE ELSE -0.733 END ELSE 0 END)"


def _step_sql(back: int) -> str:
    """The valence after the word ``back`` places before."""
    damp = (1.0, 0.95, 0.9)[back - 1]
    between = [f"w{k}" for k in range(1, back)]
    never = " OR ".join(f"{w} IN ('so', 'this')" for w in between) or "false"
    doubt = " OR ".join(f"{w} = 'doubt'" for w in between) or "false"
    return f"""CASE WHEN w{back} IS NOT NULL AND l{back} IS NULL THEN (v + {damp}::DOUBLE * {_boost_sql(back)}) * CASE WHEN w{back} = 'never' AND coalesce({never}, false) THEN 1.25::DOUBLE
      WHEN w{back} = 'without' AND coalesce({doubt}, false) THEN 1 WHEN w{back} IN {_NEGATE} OR contains(w{back}, 'n''t') THEN -0.74 ELSE 1 END ELSE v END"""


_VALENCE_SQL = f"""WITH tx AS (SELECT doc_id, text, list_transform(list_filter(string_split_regex(text, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+'), lambda w: w <> ''),
    lambda w: CASE WHEN length(regexp_replace(w, '^[{_MARK}]+|[{_MARK}]+$', '', 'g')) <= 2 THEN w ELSE regexp_replace(w, '^[{_MARK}]+|[{_MARK}]+$', '', 'g') END) AS t FROM documents),
  tk AS (SELECT doc_id, unnest(t) AS tok, unnest(generate_series(1, len(t))) AS pos FROM tx),
  lw AS (SELECT *, lower(tok) AS w, tok = upper(tok) AND tok <> lower(tok) AS u FROM tk),
  lex AS (SELECT w, (ascii(w) + length(w)) % 9 - 4 AS v FROM (SELECT DISTINCT w FROM lw) WHERE length(w) >= 4 AND (ascii(w) + length(w)) % 9 <> 4),
  dc AS (SELECT doc_id, count(*) FILTER (u) > 0 AND count(*) FILTER (u) < count(*) AS caps, min(pos) FILTER (w = 'and') AS but FROM lw GROUP BY 1),
  nb AS (SELECT lw.doc_id, pos, lw.w, u, lex.v::DOUBLE AS l0, caps, but, {", ".join(f"lag(lw.w, {k}) OVER o AS w{k}, lag(u, {k}) OVER o AS u{k}, lag(lex.v, {k}) OVER o AS l{k}" for k in (1, 2, 3))}, lead(lex.v) OVER o AS ahead
    FROM lw LEFT JOIN lex USING (w) JOIN dc USING (doc_id) WINDOW o AS (PARTITION BY lw.doc_id ORDER BY pos)),
  s0 AS (SELECT *, CASE WHEN coalesce(w1 = 'no', false) OR coalesce(w2 = 'no', false) OR coalesce(w3 = 'no' AND w1 IN ('or', 'nor'), false) THEN l0 * -0.74::DOUBLE WHEN w = 'no' AND ahead IS NOT NULL THEN 0 ELSE l0 END AS v FROM nb),
  s1 AS (SELECT * REPLACE (CASE WHEN u AND caps THEN v + CASE WHEN v > 0 THEN 0.733::DOUBLE ELSE -0.733 END ELSE v END AS v) FROM s0),
  s2 AS (SELECT * REPLACE ({_step_sql(1)} AS v) FROM s1), s3 AS (SELECT * REPLACE ({_step_sql(2)} AS v) FROM s2), s4 AS (SELECT * REPLACE ({_step_sql(3)} AS v) FROM s3),
  s5 AS (SELECT doc_id, pos, CASE WHEN l0 IS NULL OR w IN {tuple(_BOOST)} THEN 0 ELSE v * CASE WHEN w1 = 'least' AND l1 IS NULL AND NOT coalesce(w2 IN ('at', 'very'), false) THEN -0.74::DOUBLE ELSE 1 END
    * CASE WHEN but IS NULL OR pos = but THEN 1 WHEN pos < but THEN 0.5::DOUBLE ELSE 1.5 END END AS x FROM s4),
  sm AS (SELECT doc_id, sum(x) AS s, coalesce(sum(x + 1) FILTER (x > 0), 0) AS p, coalesce(sum(x - 1) FILTER (x < 0), 0) AS n, count(*) FILTER (x = 0) AS z FROM s5 GROUP BY 1),
  mk AS (SELECT doc_id, least(length(text) - length(replace(text, '!', '')), 4) * 0.292::DOUBLE + CASE WHEN q <= 1 THEN 0 WHEN q <= 3 THEN q * 0.18::DOUBLE ELSE 0.96 END AS m
    FROM (SELECT doc_id, text, length(text) - length(replace(text, '?', '')) AS q FROM tx)),
  fs AS (SELECT doc_id, coalesce(z, 0) AS z, coalesce(CASE WHEN s > 0 THEN s + m WHEN s < 0 THEN s - m ELSE 0 END, 0) AS s, coalesce(CASE WHEN p > -n THEN p + m ELSE p END, 0) AS p, coalesce(CASE WHEN p < -n THEN n - m ELSE n END, 0) AS n FROM mk LEFT JOIN sm USING (doc_id))"""


@query("i3_valence_scores", _VALENCE_SQL + f""" SELECT doc_id, {rsql('s / sqrt(s * s + 15)', 4)} AS compound, {rsql('CASE WHEN p - n + z > 0 THEN p / (p - n + z) ELSE 0 END', 3)} AS pos,
  {rsql('CASE WHEN p - n + z > 0 THEN -n / (p - n + z) ELSE 0 END', 3)} AS neg, {rsql('CASE WHEN p - n + z > 0 THEN z / (p - n + z) ELSE 0 END', 3)} AS neu FROM fs""")
def _(spark, d):
    docs = table(spark, d, "documents")
    # A word list as large as the vocabulary, made from it: longer words get a valence by a rule.
    words = docs.select(F.explode(F.transform(lexicon.tokens_of(F.col("text")), F.lower)).alias("word")).distinct()
    valence = (F.ascii("word") + F.length("word")) % 9 - 4
    words = words.where((F.length("word") >= 4) & (valence != 0)).withColumn("valence", valence)
    out = lexicon.valence_scores(docs, "doc_id", "text", words, _NEGATE, _BOOST, contrast="and")
    return out.select("doc_id", rnd("compound", 4).alias("compound"), *[rnd(c, 3).alias(c) for c in ("pos", "neg", "neu")])


@query("i10_demand_score", with_views("sig lsig ssig", f""" SELECT id, {rsql('intent_weight')} AS intent_weight,
  {rsql('sentiment_weight')} AS sentiment_weight, {rsql('engagement_weight')} AS engagement_weight,
  {rsql('demand_score')} AS demand_score, risk_score, activation_score FROM ssig"""))
def _(spark, d):
    return scored_signals(spark, d).select("id", rnd("intent_weight").alias("intent_weight"), rnd("sentiment_weight").alias("sentiment_weight"),
                                           rnd("engagement_weight").alias("engagement_weight"), rnd("demand_score").alias("demand_score"),
                                           "risk_score", "activation_score")


@query("c3_weight_lookup", with_views("sig lsig ssig", f" SELECT intent_label, sentiment_label, count(*) AS n, {rsql('sum(intent_weight + sentiment_weight)')} AS weight FROM ssig GROUP BY 1, 2"))
def _(spark, d):
    w = scoring.weight(F.col("intent_label"), scoring.INTENT_WEIGHTS) + scoring.weight(F.col("sentiment_label"), scoring.SENTIMENT_WEIGHTS)
    return labelled_signals(spark, d).groupBy("intent_label", "sentiment_label").agg(F.count("*").alias("n"), rnd(F.sum(w)).alias("weight"))


PARENT_SQL = f""", par AS (SELECT parent_id, count(*) AS total_signals, {rsql('avg(demand_score)')} AS mean_demand_score,
    CAST(sum(risk_score) AS BIGINT) AS total_risk_score, CAST(sum(activation_score) AS BIGINT) AS total_activation_score,
    {rsql("avg(CASE WHEN sentiment_label = 'positive' THEN 1.0 ELSE 0.0 END)")} AS positive_share,
    {rsql("avg(CASE WHEN sentiment_label = 'negative' THEN 1.0 ELSE 0.0 END)")} AS negative_share FROM ssig0 GROUP BY 1),
  dom AS (SELECT parent_id, intent_label AS dominant_intent FROM (
    SELECT parent_id, intent_label, row_number() OVER (PARTITION BY parent_id ORDER BY count(*) DESC, intent_label) AS rn
    FROM ssig0 GROUP BY 1, 2) WHERE rn = 1),
  ps AS (SELECT par.*, dominant_intent FROM par JOIN dom ON par.parent_id IS NOT DISTINCT FROM dom.parent_id)"""
SSIG0 = ", ssig0 AS (SELECT * REPLACE (CASE WHEN k = 7 THEN NULL ELSE parent_id END AS parent_id) FROM ssig)"


def parent_table(spark, d):
    scored = scored_signals(spark, d).withColumn("parent_id", F.when(F.col("k") != 7, F.col("parent_id")))
    out = scores.parent_scores(scored)
    return out.withColumns({c: rnd(c) for c in ("mean_demand_score", "positive_share", "negative_share")})


@query("d1_parent_scores", with_views("sig lsig ssig", SSIG0 + PARENT_SQL + " SELECT * FROM ps"))
def _(spark, d):
    return parent_table(spark, d)


@query("d2_dominant_label", with_views("sig lsig", """ SELECT source, intent_label AS dominant FROM (SELECT source, intent_label,
  row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, intent_label) AS rn FROM lsig GROUP BY 1, 2) WHERE rn = 1"""))
def _(spark, d):
    return scores.dominant_label(labelled_signals(spark, d), ["source"], "intent_label", "dominant")


@query("f2_top_parents", with_views("sig lsig ssig", SSIG0 + PARENT_SQL + " SELECT parent_id, mean_demand_score FROM ps WHERE parent_id IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 15"))
def _(spark, d):
    named = parent_table(spark, d).filter(F.col("parent_id").isNotNull())
    return scores.top_rows(named, "mean_demand_score", "parent_id", 15).select("parent_id", "mean_demand_score")


@query("f3_parent_ranking", with_views("sig lsig ssig", SSIG0 + PARENT_SQL + " SELECT * FROM ps ORDER BY mean_demand_score DESC, parent_id"))
def _(spark, d):
    return parent_table(spark, d).orderBy(F.desc("mean_demand_score"), "parent_id")


@query("f1_top_demand_rows", with_views("sig lsig ssig", " SELECT id, round(demand_score, 6) + 0.0 AS demand_score FROM ssig ORDER BY 2 DESC, 1 LIMIT 25"))
def _(spark, d):
    return scores.top_rows(scored_signals(spark, d).withColumn("demand_score", rnd("demand_score")), "demand_score", "id", 25).select("id", "demand_score")


@query("f1_top_risk_rows", with_views("sig lsig ssig", " SELECT id, round(demand_score, 6) + 0.0 AS demand_score FROM ssig WHERE risk_score > 0 ORDER BY 2 DESC, 1 LIMIT 25"))
def _(spark, d):
    return scores.top_risk_rows(scored_signals(spark, d).withColumn("demand_score", rnd("demand_score")), "id").select("id", "demand_score")


@query("b18_class_filter", with_views("sig lsig", " SELECT id FROM lsig WHERE intent_label IN ('frustrated_demand','confusion_barrier','content_drought_fatigue','expectation_decay')"))
def _(spark, d):
    return cleaning.filter_values(labelled_signals(spark, d), {"intent_label": scoring.RISK_INTENTS}).select("id")


@query("f4_top_engagement", with_views("sig", " SELECT id, engagement FROM sig ORDER BY engagement DESC, id LIMIT 50"))
def _(spark, d):
    return scores.top_rows(signals(spark, d), "engagement", "id", 50).select("id", "engagement")


@query("d11_headline", with_views("sig lsig ssig", f""" SELECT count(*) AS total_signals,
  {rsql("avg(CASE WHEN sentiment_label = 'positive' THEN 1.0 ELSE 0.0 END)")} AS positive_share,
  {rsql("avg(CASE WHEN sentiment_label = 'negative' THEN 1.0 ELSE 0.0 END)")} AS negative_share,
  CAST(sum(activation_score) AS BIGINT) AS activation_signals, CAST(sum(risk_score) AS BIGINT) AS risk_signals FROM ssig"""))
def _(spark, d):
    return scores.headline(scored_signals(spark, d)).withColumns({c: rnd(c) for c in ("positive_share", "negative_share")})


@query("d12_value_counts", with_views("sig lsig", " SELECT intent_label, count(*) AS n FROM lsig GROUP BY 1 ORDER BY 2 DESC, 1"))
def _(spark, d):
    return scores.value_counts(labelled_signals(spark, d), "intent_label").orderBy(F.desc("n"), "intent_label")


@query("d62_sentiment_vs_intent", with_views("sig lsig", """ SELECT count(*) FILTER (sentiment_label = 'positive') AS positive,
  count(*) FILTER (sentiment_label = 'positive' AND intent_label = 'general_discussion') AS positive_general,
  count(*) FILTER (sentiment_label = 'negative') AS negative,
  count(*) FILTER (sentiment_label = 'negative' AND intent_label <> 'general_discussion') AS negative_actionable FROM lsig"""))
def _(spark, d):
    return scores.sentiment_vs_intent(labelled_signals(spark, d))


# --- announcement calendar ---------------------------------------------------------------

ANNOT_SQL = """, ann AS (SELECT s.*, coalesce(c.event_name, 'pre_announcement') AS last_event_name,
    coalesce(c.event_window, 'pre_announcement') AS window_name, c.event_date
  FROM ssig s ASOF LEFT JOIN (SELECT event_date, event_name, event_window FROM cal) c ON s.timestamp >= c.event_date)"""


def annotated(spark, d):
    return cal_ops.annotate_events(scored_signals(spark, d), calendar(spark))


# Every order as a calendar row: dates of open orders do not parse, kinds come in mixed case, some announcements are missing.
_ORDER_EVENTS = {"1-URGENT": "Trailer", "2-HIGH": " showcase ", "3-MEDIUM": "patch", "4-NOT SPECIFIED": "release_date"}


@query("a10_event_calendar", f"""WITH raw AS (SELECT o_orderkey, o_orderdate, 'Order: ' || o_orderpriority || '!' AS event_name, lower(o_orderpriority) AS p,
    CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 30 AS INTEGER) ELSE CAST(o_orderdate AS DATE) END AS announced FROM orders WHERE o_orderstatus <> 'O')
  SELECT o_orderkey, {ssql('CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)')} AS event_date, event_name, 'post_order_' || trim(regexp_replace(p, '[^a-z0-9]+', '_', 'g'), '_') AS event_window,
    CAST(p IN ('1-urgent', '2-high', '4-not specified') AS INTEGER) AS major_announcement_flag, CAST(p IN ('1-urgent', '2-high') AS INTEGER) AS trailer_flag,
    {ssql('CAST(announced AS TIMESTAMP)')} AS announced_date FROM raw""")
def _(spark, d):
    day, priority = F.col("o_orderdate").cast("date"), F.col("o_orderpriority")
    kind = F.lit(None).cast("string")
    for value, name in _ORDER_EVENTS.items():
        kind = F.when(priority == value, name).otherwise(kind)
    raw = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "O", "not yet").otherwise(day.cast("string")).alias("event_date"),
        F.concat(F.lit("Order: "), priority, F.lit("!")).alias("event_name"), kind.alias("event_type"),
        F.when(F.col("o_orderkey") % 7 > 0, F.date_sub(day, (F.col("o_orderkey") % 30).cast("int")).cast("string")).alias("announced_date"))
    out = cal_ops.prepare_calendar(raw)
    return out.select("o_orderkey", stamp("event_date").alias("event_date"), "event_name", "event_window", "major_announcement_flag",
                      "trailer_flag", stamp("announced_date").alias("announced_date"))


@query("c1_asof_events", with_views("sig lsig ssig cal", ANNOT_SQL + f""" SELECT id, last_event_name, window_name AS event_window,
  {rsql("(epoch_us(timestamp) - epoch_us(event_date)) / 8.64e10")} AS days_since_event FROM ann"""))
def _(spark, d):
    return annotated(spark, d).select("id", "last_event_name", "event_window", rnd("days_since_event").alias("days_since_event"))


_WINDOW_SQL = ANNOT_SQL + f""", sumw AS (SELECT window_name AS event_window, count(*) AS n_comments,
    avg(CASE WHEN sentiment_label = 'positive' THEN 1.0 ELSE 0.0 END) AS positive_share,
    avg(CASE WHEN sentiment_label = 'negative' THEN 1.0 ELSE 0.0 END) AS negative_share, avg(vader_compound) AS mvc,
    avg(demand_score) AS mds, min(timestamp) AS seen FROM ann GROUP BY 1),
  ordw2 AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN event_window = 'pre_announcement' THEN 0 ELSE 1 END, seen, event_window) AS wo FROM sumw)"""


@query("d3_event_windows", with_views("sig lsig ssig cal", _WINDOW_SQL + f""" SELECT event_window, n_comments, {rsql('positive_share')} AS positive_share,
  {rsql('negative_share')} AS negative_share, {rsql('mvc')} AS mean_vader_compound, {rsql('mds')} AS mean_demand_score, CAST(wo AS INTEGER) AS window_order FROM ordw2"""))
def _(spark, d):
    out = cal_ops.event_window_summary(annotated(spark, d))
    return out.select("event_window", "n_comments", *[rnd(c).alias(c) for c in (
        "positive_share", "negative_share", "mean_vader_compound", "mean_demand_score")], "window_order")


@query("e3_event_deltas", with_views("sig lsig ssig cal", _WINDOW_SQL + f" SELECT event_window, {rsql('mvc - lag(mvc) OVER (ORDER BY wo)')} AS delta_vs_prev_window FROM ordw2"))
def _(spark, d):
    return cal_ops.event_window_deltas(annotated(spark, d)).select("event_window", rnd("delta_vs_prev_window").alias("delta_vs_prev_window"))


# --- text expressions ----------------------------------------------------------------------

@query("i4_slug", r"""SELECT p_partkey, 'x_' || coalesce(nullif(trim(regexp_replace(lower(p_brand || ' - ' || p_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'event') AS slug FROM part""")
def _(spark, d):
    name = F.concat("p_brand", F.lit(" - "), "p_name")
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("x_"), text.slug(name)).alias("slug"))


_LINK = """CASE WHEN k % 4 = 0 THEN 'https://www.youtube.com/watch?v=vid_' || (10000 + user_id) || '&lc=' || event_id
   WHEN k % 4 = 1 THEN 'https://reddit.com/r/x/comments/t' || user_id || '/title/' WHEN k % 4 = 2 THEN 'https://forum.example/' || user_id ELSE NULL END"""


@query("i5_group_from_permalink", with_views("ev", f""" SELECT event_id, CASE WHEN k % 4 = 0 THEN 'yt:vid_' || (10000 + user_id)
  WHEN k % 4 = 1 THEN 'rd:t' || user_id END AS group_id FROM ev"""))
def _(spark, d):
    return events(spark, d).withColumn("link", F.expr(_LINK)).select(
        "event_id", text.group_from_permalink(F.col("link"), F.lit("other")).alias("group_id"))


@query("i25_permalinks", with_views("ev", """ SELECT event_id, 'https://www.youtube.com/watch?v=v' || user_id || '&lc=' || event_id AS video,
  CASE WHEN k < 10 THEN '' WHEN k < 20 THEN 'https://x.example/a' ELSE 'https://reddit.com/r/' || user_id END AS thread FROM ev"""))
def _(spark, d):
    link = F.when(F.col("k") < 10, "").when(F.col("k") < 20, "https://x.example/a").otherwise(F.concat(F.lit("/r/"), "user_id"))
    return events(spark, d).select(
        "event_id", text.video_permalink(F.concat(F.lit("v"), "user_id"), F.col("event_id").cast("string")).alias("video"),
        text.thread_permalink(link).alias("thread"))


@query("i6_actionable", with_views("sig lsig", " SELECT id, CASE WHEN k < 3 THEN NULL ELSE intent_label <> 'general_discussion' END AS actionable FROM lsig"))
def _(spark, d):
    label = F.when(F.col("k") < 3, "no such label").otherwise(F.col("intent_label"))
    return labelled_signals(spark, d).select("id", intent.is_actionable(label).alias("actionable"))


@query("i7_text_key", f"SELECT doc_id, md5({TEXT_KEY_SQL.format('text')}) AS key_md5 FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.text_key(F.col("text"))).alias("key_md5"))


@query("i8_text_id", f"SELECT doc_id, substr(sha1({TEXT_KEY_SQL.format('text')}), 1, 12) AS text_id FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.text_id(F.col("text")).alias("text_id"))


@query("i9_pool_group_key", with_views("ev", """ SELECT event_id, CASE WHEN k < 10 THEN NULL WHEN k < 20 THEN 'yt:' || user_id
  WHEN k % 3 = 0 THEN 'yt:' || user_id WHEN k % 3 = 1 THEN 'rd:' || user_id ELSE CAST(user_id AS VARCHAR) END AS group_key FROM ev"""))
def _(spark, d):
    k, user = F.col("k"), F.col("user_id").cast("string")
    parent = F.when((k >= 10) & (k < 20), F.concat(F.lit("yt:"), user)).when(k >= 20, user)
    source = F.when(k % 3 == 0, "youtube").when(k % 3 == 1, "reddit").otherwise("forum")
    return events(spark, d).select("event_id", text.pool_group_key(parent, source).alias("group_key"))


@query("i15_length_bucket", with_views("sig", r""" , w AS (SELECT id, len(string_split(trim(regexp_replace(substr(text, greatest(1, length(text) - k)),
    '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')), ' ')) AS n FROM sig)
  SELECT id, CASE WHEN n <= 8 THEN 'short (<=8 words)' WHEN n <= 25 THEN 'medium (9-25 words)' ELSE 'long (>25 words)' END AS bucket FROM w"""))
def _(spark, d):
    tail = F.expr("substr(text, cast(greatest(1, length(text) - k) as int))")
    return signals(spark, d).select("id", text.length_bucket(tail).alias("bucket"))


@query("i16_wilson", with_views("ev", f""", g AS (SELECT user_id, count(*)::DOUBLE AS n, sum(y) / count(*)::DOUBLE AS p FROM ev GROUP BY 1)
  SELECT user_id, {rsql('(p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)')} AS low,
  {rsql('(p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)')} AS high FROM g"""))
def _(spark, d):
    low, high = scoring.wilson(F.sum("y"), F.count("*"))
    return events(spark, d).groupBy("user_id").agg(rnd(low).alias("low"), rnd(high).alias("high"))


@query("i18_hill", f"SELECT l_orderkey, l_linenumber, {rsql('pow(l_quantity, 1.4) / (pow(l_quantity, 1.4) + pow(20.0, 1.4))')} AS response FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rnd(scoring.hill(F.col("l_quantity"), F.lit(1.4), F.lit(20.0))).alias("response"))


@query("i24_null_safe_rate", with_views("ev", f" SELECT user_id, {rsql('CASE WHEN count(*) FILTER (k < 3) > 0 THEN count(*) FILTER (k < 2) / (count(*) FILTER (k < 3))::DOUBLE END')} AS rate FROM ev GROUP BY 1"))
def _(spark, d):
    return events(spark, d).groupBy("user_id").agg(rnd(scoring.rate(F.count_if(F.col("k") < 2), F.count_if(F.col("k") < 3))).alias("rate"))



