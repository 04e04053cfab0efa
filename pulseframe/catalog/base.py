"""Query registry, the shared views over the test tables and their SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions import intent, timing
from pulseframe.operators import backtest as bt_ops
from pulseframe.operators import calendar as cal_ops
from pulseframe.operators import scores, series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory id; ``sql`` is the DuckDB equivalent."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def with_views(names: str, body: str) -> str:
    """SQL text: the named shared views as CTEs, then ``body`` (``, more AS (...) SELECT`` or ``SELECT``)."""
    return "WITH " + ",\n".join(VIEW_SQL[n] for n in names.split()) + "\n" + body


def rnd(column: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero, so that both engines print the same."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def rsql(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def stamp(column: Column | str) -> Column:
    """Timestamp as text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def ssql(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- shared views ---------------------------------------------------------------

#: Comment phrases by event type and score, so that the label rules have something to find.
_PHRASE = """CASE
    WHEN event_type = 'purchase' AND k < 50 THEN 'I bought it on day one'
    WHEN event_type = 'purchase' THEN 'Would play again'
    WHEN event_type = 'signup' AND k < 50 THEN 'I never played before'
    WHEN event_type = 'signup' THEN 'Is this a good entry point?'
    WHEN event_type = 'error' AND k < 30 THEN 'This is so confusing'
    WHEN event_type = 'error' AND k < 60 THEN 'Still waiting, no news'
    WHEN event_type = 'error' THEN 'I lost interest'
    WHEN event_type = 'click' AND k < 40 THEN 'I remember playing it'
    WHEN event_type = 'click' AND k < 50 THEN 'So much copium here'
    ELSE 'Nice one' END"""

CALENDAR_ROWS = [
    ("2024-01-08", "Launch Trailer", "trailer", "2024-01-08"),
    ("2024-01-17", "Patch Notes", "patch", "2024-01-12"),
    ("2024-01-24", "Winter Showcase", "showcase", "2024-01-24"),
]
ORDER_CALENDAR_ROWS = [
    ("1996-03-01", "First Showcase", "showcase", "1996-02-01"),
    ("1997-06-15", "Spring Patch", "patch", "1997-06-15"),
    ("1998-11-20", "Big Release", "release", "1998-08-01"),
    ("2000-02-29", "Leap Trailer", "trailer", "2000-03-10"),
]


def events(spark, d) -> DataFrame:
    return (
        table(spark, d, "events")
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
        .withColumn("y", F.col("event_type").isin("purchase", "signup").cast("int"))
        .withColumn("p", F.col("k") / F.lit(100.0))
    )


def signals(spark, d) -> DataFrame:
    """Comments: every document with the event and labels of its id."""
    docs = table(spark, d, "documents")
    ev = events(spark, d).withColumn("phrase", F.expr(_PHRASE))
    labels = table(spark, d, "labels")
    return (
        docs.join(ev, docs.doc_id == ev.event_id)
        .join(labels, "doc_id", "left")
        .select(
            "source",
            F.lit("comment").alias("record_type"),
            F.col("doc_id").cast("string").alias("id"),
            F.concat("text", F.lit(" "), "phrase").alias("text"),
            F.expr("ts + make_dt_interval(cast(k % 25 AS int))").alias("timestamp"),
            F.round("value").cast("bigint").alias("engagement"),
            F.col("user_id").cast("string").alias("parent_id"),
            F.col("props").alias("metadata"),
            "doc_id",
            "lang",
            "quality",
            "toxic",
            "event_type",
            "k",
            ((F.col("k") - 50) / F.lit(50.0)).alias("vader_compound"),
            (F.col("k") / F.lit(100.0)).alias("actionable_probability"),
            F.when(F.col("toxic") == 1, "unavailable")
            .when(F.col("quality").isNotNull(), "oof_supervised")
            .otherwise("persisted_supervised")
            .alias("probability_source"),
        )
    )


def labelled_signals(spark, d) -> DataFrame:
    """Signals with rule label and sentiment label."""
    return signals(spark, d).withColumns(
        {
            "intent_label": intent.intent_label(F.col("text")),
            "sentiment_label": intent.sentiment_label(F.col("vader_compound")),
        }
    )


def scored_signals(spark, d) -> DataFrame:
    return scores.score_signals(labelled_signals(spark, d))


def calendar(spark, rows=CALENDAR_ROWS) -> DataFrame:
    raw = spark.createDataFrame(rows, "event_date string, event_name string, event_type string, announced_date string")
    return cal_ops.prepare_calendar(raw)


def order_weeks(spark, d) -> DataFrame:
    """Gap-free weekly order counts and values per priority."""
    orders = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("series_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        "o_totalprice",
    )
    weekly = (
        orders.withColumn("period_start", timing.period_start(F.col("ts")))
        .groupBy("series_id", "period_start")
        .agg(
            F.count("*").alias("total_comments"),
            F.round(F.sum("o_totalprice") / 1000.0, 3).alias("value"),
        )
    )
    filled = series.fill_spine(
        weekly, ["series_id"], "period_start", zero_cols=["total_comments", "value"]
    )
    return series.with_period_index(filled, ["series_id"], "period_start", "idx")


def backtest_rows(spark, d) -> DataFrame:
    return bt_ops.backtest(
        order_weeks(spark, d),
        ["series_id"],
        "period_start",
        "value",
        models=("naive", "mean", "seasonal_naive"),
        min_train=60,
    )


def labelled_docs(spark, d) -> DataFrame:
    """Labelled corpus: quality and toxic mapped into the taxonomy as two annotators."""
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("record_id"),
        "text",
        F.when(F.col("quality") == 1, "high_intent").otherwise("general_discussion").alias("label_a"),
        F.when(F.col("toxic") == 1, "general_discussion")
        .when(F.col("doc_id") % 5 == 0, "confusion_barrier")
        .otherwise("high_intent")
        .alias("label_b"),
        F.col("source").alias("parent_id"),
        F.col("lang").alias("sample_strategy"),
        "doc_id",
        "quality",
        "toxic",
    )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


def _calendar_sql(name: str, rows) -> str:
    return f"""{name} AS (
  SELECT CAST(column0 AS TIMESTAMP) AS event_date, column1 AS event_name, column2 AS event_type,
         CAST(column3 AS TIMESTAMP) AS announced_date,
         'post_' || trim(regexp_replace(lower(column1), '[^a-z0-9]+', '_', 'g'), '_') AS event_window,
         CAST(column2 IN ('trailer','announcement','showcase','release_date','release') AS INTEGER) AS major_announcement_flag,
         CAST(column2 IN ('trailer','showcase') AS INTEGER) AS trailer_flag
  FROM (VALUES {_values(rows)}) v(column0, column1, column2, column3))"""


def intent_sql(text: str) -> tuple[str, str]:
    """Rules for an engine whose word boundary only knows ASCII: other letters become ``_`` first."""
    folded = f"trim(replace(replace(replace(lower({text}), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's'))"
    plain = (
        rf"regexp_replace(regexp_replace({folded}, '[^\x00-\x7f\p{{L}}\p{{N}}]', ' ', 'g'), "
        r"'[^\x00-\x7f]', '_', 'g')"
    )
    cases = "\n".join(
        "    WHEN regexp_matches(plain, '" + "|".join(patterns).replace("'", "''") + f"') THEN '{label}'"
        for label, patterns in intent.RULES
    )
    return plain, f"CASE\n{cases}\n    ELSE 'general_discussion' END"


SENTIMENT_SQL = """CASE WHEN vader_compound >= 0.05 THEN 'positive'
    WHEN vader_compound <= -0.05 THEN 'negative' ELSE 'neutral' END"""

INTENT_WEIGHT_SQL = """CASE intent_label WHEN 'high_intent' THEN 2.0 WHEN 'nostalgia_reactivation' THEN 1.5
    WHEN 'new_customer_interest' THEN 1.2 WHEN 'frustrated_demand' THEN 1.0
    WHEN 'content_drought_fatigue' THEN 0.6 WHEN 'confusion_barrier' THEN -1.0
    WHEN 'expectation_decay' THEN -1.5 WHEN 'general_discussion' THEN 0.1 ELSE 0.0 END::DOUBLE"""
SENTIMENT_WEIGHT_SQL = """CASE sentiment_label WHEN 'positive' THEN 1.0 WHEN 'neutral' THEN 0.3
    WHEN 'negative' THEN -0.5 ELSE 0.0 END::DOUBLE"""

TEXT_KEY_SQL = (
    "replace(replace(replace(lower(trim(regexp_replace({0}, "
    r"'[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')"
)

_ORD_AGG = """SELECT o_orderpriority AS series_id, date_trunc('week', o_orderdate) AS period_start,
         count(*) AS n, round(sum(o_totalprice) / 1000.0, 3) AS v FROM orders GROUP BY ALL"""

VIEW_SQL = {
    "ev": """ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(event_type IN ('purchase', 'signup') AS INTEGER) AS y,
         CAST(json_extract_string(props, '$.k') AS BIGINT) / 100.0::DOUBLE AS p FROM events)""",
    "sig": f"""sig AS (
  SELECT source, 'comment' AS record_type, CAST(doc_id AS VARCHAR) AS id, text || ' ' || phrase AS text,
         ts + to_days(CAST(k % 25 AS INTEGER)) AS "timestamp", CAST(round(value) AS BIGINT) AS engagement, CAST(user_id AS VARCHAR) AS parent_id,
         props AS metadata, doc_id, lang, quality, toxic, event_type, k,
         (k - 50) / 50.0::DOUBLE AS vader_compound, k / 100.0::DOUBLE AS actionable_probability,
         CASE WHEN toxic = 1 THEN 'unavailable' WHEN quality IS NOT NULL THEN 'oof_supervised'
              ELSE 'persisted_supervised' END AS probability_source
  FROM documents d JOIN (SELECT *, {_PHRASE} AS phrase FROM
      (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)) e ON e.event_id = d.doc_id
  LEFT JOIN labels l USING (doc_id))""",
    "lsig": f"""lsig AS MATERIALIZED (
  SELECT * EXCLUDE (plain), {intent_sql('text')[1]} AS intent_label, {SENTIMENT_SQL} AS sentiment_label
  FROM (SELECT *, {intent_sql('text')[0]} AS plain FROM sig))""",
    "ssig": f"""ssig AS (
  SELECT *, {INTENT_WEIGHT_SQL} AS intent_weight, {SENTIMENT_WEIGHT_SQL} AS sentiment_weight,
         ln(1 + greatest(engagement, 0)) AS engagement_weight,
         ({INTENT_WEIGHT_SQL} + {SENTIMENT_WEIGHT_SQL}) * (1 + ln(1 + greatest(engagement, 0)) / 5) AS demand_score,
         CAST(intent_label IN ('frustrated_demand','confusion_barrier','content_drought_fatigue','expectation_decay') AS INTEGER) AS risk_score,
         CAST(intent_label IN ('high_intent','nostalgia_reactivation','new_customer_interest') AS INTEGER) AS activation_score
  FROM lsig)""",
    "cal": _calendar_sql("cal", CALENDAR_ROWS),
    "ocal": _calendar_sql("ocal", ORDER_CALENDAR_ROWS),
    "ordw": f"""ord_agg AS ({_ORD_AGG}),
ord_span AS (SELECT series_id, min(period_start) AS lo, max(period_start) AS hi FROM ord_agg GROUP BY 1),
ord_spine AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS period_start FROM ord_span),
ordw AS (
  SELECT s.series_id, s.period_start, coalesce(a.n, 0) AS total_comments, coalesce(a.v, 0.0) AS value,
         CAST(row_number() OVER (PARTITION BY s.series_id ORDER BY s.period_start) - 1 AS INTEGER) AS idx
  FROM ord_spine s LEFT JOIN ord_agg a USING (series_id, period_start))""",
    "bt": """bt_stats AS (
  SELECT series_id, idx, value, idx + 1 AS origin, count(*) OVER (PARTITION BY series_id) AS n,
         avg(value) OVER w8 AS m8, stddev_pop(value) OVER wx AS sd,
         quantile_cont(nres, 0.1) OVER wx AS nlo, quantile_cont(nres, 0.9) OVER wx AS nhi,
         quantile_cont(value, 0.1) OVER wx AS vlo, quantile_cont(value, 0.9) OVER wx AS vhi,
         quantile_cont(sres, 0.1) OVER wx AS slo, quantile_cont(sres, 0.9) OVER wx AS shi,
         count(sres) OVER wx AS ns
  FROM (SELECT *, value - lag(value) OVER w AS nres, value - lag(value, 52) OVER w AS sres FROM ordw
        WINDOW w AS (PARTITION BY series_id ORDER BY idx))
  WINDOW wx AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         w8 AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
bt_orig AS (SELECT * FROM bt_stats WHERE origin >= 60 AND (origin - 60) % 2 = 0 AND origin + 2 <= n),
bt_raw AS (
  SELECT series_id, 'naive' AS model, origin, h, value AS forecast, nlo AS lo, nhi AS hi FROM bt_orig, (VALUES (1), (2)) s(h)
  UNION ALL
  SELECT series_id, 'mean', origin, h, m8, vlo - m8, vhi - m8 FROM bt_orig, (VALUES (1), (2)) s(h)
  UNION ALL
  SELECT b.series_id, 'seasonal_naive', b.origin, h, o.value, CASE WHEN ns >= 2 THEN slo ELSE -sd END,
         CASE WHEN ns >= 2 THEN shi ELSE sd END
  FROM bt_orig b, (VALUES (1), (2)) s(h), ordw o
  WHERE o.series_id = b.series_id AND o.idx = b.origin - 1 + h - 52 AND b.n >= 104),
bt AS (
  SELECT r.series_id, model, CAST(origin AS INTEGER) AS origin, CAST(h AS INTEGER) AS horizon_step,
         CAST(origin + h - 1 AS INTEGER) AS period_index, o.value AS actual, forecast,
         greatest(least(forecast + lo * sqrt(h), forecast), 0.0) AS lower,
         greatest(forecast + hi * sqrt(h), forecast) AS upper
  FROM (SELECT * REPLACE (greatest(forecast, 0.0) AS forecast) FROM bt_raw) r
  JOIN ordw o ON o.series_id = r.series_id AND o.idx = origin + h - 1)""",
    "lab": """lab AS (
  SELECT CAST(doc_id AS VARCHAR) AS record_id, text,
         CASE WHEN quality = 1 THEN 'high_intent' ELSE 'general_discussion' END AS label_a,
         CASE WHEN toxic = 1 THEN 'general_discussion' WHEN doc_id % 5 = 0 THEN 'confusion_barrier'
              ELSE 'high_intent' END AS label_b,
         source AS parent_id, lang AS sample_strategy, doc_id, quality, toxic
  FROM labels JOIN documents USING (doc_id))""",
}
