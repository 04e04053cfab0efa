from datetime import datetime, timedelta

from pulseframe.operators import weekly
from pulseframe.streaming import jobs

SCHEMA = ("timestamp timestamp, source string, intent_label string, actionable_probability double, probability_source string, "
          "vader_compound double, demand_score double")
START = datetime(2024, 1, 1)


def rows(days, kind="high_intent"):
    return [(START + timedelta(days=d, hours=5), "youtube" if d % 2 else "reddit", kind, None if d % 5 == 0 else 0.25, "oof", d / 100.0, 1.0) for d in days]


def arrive(spark, folder, name, days):
    spark.createDataFrame(rows(days), SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def values(df):
    return sorted((str(r["period_start"]), r["total_comments"], r["actionable_count"], round(r["actionable_probability_mass"], 9), round(r["mean_sentiment"], 9)) for r in df.collect())


def test_late_rows_are_kept_and_a_run_goes_on_from_its_checkpoint(spark, tmp_path):
    folder, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
        jobs.run_weekly(stream, out, mark)

    arrive(spark, folder, "a", range(0, 10))
    run()
    assert jobs.late_rows(spark, out).count() == 0
    arrive(spark, folder, "b", range(20, 40))
    run()  # a second query from the same checkpoint
    arrive(spark, folder, "c", [1, 2, 3, 33, 41])
    run()
    run()  # nothing new
    late = jobs.late_rows(spark, out)
    assert late.count() == 3 and late.agg({"timestamp": "max"}).first()[0] == START + timedelta(days=3, hours=5)
    table = {str(r["period_start"])[:10]: (r["total_comments"], r["late_rows"]) for r in jobs.weekly_table(spark, out).collect()}
    assert table["2024-01-01"] == (7, 3)
    every = spark.createDataFrame(rows([*range(0, 10), *range(20, 40), 1, 2, 3, 33, 41]), SCHEMA)
    batch = weekly.aggregate_periods(every)
    assert values(jobs.weekly_table(spark, out, with_late=True)) == values(batch.where("total_comments > 0"))


def test_a_repeated_batch_leaves_no_second_copy(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, folder, "a", range(0, 30))
    for mark in ("first", "again"):  # the same batch numbers run twice
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
        jobs.run_weekly(stream, out, str(tmp_path / mark))
    assert sum(r["total_comments"] for r in jobs.weekly_table(spark, out).collect()) == 30


def test_parts_add_up_to_the_batch_columns(spark):
    every = spark.createDataFrame(rows(range(0, 45)), SCHEMA)
    parts = weekly.partial_periods(every.where("dayofmonth(timestamp) % 2 = 0")).unionByName(weekly.partial_periods(every.where("dayofmonth(timestamp) % 2 = 1")))
    merged, batch = weekly.merged_periods(parts), weekly.aggregate_periods(every)
    assert set(merged.columns) == set(batch.columns)
    order = sorted(batch.columns)
    digits = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted(map(digits, merged.select(order).collect()), key=str) == sorted(map(digits, batch.select(order).collect()), key=str)
