"""A step that many later ones read is computed once."""

from pyspark.sql import functions as F

from keytempo.plans import baseline_queries, stored_queries
from keytempo.plans.catalogue import QUERIES

from .conftest import SF, rows


def counted(spark, df, column):
    """The same rows, and how often a value of ``column`` has been computed."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(count, df.schema[column].dataType)(column)), seen


WEEKS = ("2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29")


def test_grown_table(spark, monkeypatch):
    data = [(f"{u}-{w}", str(u), w, 10 * u + i) for u in range(20) for i, w in enumerate(WEEKS)]
    df = spark.createDataFrame(data, "session_id string, pseudonymized_user_id string, day string, sample_count long").select(
        "session_id", "pseudonymized_user_id", F.to_timestamp("day").alias("created_at"), "sample_count")
    df, seen = counted(spark, df, "sample_count")
    monkeypatch.setattr(stored_queries, "stored_rows", lambda *_: df)
    got = rows(QUERIES["grown_table"](spark, SF).select("session_id", "sample_count"))
    assert got == sorted([(n + 100 * (day >= "2024-01-15"), s) for s, _, day, n in data], key=repr)
    assert seen.value == len(data)


def test_incremental_baselines(spark, monkeypatch):
    data = [(str(u), w, float(10 * u + i)) for u in range(20) for i, w in enumerate(WEEKS)]
    df, seen = counted(spark, spark.createDataFrame(data, "user_id string, session_id string, mean_dwell_time double"), "mean_dwell_time")
    monkeypatch.setattr(stored_queries, "session_table", lambda *_: df)
    got = rows(QUERIES["incremental_baselines"](spark, SF).select("user_id", "sample_count", "median"))
    assert got == sorted([(10.0 * u + 2, 5, str(u)) for u in range(20)], key=repr)
    assert seen.value == len(data)


def test_classifier_scores(spark, monkeypatch):
    made = baseline_queries.vectors(spark, SF).cache()
    df, seen = counted(spark, made, baseline_queries._VECTOR[0])
    monkeypatch.setattr(baseline_queries, "vectors", lambda *_: df)
    assert QUERIES["classifier_scores"](spark, SF).count() == made.count()
    assert seen.value <= 2 * made.count()
    made.unpersist()
