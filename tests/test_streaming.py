"""A stream gives what the batch operators give, however the rows are cut into files."""

import random

import pytest
from pyspark.sql import functions as F

from keytempo.operators import pairing
from keytempo.plans.event_queries import with_markers
from keytempo.plans.key_events import down_up
from keytempo.streaming import keys, sinks

from .conftest import rows

SCHEMA = ("user_id string, session_id string, event_type string, timestamp_ms double, "
          "key_token string, is_backspace boolean, is_enter boolean, is_space boolean, "
          "event_id string, raw_id long")


def feed(spark, df, folder, files, shuffle_ms=0):
    """Write rows in time order (disturbed by up to ``shuffle_ms``) into several files."""
    rng = random.Random(1)
    data = [tuple(r) for r in df.select(*[f.split()[0] for f in SCHEMA.split(", ")]).collect()]
    data.sort(key=lambda r: r[3] + rng.random() * shuffle_ms)
    last = max(r[3] for r in data)
    end = ("end", "end", "tick", last + 10_000_000.0, "k_x", False, False, False, None, 1 << 50)
    size = -(-len(data) // files)
    for i in range(0, len(data), size):
        name = f"{folder}/part{i // size:03d}"
        spark.createDataFrame(data[i:i + size], SCHEMA).coalesce(1).write.json(name)
    spark.createDataFrame([end], SCHEMA).coalesce(1).write.json(f"{folder}/part999")


def stream(spark, folder, per_batch=1):
    return keys.read_event_stream(spark, f"{folder}/*", SCHEMA, files_per_batch=per_batch)


def run(df, tmp_path, name="out"):
    sinks.run_to_end(keys.write_stream(
        df, f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint", available_now=True))


@pytest.fixture(scope="module")
def small(spark, sf):
    return down_up(spark, sf).filter("session_id < '2024-01-15'").cache()


def test_pairs_equal_batch_with_disorder(spark, small, tmp_path):
    feed(spark, small, f"{tmp_path}/in", files=4, shuffle_ms=500)
    run(keys.pair_stream(keys.with_event_time(stream(spark, f"{tmp_path}/in"), delay="2 seconds")),
        tmp_path)
    got = spark.read.schema(keys.PAIR_SCHEMA).parquet(f"{tmp_path}/out")
    want = pairing.pair_live(small).select(*got.columns)
    assert rows(got) == rows(want)


def test_one_batch_gives_the_same(spark, small, tmp_path):
    feed(spark, small, f"{tmp_path}/in", files=1)
    run(keys.pair_stream(keys.with_event_time(stream(spark, f"{tmp_path}/in", 16))), tmp_path)
    got = spark.read.schema(keys.PAIR_SCHEMA).parquet(f"{tmp_path}/out")
    assert rows(got) == rows(pairing.pair_live(small).select(*got.columns))


def test_pause_rows_in_the_stream(spark, small, tmp_path):
    raw, marks = with_markers(small)
    control = marks.withColumn("event_type", F.col("marker")).drop("marker")
    feed(spark, raw.unionByName(control), f"{tmp_path}/in", files=3)
    run(keys.pair_stream(keys.with_event_time(stream(spark, f"{tmp_path}/in"))), tmp_path)
    got = spark.read.schema(keys.PAIR_SCHEMA).parquet(f"{tmp_path}/out")
    assert rows(got) == rows(pairing.segment_by_pause(raw, marks).select(*got.columns))


def test_late_rows_are_dropped(spark, small, tmp_path):
    feed(spark, small, f"{tmp_path}/in", files=2)
    late = small.limit(5).select(*[f.split()[0] for f in SCHEMA.split(", ")])
    late.withColumns({"timestamp_ms": F.lit(1.0), "raw_id": F.col("raw_id") + (1 << 40)})\
        .coalesce(1).write.json(f"{tmp_path}/in/part998")
    run(keys.pair_stream(keys.with_event_time(stream(spark, f"{tmp_path}/in"))), tmp_path)
    got = spark.read.schema(keys.PAIR_SCHEMA).parquet(f"{tmp_path}/out")
    assert rows(got) == rows(pairing.pair_live(small).select(*got.columns))


def test_dedup_stream(spark, small, tmp_path):
    again = small.withColumn("event_id", F.lit(None).cast("string"))
    feed(spark, small.unionByName(small).unionByName(again), f"{tmp_path}/in", files=2)
    df = keys.dedup_stream(keys.with_event_time(stream(spark, f"{tmp_path}/in")))
    run(df.select("user_id", "session_id", "event_type", "timestamp_ms", "key_token"), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").filter("event_type <> 'tick'")
    want = pairing.dedup_events(small).select(*got.columns)
    assert rows(got) == rows(want)


def test_sanitize_stream(spark, tmp_path):
    df = spark.createDataFrame(
        [("u", "s", {"type": "down", "timestamp": "5"}), ("u", "s", {"type": "down", "key": "a"})],
        "user_id string, session_id string, payload map<string,string>")
    df.write.json(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).json(f"{tmp_path}/in")
    run(keys.sanitize_stream(source), tmp_path)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.event_type, r.timestamp_ms, r.key_token) for r in got] == [("down", 5.0, "k_other")]


def test_keyed_table_keeps_the_newest_and_skips_repeats(spark, tmp_path):
    table = sinks.KeyedTable(spark, f"{tmp_path}/t", "k string, n long")
    assert table.current()[1].count() == 0
    table.merge(spark.createDataFrame([("a", 1), ("b", 1)], "k string, n long"), 0, ["k"], "n")
    table.merge(spark.createDataFrame([("a", 3), ("a", 2)], "k string, n long"), 1, ["k"], "n")
    table.merge(spark.createDataFrame([("a", 99)], "k string, n long"), 1, ["k"], "n")
    assert rows(table.current()[1]) == [("a", 3), ("b", 1)]


def test_upsert_stream_over_many_batches(spark, small, tmp_path):
    feed(spark, small, f"{tmp_path}/in", files=4)
    totals = stream(spark, f"{tmp_path}/in").filter("event_type <> 'tick'").groupBy(
        "user_id").agg(F.count(F.lit(1)).alias("events"))
    table = sinks.KeyedTable(spark, f"{tmp_path}/t", "user_id string, events long")
    sinks.run_to_end(totals.writeStream.foreachBatch(
        sinks.upsert_sink(table, ["user_id"], "events")).outputMode("update").option(
            "checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start())
    want = small.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    assert rows(table.current()[1]) == rows(want)
