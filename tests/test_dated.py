"""Stored tables by day: retention, erasure with a journal, newest rows; and the two outputs of one stream."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keytempo.sources import dated, tables
from keytempo.streaming import sinks

SCHEMA = "id long, created_at timestamp, artifact_type string, user_id string"
NOW = datetime(2024, 3, 10, 12)


def some_rows(spark):
    out, i = [], 0
    for kind in ("raw_keystrokes", "odd: a/b", None):
        for day in (1, 2, 3, 4, 9):
            for hour in (6, 18):
                out.append((i, datetime(2024, 3, day, hour), kind, f"p{i % 3}"))
                i += 1
    out.append((i, None, "raw_keystrokes", "p0"))
    return spark.createDataFrame(out, SCHEMA)


def files(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet")}


def test_retention_drops_rewrites_and_leaves(spark, tmp_path):
    path = tmp_path / "t"
    dated.store_by_day(some_rows(spark), str(path))
    before = files(path)
    plan = dated.retain(spark, str(path), NOW, dry_run=True).collect()
    assert files(path) == before
    done = {(r.artifact_type, r.day): r.action for r in dated.retain(spark, str(path), NOW).collect()}
    assert done == {(r.artifact_type, r.day): r.action for r in plan}
    assert [done["raw_keystrokes", f"2024-03-0{d}"] for d in (1, 2, 3, 4, 9)] == ["dropped", "dropped", "rewritten", "kept", "kept"]
    left = dated.read_by_day(spark, str(path), SCHEMA)
    want = some_rows(spark).filter("artifact_type IS DISTINCT FROM 'raw_keystrokes' OR created_at IS NULL "
                                   "OR created_at > TIMESTAMP '2024-03-03 12:00:00'")
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    untouched = {f for f in before if not any(f.startswith(f"artifact_type=raw_keystrokes/day=2024-03-0{d}") for d in (1, 2, 3))}
    assert untouched <= files(path)


def test_an_emptied_partition_is_removed(spark, tmp_path):
    path = tmp_path / "t"
    rows = spark.createDataFrame([(1, datetime(2024, 3, 3, 6)), (2, datetime(2024, 3, 9))], "id long, created_at timestamp")
    dated.store_by_day(rows, str(path), kind=None)
    assert {r.day: r.action for r in dated.retain(spark, str(path), NOW, kind=None, days=7).collect()} == {
        "2024-03-03": "rewritten", "2024-03-09": "kept"}
    assert [v for v, in dated.partitions(spark, str(path), ["day"])] == ["2024-03-09"]
    assert dated.retain(spark, str(tmp_path / "none"), NOW).count() == 0


@pytest.mark.parametrize("secret", [None, "s3cret"])
def test_a_purge_that_was_cut_short_goes_on(spark, tmp_path, secret):
    from keytempo.functions import columns as c
    rows = some_rows(spark)
    if secret:
        rows = rows.withColumn("user_id", c.pseudonym(F.col("user_id"), secret))
    for name in ("a", "b"):
        dated.store_by_day(rows, str(tmp_path / name))
    by = ["artifact_type", "day"]
    both = {n: (str(tmp_path / n), by) for n in ("a", "b")}
    journal = str(tmp_path / "journal")
    first = dated.purge_tables(spark, {"a": both["a"]}, "p1", journal, secret).collect()
    kept = files(tmp_path / "a")
    second = dated.purge_tables(spark, both, "p1", journal, secret).collect()
    assert files(tmp_path / "a") == kept  # done before, not touched again
    assert [tuple(r) for r in first] == [("a.user_id", 10)]
    assert sorted(map(tuple, second)) == [("a.user_id", 10), ("b.user_id", 10)]
    for name in both:
        left = spark.read.parquet(str(tmp_path / name))
        assert left.count() == 21 and left.select("user_id").distinct().count() == 2
    assert not any("p1" in str(f) or "p1" in f.read_text(errors="replace") for f in (tmp_path / "journal").rglob("*.json"))


def test_audit_reads_the_newest_days_only(spark, tmp_path):
    log = spark.range(100).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20_000).alias("timestamp"), F.lit("E").alias("event_type"),
        F.lit("R").alias("actor_role"), F.create_map(F.lit("query_id"), F.col("id").cast("string")).alias("details"))
    tables.append_audit(log.filter("details['query_id'] < 50"), str(tmp_path / "log"))
    tables.append_audit(log.filter("details['query_id'] >= 50"), str(tmp_path / "log"))
    got = tables.recent_audit(spark, str(tmp_path / "log"), 10)
    assert [r.details["query_id"] for r in got.collect()] == [str(i) for i in range(99, 89, -1)]
    days = {f.split("/")[-2] for f in got.inputFiles()}
    assert len(days) <= 4 and len(list((tmp_path / "log").glob("day=*"))) >= 20
    assert tables.recent_audit(spark, str(tmp_path / "log"), 1000).count() == 100
    assert tables.recent_audit(spark, str(tmp_path / "none"), 5).count() == 0


def test_both_outputs_hold_every_row_once_after_a_failure(spark, tmp_path):
    payloads = [(i, {"type": "down", "timestamp": str(i)} if i % 3 else {"type": "down", "key": "secret"}) for i in range(30)]
    schema = "row_id long, payload map<string,string>"
    for k in range(3):
        spark.createDataFrame(payloads[k * 10:k * 10 + 10], schema).coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    sink, failed = sinks.sanitize_sink(str(tmp_path / "out"), keep=["row_id"]), []

    def lost_once(batch, batch_id):
        sink(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("lost before the commit")

    def go():
        sinks.run_to_end(source.writeStream.foreachBatch(lost_once).option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())

    with pytest.raises(Exception, match="lost before"):
        go()
    go()
    clean, rejects = sinks.sanitized_output(spark, str(tmp_path / "out"))
    assert failed and sorted(r.row_id for r in clean.collect()) == [i for i in range(30) if i % 3]
    assert sorted(r.row_id for r in rejects.collect()) == [i for i in range(30) if not i % 3]
    assert "reason" in rejects.columns and not any("secret" in str(r) for r in rejects.collect())
