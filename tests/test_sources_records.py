"""Files in and out, archive scan, keyed merge and reports."""

import json

import pytest
from pyspark.sql import functions as F

from keytempo.operators import assessments, windows
from keytempo.plans import feature_run
from keytempo.plans.key_events import key_events
from keytempo.plans.record_queries import assessed
from keytempo.sources import events, tables

from .conftest import rows


def test_formats_agree(spark, tmp_path):
    df = spark.createDataFrame([("u", 1, 2.5), ("v", 2, None)], "user_id string, n int, x double")
    schema = df.schema
    df.write.option("header", True).csv(f"{tmp_path}/a.csv")
    df.write.option("header", True).option("sep", "\t").csv(f"{tmp_path}/a.tsv")
    df.write.json(f"{tmp_path}/a.jsonl")
    df.write.parquet(f"{tmp_path}/a.parquet")
    (tmp_path / "a.json").write_text(json.dumps([r.asDict() for r in df.collect()]))
    for ext in ("csv", "tsv", "jsonl", "json", "parquet"):
        got = events.read_events(spark, f"{tmp_path}/a.{ext}", schema=schema)
        assert rows(got) == rows(df), ext
    assert dict(events.read_events(spark, f"{tmp_path}/a.csv").dtypes)["x"] == "double"
    with pytest.raises(ValueError):
        events.format_of("events.xls")


def test_discovery(spark, tmp_path):
    def status():
        return events.discover_datasets(spark, str(tmp_path)).collect()[0]

    assert status().status == "missing"
    (tmp_path / "data.csv").write_text("")
    assert (status().status, status().access_status) == ("invalid", "INVALID_CORRUPT")
    (tmp_path / "more.parquet").write_text("x")
    assert status().status == "candidate_found" and status().file_count == 2
    (tmp_path / "dataset_manifest.json").write_text('{"access_type": "access required"}')
    got = status()
    assert (got.status, got.manifest_present, got.metadata_files) == ("blocked", True, 1)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("x"))
    one = events.dataset_fingerprint(df).collect()
    assert one == events.dataset_fingerprint(df.repartition(7).orderBy(F.desc("id"))).collect()
    assert one != events.dataset_fingerprint(df.withColumn("x", F.col("x") + 1)).collect()


def test_archive_scan(spark, tmp_path):
    good = {"session_id": "s1", "session_type": "CALIBRATION", "timestamp": "2024-01-02T03:04:05Z",
            "data_quality": {"is_valid": True, "verdict": "SESSION_VALID", "metrics": {
                "total_paired_events": 20, "duration_seconds": 4.5}},
            "baseline_result": {"status": "READY", "typing_deviation_index": 12.5}}
    (tmp_path / "assessment_s1.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "assessment_s2.json").write_text('{"session_id": "s2", ')
    (tmp_path / "assessment_s3.json").write_text('{"session_id": "zz", "Password": "x"}')
    got = {r.session_id: r for r in tables.newest_first(
        tables.list_sessions(spark, str(tmp_path))).collect()}
    assert set(got) == {"s1", "s2", "s3"}
    assert (got["s1"].event_count, got["s1"].duration_s, got["s1"].tdi) == (20, 4.5, 12.5)
    assert got["s1"].date == "2024-01-02 03:04:05" and got["s1"].quality == "VALID"
    assert got["s2"].quality_verdict == "CORRUPTED_JSON" and got["s2"].is_corrupted
    assert got["s3"].quality == "BLOCKED" and got["s3"].event_count == 0


def test_merge_by_key(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, t string")
    new = spark.createDataFrame(
        [("b", 5, "p", 1), ("b", 6, "q", 2), ("c", 7, "r", 1)], "k string, n int, t string, v int")
    assert rows(assessments.merge_by_key(base, new, ["k"], "v")) == [
        ("a", 1, "x"), ("b", 6, "q"), ("c", 7, "r")]
    assert rows(assessments.merge_by_key(base, new, ["k"], "v", ["n"])) == [
        ("a", 1, "x"), ("b", 6, "y"), ("c", 7, "r")]


def test_audit_log(spark, tmp_path):
    log = spark.sql("SELECT timestamp'2024-01-01' + make_dt_interval(id) AS timestamp, "
                    "'DP_QUERY_EXECUTED' AS event_type, 'ADMIN' AS actor_role, "
                    "map('n', string(id), 'secret_key', 'x') AS details FROM range(5)"
                    .replace("make_dt_interval(id)", "make_dt_interval(int(id))"))
    tables.append_audit(log, f"{tmp_path}/log")
    got = tables.recent_audit(spark, f"{tmp_path}/log", 2).collect()
    assert [r.details["n"] for r in got] == ["4", "3"]
    assert {r.details["secret_key"] for r in got} == {"[REDACTED]"}


def test_windows_round_trip(spark, sf, tmp_path):
    df = key_events(spark, sf).withColumn("d", F.col("release_time") - F.col("press_time"))
    win = windows.sliding_windows(
        df, ("d",), length=5, stride=5, order=("press_time", "event_id"), label="state")
    tables.write_windows(win, f"{tmp_path}/w", partition_by=["label"])
    back = spark.read.parquet(f"{tmp_path}/w")
    assert rows(back.select(*win.columns)) == rows(win)
    assert dict(back.dtypes)["values"] == "array<array<float>>"


def test_reports(spark, sf):
    got = assessments.render_reports(assessed(spark, sf)).limit(20).collect()
    assert all(r.markdown.startswith("# Typing Session Report") for r in got)
    assert all("**" not in r.plain_text and "diagnosis" in r.plain_text for r in got)


def test_detail_by_any_id(spark):
    df = spark.createDataFrame([("s1", "asmt_s1")], "session_id string, assessment_id string")
    for name in ("s1", "asmt_s1", "assessment_s1.json"):
        assert assessments.assessment_detail(df, name).count() == 1


def test_feature_run_writes_everything(spark, sf, tmp_path):
    source = f"{tmp_path}/in.parquet"
    key_events(spark, sf).withColumn("key", F.col("key_token")).write.parquet(source)
    report = feature_run.run_features(
        spark, source, f"{tmp_path}/out", length=5, stride=5, row_id="event_id")
    counts = {r.step: r.row_count for r in report.collect()}
    assert counts["clean_events"] > 0 and counts["features_train"] > counts["features_test"] > 0
    train = spark.read.parquet(f"{tmp_path}/out/features/split=train")
    test = spark.read.parquet(f"{tmp_path}/out/features/split=test")
    assert train.join(test, "user_id").count() == 0
    means = train.agg(F.avg("mean_dwell_time")).first()[0]
    assert abs(means) < 1e-9
    assert "key" not in spark.read.parquet(f"{tmp_path}/out/events").columns


def test_training_run(spark, sf, tmp_path):
    df = key_events(spark, sf).withColumn("d", F.col("release_time") - F.col("press_time"))
    win = windows.sliding_windows(
        df, ("d",), length=4, stride=2, order=("press_time", "event_id"), label="state")
    tables.write_windows(win, f"{tmp_path}/w")
    out = feature_run.run_training(
        f"{tmp_path}/w", spark, ["d"], kind="logistic_regression")
    assert out["readiness"].filter("severity = 'error' AND NOT passed").count() == 0
    assert out["audit"].filter("NOT passed").count() == 0
    metrics = {r.split: r for r in out["metrics"].collect()}
    assert set(metrics) == {"train", "val", "test"}
    assert sum(r.samples_evaluated for r in metrics.values()) == win.count()
    assert out["confusion"].count() == 4 and out["gaps"].count() == 1
    exact = windows.window_aggregates(
        df, ("d",), length=4, stride=2, order=("press_time", "event_id"))
    pairs = exact.join(out["scores"].select(
        "user_id", "session_id", "window_index", F.col("std_d").alias("s"),
        F.col("median_d").alias("m")), ["user_id", "session_id", "window_index"])
    worst = pairs.agg(F.max(F.abs(F.col("std_d") - F.col("s"))),
                      F.max(F.abs(F.col("median_d") - F.col("m")))).first()
    assert max(worst) < 1e-3


def test_forbidden_keys_are_found_at_any_depth(spark, tmp_path):
    import json
    docs = [
        {"session_id": "a", "meta": {"inner": [{"Raw_Text": "x"}]}},
        {"session_id": "b", "note": 'says "raw_text": here, \\ and "more'},
        {"session_id": "c", "raw_text ": 1},
    ]
    for i, d in enumerate(docs):
        (tmp_path / f"assessment_{i}.json").write_text(json.dumps(d))
    got = {r.session_id: r.quality_verdict for r in tables.list_sessions(spark, str(tmp_path)).collect()}
    assert got == {"0": "PRIVACY_VIOLATION", "b": "UNKNOWN", "2": "PRIVACY_VIOLATION"}


def test_fingerprint_keeps_values_apart(spark):
    from keytempo.sources.events import dataset_fingerprint
    rows = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("-", "x"), ("", "x")]
    found = {tuple(dataset_fingerprint(spark.createDataFrame([r], "p string, q string")).first()) for r in rows}
    assert len(found) == len(rows)
