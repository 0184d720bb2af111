"""Cleaning, quality, privacy and readiness on small frames."""

import hashlib
import hmac
import math
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keytempo.functions import columns as c
from keytempo.operators import adapt, cleaning, evaluation, privacy, quality, scaling, splits
from keytempo.operators import validation

from .conftest import rows


def values(df, name):
    return {r[0]: r[name] for r in df.collect()}


def test_clean_counts_first_reason_and_conserves_rows(spark):
    nan = float("nan")
    data = [(1, 5.0, 100.0, 50.0, "hi"), (1, 5.0, 100.0, 50.0, "hi"), (2, -1.0, 5.0, 50.0, "x"),
            (3, 6.0, 5.0, 99999.0, "x"), (4, 7.0, 4001.0, 1.0, "x"), (5, 8.0, None, -300.0, "x"),
            (6, 9.0, 90.0, 10001.0, "x"), (7, 10.0, nan, -50.0, "x"), (8, None, 90.0, 1.0, "x")]
    df = spark.createDataFrame(
        data, "id int, timestamp double, dwell_time double, flight_time double, text string")
    clean, report = cleaning.clean_events(df)
    got = report.collect()[0]
    assert (got.input_rows, got.final_rows, got.duplicates_removed) == (9, 2, 1)
    assert got.invalid_timestamps == 2
    assert got.negative_durations == 2 and got.extreme_outliers == 2
    assert got.sensitive_text_columns_quarantined == "text"
    assert {r.id: r.flight_time for r in clean.collect()} == {1: 50.0, 7: 0.0}
    gone = cleaning.rejects(cleaning.check_rows(df)).agg(F.sum("removed")).first()[0]
    assert gone + got.final_rows == got.input_rows


def test_numeric_word_columns_survive_quarantine(spark):
    df = spark.createDataFrame([("a", 1.0, "k")], "message string, word_time double, key string")
    assert adapt.quarantine_text(df).columns == ["word_time"]


def test_basic_clean_drops_missing(spark):
    df = spark.createDataFrame(
        [(50.0, 10.0), (5.0, 10.0), (50.0, None), (50.0, float("nan")), (50.0, 5001.0)],
        "hold_time double, flight_time double")
    assert rows(cleaning.basic_clean(df)) == [(10.0, 50.0)]


def test_missing_and_duplicates(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None), (3, float("nan"))],
                               "a int, b double")
    assert values(quality.missing_values(df), "missing_percentage") == {"a": 0.0, "b": 50.0}
    got = quality.duplicates(df).collect()[0]
    assert (got.duplicate_count, got.duplicate_percentage) == (1, 25.0)


def test_disorder_is_seen_in_arrival_order(spark):
    data = [("u", "s", i, t) for i, t in enumerate((1.0, 3.0, None, 2.0, -1.0, 5.0))]
    df = spark.createDataFrame(
        data, "user_id string, session_id string, event_id long, timestamp double")
    for limit in (None, 2):
        got = quality.bad_timestamps(df, limit=limit).collect()[0]
        assert (got.null_timestamps, got.negative_timestamps, got.disordered_timestamps) == (1, 1, 2)


def test_quality_score(spark):
    clean = spark.createDataFrame([(i, 100.0 + i) for i in range(20)], "id int, dwell_time double")
    assert quality.quality_score(clean).collect()[0].status == "EXCELLENT"
    bad = spark.createDataFrame([(i, -5.0) for i in range(20)], "id int, dwell_time double")
    got = quality.quality_score(bad).collect()[0]
    assert (got.quality_score, got.negative_durations) == (70.0, 20)


def test_privacy_audit(spark):
    df = spark.createDataFrame([("usr_0123456789abcdef", "x")], "participant_id string, Text string")
    got = quality.privacy_audit(df, "participant_id").collect()[0]
    assert (got.privacy_result, got.pseudonymization_status) == ("FAIL", "ACTIVE")


def test_pseudonyms_match_hmac_and_reject_blanks(spark):
    for secret in ("s", "long" * 40):
        df = spark.createDataFrame([(" anna ",), ("usr_0123456789abcdef",)], "user_id string")
        got = [r.user_id for r in adapt.pseudonymize(df, ["user_id"], secret).collect()]
        digest = hmac.new(secret.encode(), b"anna", hashlib.sha256).hexdigest()
        assert got == ["usr_" + digest[:16], "usr_0123456789abcdef"]
    for bad in ("  ", None):
        df = spark.createDataFrame([(bad,)], "user_id string")
        with pytest.raises(PySparkException):
            adapt.pseudonymize(df, ["user_id"], "s").collect()
    with pytest.raises(ValueError):
        c.pseudonym(F.col("x"), " ")


def test_condition_codes(spark):
    df = spark.createDataFrame([("e",), ("H",), ("0",), ("baseline",), ("calm",)], "x string")
    got = [r[0] for r in df.select(c.map_condition(F.col("x"))).collect()]
    assert got == ["neutral", "stressed", "neutral", "neutral", "calm"]


def test_sanitize_rules(spark):
    payloads = [
        {"type": "KeyDown", "timestamp": "5", "key_token": "Backspace"},
        {"event_type": "up", "timestamp_ms": "6.5", "key_token": "weird key"},
        {"event_type": "up", "timestamp_ms": "7", " KEY ": "a"},
        {"event_type": "press", "timestamp_ms": "7"}, {"event_type": "up"},
        {"event_type": "up", "timestamp_ms": "-1"}, {"event_type": "up", "timestamp_ms": "NaN"},
        {"event_type": "up", "timestamp_ms": "Infinity"},
        {"event_type": "up", "timestamp_ms": "1", "key_token": "a"}, None,
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)],
                               "i int, payload map<string,string>")
    clean, bad = adapt.sanitize_events(df, keep=["i"])
    got = [(r.i, r.event_type, r.key_token, r.is_backspace) for r in clean.collect()]
    assert got == [(0, "down", "k_backspace", True), (1, "up", "k_other", False)]
    assert values(bad, "reason") == {
        2: "forbidden_key", 3: "unknown_event_type", 4: "bad_timestamp", 5: "bad_timestamp",
        6: "bad_timestamp", 7: "bad_timestamp", 8: "raw_character", 9: "malformed_payload"}


def test_private_values(spark):
    df = spark.range(10000).select((F.col("id") % 100).cast("double").alias("x"))
    many = df.withColumn("g", F.col("x").cast("int"))
    noise = [r.private_value - 100.0 for r in
             privacy.private_count(many, seed=3, keys=["g"]).collect()]
    assert len(set(noise)) == 100 and max(map(abs, noise)) < 15
    assert 0.6 < sum(map(abs, noise)) / 100 < 1.5 and abs(sum(noise) / 100) < 0.5
    a, b = (privacy.private_mean(df, "x", (0, 99), seed=1).collect()[0] for _ in range(2))
    assert a == b and abs(a.private_value - 49.5) < 0.2
    assert "true_value" not in a.asDict()
    with pytest.raises(ValueError):
        privacy.private_mean(df, "x", (5, 5))
    with pytest.raises(ValueError):
        privacy.private_count(df, epsilon=0)
    with pytest.raises(PySparkException):
        privacy.private_mean(df.filter("x < 0"), "x", (0, 1)).collect()


def test_retention_edge(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1), "raw_keystrokes"), (datetime(2024, 1, 1), "unknown")],
        "created_at timestamp, artifact_type string")
    got = [r.is_expired for r in privacy.expired(df, datetime(2024, 1, 8)).collect()]
    assert got == [True, False]


def test_encryption_round_trip_and_tampering(spark):
    df = spark.createDataFrame([("a", "secret"), ("b", None)], "id string, v string")
    sealed = privacy.encrypt_columns(df, ["v"], b"k" * 32)
    assert rows(privacy.decrypt_columns(sealed, ["v"], b"k" * 32)) == rows(df)
    good, bad = privacy.decrypt_or_reject(sealed, ["v"], b"x" * 32)
    assert [r.id for r in bad.collect()] == ["a"] and [r.id for r in good.collect()] == ["b"]
    with pytest.raises(ValueError):
        privacy.encrypt_columns(df, ["v"], b"short")


def test_purge(spark):
    t = {"a": spark.createDataFrame([("p",), ("q",), (None,)], "participant_id string")}
    assert privacy.purge_counts(t, "p").collect()[0].records_found == 1
    assert privacy.purge_user(t, "p")["a"].count() == 2


def test_confusion_and_metrics(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(2, 0)]
    df = spark.createDataFrame(pairs, "y int, p int")
    got = evaluation.classification_metrics(df, "y", "p").collect()[0]
    assert abs(got.accuracy - 5 / 7) < 1e-12
    assert abs(got.balanced_accuracy - (0.75 + 1.0 + 0.0) / 3) < 1e-12
    f1 = [2 * 0.75 * 0.75 / 1.5, 2 * (2 / 3) / (5 / 3), 0.0]
    assert abs(got.macro_f1 - sum(f1) / 3) < 1e-12
    cells = evaluation.confusion_matrix(df, "y", "p", classes=[0, 1, 2])
    assert cells.count() == 9 and cells.agg(F.sum("n")).first()[0] == 7


def test_predicted_class(spark):
    df = spark.createDataFrame([([0.5],), ([0.4],), ([0.2, 0.5, 0.3],)], "p array<double>")
    got = [r[0] for r in df.select(evaluation.predicted_class(F.col("p"))).collect()]
    assert got == [1, 0, 1]


def test_uncertainty(spark):
    df = spark.createDataFrame([({"a": 0.75, "b": 0.15, "c": 0.10},), ({"a": 0.0, "b": 0.0},)],
                               "class_probabilities map<string,double>")
    first, second = evaluation.interpret_probabilities(df).collect()
    assert first.predicted_class == "a" and first.reliability == "HIGH_SEPARATION"
    assert abs(first.probability_margin - 0.6) < 1e-12
    wanted = -sum(p * math.log2(p) for p in (0.75, 0.15, 0.10))
    assert abs(first.entropy - wanted) < 1e-12
    assert second.top_probability == 0.5 and abs(second.normalized_entropy - 1) < 1e-12


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(300).select(F.concat(F.lit("u"), F.col("id") % 20).alias("user_id"), "id")
    out = splits.grouped_split3(df)
    assert out.count() == 300
    sizes = values(out.groupBy("split").agg(F.count_distinct("user_id").alias("n")), "n")
    assert sizes == {"test": 3, "val": 3, "train": 14}
    audit = splits.leakage_audit(out, ["dwell"], "state", session=None)
    assert audit.filter("NOT passed").count() == 0
    few = spark.range(10).select(F.lit("only").alias("user_id"), "id")
    cut = splits.grouped_split(few, row_id="id")
    assert values(cut.groupBy("split").agg(F.max("id").alias("m")), "m") == {"train": 7, "test": 9}


def test_scaler_uses_population_spread_and_guards_zero(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    params = scaling.fit_scaler(df, ["a", "b"])
    scaling.save_scaler(params, f"{tmp_path}/p")
    back = scaling.load_scaler(spark, f"{tmp_path}/p")
    assert rows(scaling.apply_scaler(df, back, ["a", "b"])) == [(-1.0, 0.0), (1.0, 0.0)]


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("z",)], "label string")
    mapping = scaling.label_mapping(df.filter("label <> 'z'"), "label")
    got = [r.label_id for r in scaling.encode_labels(df, "label", mapping)
           .orderBy(F.col("label").asc_nulls_first()).collect()]
    assert got == [-1, 0, 1, -1]
    codes = spark.createDataFrame([(1,), (7,)], "label_id int")
    assert [r.label for r in scaling.decode_labels(codes, mapping).orderBy("label_id").collect()] \
        == ["b", "unassigned"]


def test_validation_of_a_good_data_set(spark):
    data = [(f"p{u}", f"p{u}_s{s}", s * 25 + i, 200.0 * i + 10000 * s, 90.0, 110.0,
             "calm" if u % 2 else "busy") for u in range(4) for s in range(4) for i in range(25)]
    df = spark.createDataFrame(
        data, "participant_id string, session_id string, event_id long, press_time double, "
              "dwell_time double, flight_time double, condition string")
    report = validation.validate_dataset(df)
    got = values(report, "value")
    assert (got["total_participants"], got["total_sessions"], got["behavioral_classes"]) == (4, 16, 2)
    assert got["implausible_dwell"] == got["backward_steps"] == 0
    assert validation.dataset_verdict(report).collect()[0].status == "validated"


def test_redaction_reaches_nested_fields(spark):
    df = spark.createDataFrame([({"a": "1", "Session_Token": "2"},)], "d map<string,string>")
    got = privacy.redact(df, "d").collect()[0].d
    assert got == {"a": "1", "Session_Token": "[REDACTED]"}
