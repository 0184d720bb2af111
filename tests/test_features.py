"""Hand-computed values of event and session features."""

from pyspark.sql import functions as F

from keytempo.operators import events, features

from .conftest import rows

EVENT = "user_id string, session_id string, event_id long, press_time double, release_time double"


def presses(spark, *triples, session="s1", extra=None):
    data = [("u1", session, i, float(p), float(r)) for i, (p, r) in enumerate(triples)]
    return spark.createDataFrame(data, EVENT)


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0].asDict()


def test_dwell_and_flight(spark):
    df = presses(spark, (100, 180), (250, 350), (450, 520))
    out = events.flight_times(df).withColumn("dwell", events.dwell(df))
    got = {r.event_id: (r.dwell, r.flight_time) for r in out.collect()}
    assert got == {0: (80.0, None), 1: (100.0, 70.0), 2: (70.0, 100.0)}


def test_flight_never_crosses_sessions(spark):
    df = presses(spark, (100, 180)).unionByName(presses(spark, (250, 350), session="s2"))
    assert [r.flight_time for r in events.flight_times(df).collect()] == [None, None]


def test_rollover_flight_is_zero_and_given_flight_wins(spark):
    df = presses(spark, (100, 180), (150, 220))
    assert {r.flight_time for r in events.flight_times(df).collect()} == {None, 0.0}
    given = df.withColumn("iki", F.lit("7.5"))
    assert {r.flight_time for r in events.flight_times(given).collect()} == {7.5}


def test_pauses(spark):
    data = [("u", "s", i, f) for i, f in enumerate((50.0, 100.0, 2200.0, 4500.0))]
    df = spark.createDataFrame(
        data, "user_id string, session_id string, event_id long, flight_time double")
    got = one(features.session_features(df, order=("event_id",)))
    assert got["pause_rate"] == 0.5
    assert got["long_pause_count"] == 1.0
    assert got["max_pause_duration"] == 4500.0
    assert got["mean_pause_duration"] == 3350.0
    assert got["keystroke_count"] == 4
    assert "mean_dwell_time" not in got


def test_backspaces_from_key_names_and_errors(spark):
    data = [("u", "s", i, k, e) for i, (k, e) in enumerate(
        (("a", "0"), ("Backspace ", "1"), ("b", "x"), ("key.backspace", "1"), ("c", "0")))]
    df = spark.createDataFrame(
        data, "user_id string, session_id string, event_id long, key string, error_flag string")
    got = one(features.session_features(df, order=("event_id",)))
    assert (got["total_backspaces"], got["backspace_rate"]) == (2.0, 0.4)
    assert (got["total_errors"], got["error_rate"]) == (2.0, 0.4)


def test_variability_of_zeros_and_single_values(spark):
    data = [("u", "s", 0.0)] * 3 + [("u", "t", 5.0)]
    df = spark.createDataFrame(data, "user_id string, session_id string, x double")
    out = features.group_variability(df, "x")
    assert rows(out.select("session_id", "cv_x", "mad_x", "std_x")) == [
        (0.0, 0.0, "s", 0.0), (0.0, 0.0, "t", 0.0)]


def test_missing_values_are_skipped(spark):
    data = [("u", "s", i, v) for i, v in enumerate((10.0, None, float("nan"), 30.0))]
    df = spark.createDataFrame(
        data, "user_id string, session_id string, event_id long, dwell_time double")
    got = one(features.session_features(df, order=("event_id",)))
    assert (got["mean_dwell_time"], got["min_dwell_time"]) == (20.0, 10.0)


def test_typing_speed_needs_five_events(spark):
    four = presses(spark, *[(200 * i, 200 * i + 90) for i in range(4)])
    five = presses(spark, *[(200 * i, 200 * i + 90) for i in range(5)])
    assert one(features.session_features(four))["mean_typing_speed_wpm"] == 0.0
    got = one(features.session_features(five))["mean_typing_speed_wpm"]
    minutes = (5 * 90 + 4 * 110) / 60000
    assert abs(got - min(1.0 / minutes, 250.0)) < 1e-9


def test_given_typing_speed_and_words(spark):
    data = [("u", "s", i, s, w) for i, (s, w) in enumerate(((40.0, 300.0), (60.0, None)))]
    df = spark.createDataFrame(
        data, "user_id string, session_id string, event_id long, typing_speed double, "
              "word_time double")
    got = one(features.session_features(df, order=("event_id",)))
    assert got["mean_typing_speed_wpm"] == 50.0
    assert got["mean_word_completion_time"] is None


def test_sessions_without_person_or_session_column(spark):
    df = presses(spark, (100, 180), (250, 350))
    got = one(features.session_features(df.drop("user_id")))
    assert (got["user_id"], got["session_id"]) == ("unknown_user", "s1")
    got = one(features.session_features(df.drop("user_id", "session_id")))
    assert (got["user_id"], got["session_id"]) == ("default_user", "default_session")


def test_published_digits(spark):
    df = presses(spark, (0, 100.123), (200, 300.456), (400.5, 480.789))
    got = one(features.publish(features.session_features(df)))
    assert got["mean_dwell_time"] == round((100.123 + 100.456 + 80.289) / 3, 2)


def test_basic_timing_of_one_event_is_zero(spark):
    got = one(features.timing_features(presses(spark, (100, 180))))
    assert got["keystroke_count"] == 1.0
    assert got["mean_hold_time_ms"] == got["pause_rate"] == 0.0


def test_strain_bands(spark):
    data = [(4.0, 1.0, 900.0, 400.0), (10.0, 0.0, 0.0, 80.0), (10.0, 0.4, 300.0, 230.0)]
    df = spark.createDataFrame(
        data, "keystroke_count double, pause_rate double, std_flight_time_ms double, "
              "mean_hold_time_ms double")
    got = [(r.strain_score, r.strain_category.split(" (")[0])
           for r in features.strain_score(df).collect()]
    assert got == [(0.0, "Insufficient Data"), (0.0, "Low Strain"), (100.0, "High Strain")]
