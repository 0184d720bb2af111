"""Pairing rules, against a row-by-row model and by hand."""

import random

from pyspark.sql import functions as F

from keytempo.operators import adapt, pairing, validation, windows
from keytempo.operators.events import event_features

from .conftest import rows

RAW = ("user_id string, session_id string, event_type string, timestamp_ms double, "
       "key_token string, is_backspace boolean, is_enter boolean, is_space boolean, "
       "event_id string, raw_id long")


def raw(spark, *events, session="s"):
    data = [("u", session, kind, float(t), key, key == "k_backspace", False, False, f"e{i}", i)
            for i, (kind, t, key) in enumerate(events)]
    return spark.createDataFrame(data, RAW)


def model(events):
    """The rules as a state machine over one session."""
    pending, released, last_back, out = {}, None, None, []
    for kind, t, key in sorted(events, key=lambda e: e[1]):
        if kind == "down":
            pending[key] = t
        elif key in pending:
            press = pending.pop(key)
            if not 0 <= t - press <= 4000:
                continue
            burst = False
            if key == "k_backspace":
                burst = last_back is not None and press - last_back < 400
                last_back = press
            flight = None if released is None else max(0.0, press - released)
            out.append((press, t, flight, key, burst))
            released = t
    return out


def test_random_streams_follow_the_model(spark):
    rng = random.Random(5)
    for trial in range(6):
        events = [(rng.choice(("down", "up")), float(rng.randrange(0, 9000, 150)),
                   rng.choice(("k_a", "k_b", "k_backspace"))) for _ in range(60)]
        got = pairing.pair_live(raw(spark, *events), limit=10 if trial % 2 else None)
        got = [(r.press_time, r.release_time, r.flight_time, r.key_token, r.is_correction)
               for r in got.orderBy("sequence_index").collect()]
        assert got == model(events)


def test_live_pairs_by_hand(spark):
    df = raw(spark, ("down", 100, "k_a"), ("up", 180, "k_a"), ("down", 250, "k_b"),
             ("up", 330, "k_b"))
    got = pairing.pair_live(df).orderBy("sequence_index").collect()
    assert [(r.dwell_time, r.flight_time) for r in got] == [(80.0, None), (80.0, 70.0)]


def test_up_before_down_and_long_holds_give_no_pair(spark):
    assert pairing.pair_live(raw(spark, ("up", 50, "k_a"), ("down", 100, "k_a"))).count() == 0
    long = raw(spark, ("down", 0, "k_a"), ("up", 4001, "k_a"), ("up", 4100, "k_a"))
    assert pairing.pair_live(long).count() == 0


def test_correction_burst(spark):
    df = raw(spark, ("down", 100, "k_backspace"), ("up", 150, "k_backspace"),
             ("down", 250, "k_backspace"), ("up", 300, "k_backspace"))
    assert [r.press_time for r in pairing.correction_bursts(df).collect()] == [250.0]


def test_offline_adapter_pairs(spark):
    data = [("p1", "1", "E", 100, "a", "down"), ("p1", "1", "E", 180, "a", "up"),
            ("p1", "1", "E", 300, "b", "down"), ("p1", "1", "E", 410, "b", "up"),
            ("p2", "1", "H", 500, "c", "down"), ("p2", "1", "H", 595, "c", "up"),
            ("p2", "1", "H", 700, "d", "down")]
    df = spark.createDataFrame(
        data, "participant_id string, session string, condition string, time int, key string, "
              "event_type string")
    out = pairing.pair_canonical(adapt.adapt_events(df, secret="k"))
    got = sorted((r.press_time, r.release_time, r.condition) for r in out.collect()
                 if r.release_time is not None)
    assert got == [(100.0, 180.0, "neutral"), (300.0, 410.0, "neutral"),
                   (500.0, 595.0, "stressed")]
    assert out.filter("release_time IS NULL").count() == 1
    assert out.filter("NOT key_identifier RLIKE '^k_[0-9a-f]{6}$'").count() == 0
    assert out.filter("NOT participant_id RLIKE '^usr_[0-9a-f]{16}$'").count() == 0


def test_single_kind_keeps_every_row(spark):
    df = spark.createDataFrame([("p", 5.0), ("p", 9.0)], "uid string, time double")
    out = pairing.pair_canonical(adapt.adapt_events(df))
    assert rows(out.select("press_time", "release_time", "session_id")) == [
        (5.0, None, "sess_0"), (9.0, None, "sess_0")]


def test_dedup_by_id_then_signature(spark):
    df = raw(spark, ("down", 1, "k_a"), ("down", 1, "k_a"), ("down", 2, "k_a"), ("up", 3, "k_a"))
    df = df.withColumn("event_id", F.when(F.col("raw_id") == 2, "e0").when(
        F.col("raw_id") == 3, F.lit(None)).otherwise(F.col("event_id")))
    assert sorted(r.raw_id for r in pairing.dedup_events(df).collect()) == [0, 3]


def test_pause_discards_pending_and_resets_flight(spark):
    df = raw(spark, ("down", 100, "k_a"), ("up", 150, "k_a"), ("down", 200, "k_b"),
             ("down", 320, "k_x"), ("up", 330, "k_x"), ("up", 500, "k_b"), ("down", 600, "k_c"),
             ("up", 650, "k_c"))
    marks = spark.createDataFrame(
        [("u", "s", 300.0, 100, "pause"), ("u", "s", 400.0, 101, "resume")],
        "user_id string, session_id string, timestamp_ms double, raw_id long, marker string")
    got = pairing.segment_by_pause(df, marks).orderBy("sequence_index").collect()
    assert [(r.key_token, r.flight_time, r.segment) for r in got] == [
        ("k_a", None, 0), ("k_c", None, 1)]
    span = pairing.active_duration(df, marks).collect()[0]
    assert abs(span.paused_sec - 0.1) < 1e-9 and abs(span.active_sec - 0.45) < 1e-9


def typed(spark, n=40):
    events, t = [], 0.0
    for i in range(n):
        key = "k_backspace" if i in (12, 13) else f"k_{i % 3}"
        events += [("down", t, key), ("up", t + 80 + (i % 7) * 5, key)]
        t += 80 + (i % 7) * 5 + 120 + (i % 5) * 15
    return raw(spark, *events)


def test_feature_frame_and_windows(spark):
    df = typed(spark)
    frame = event_features(df).orderBy("sequence_index").collect()
    assert len(frame) == 40 and frame[0].typing_speed == 0.0 and frame[0].flight_time is None
    last = frame[-1]
    span = last.release_time - frame[29].press_time
    assert abs(last.typing_speed - min(250.0, (11 / 5) / (span / 60000))) < 1e-9
    assert [r.error_flag for r in frame[12:14]] == [1.0, 1.0]
    got = windows.live_windows(df).orderBy("window_index").collect()
    assert [(w.start_index, w.end_index) for w in got] == [(0, 30), (10, 40)]
    assert len(got[0]["values"]) == 30 and len(got[0]["values"][0]) == 6
    assert [v[0] for v in got[1]["values"]] == [r.dwell_time for r in frame[10:40]]


def test_windows_of_large_sessions_equal_small_ones(spark):
    df = typed(spark, 90)
    spec = windows.Windows(length=7, stride=3, summary=True)
    assert rows(windows.live_windows(df, spec, limit=15)) == rows(windows.live_windows(df, spec))
    wide = windows.Windows(length=4, stride=6, features=("dwell_time",), summary=True)
    got = windows.live_windows(df, wide).orderBy("window_index").collect()
    assert [w.start_index for w in got] == list(range(0, 87, 6))


def test_session_gate(spark):
    gate = validation.session_evidence(typed(spark)).collect()[0]
    assert gate.verdict == "SESSION_VALID" and gate.total_paired_events == 40
    short = validation.session_evidence(typed(spark, 6)).collect()[0]
    assert short.reasons == "insufficient_events,duration_too_short"
