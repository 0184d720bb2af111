"""Column layouts used across the engine.  Times and durations are double milliseconds."""

from pyspark.sql import types as T


def _struct(nullable: bool = True, **fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t in fields.items()])


_S, _D, _I, _L, _B = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()
)

# Canonical events: one row per key press, whatever data set they came from.
CANONICAL_EVENT = _struct(
    participant_id=_S, session_id=_S, timestamp=_D, event_type=_S, key_identifier=_S,
    press_time=_D, release_time=_D, condition=_S,
)
CANONICAL_OPTIONAL = ("pressure", "x", "y")

# Browser events before pairing: one row per key down or key up.
RAW_KEY_EVENT = _struct(
    user_id=_S, session_id=_S, event_type=_S, timestamp_ms=_D, key_token=_S,
    is_backspace=_B, is_enter=_B, is_space=_B, event_id=_S, raw_id=_L,
)

PAIRED_EVENT = _struct(
    user_id=_S, session_id=_S, sequence_index=_L, press_time=_D, release_time=_D,
    dwell_time=_D, flight_time=_D, key_token=_S, is_backspace=_B, is_enter=_B,
    is_space=_B, is_correction=_B,
)

EVENT_FEATURES = _struct(
    user_id=_S, session_id=_S, sequence_index=_L, press_time=_D, release_time=_D,
    dwell_time=_D, flight_time=_D, pause_duration=_D, typing_speed=_D, backspace=_D,
    error_flag=_D,
)

# Wide event files as they arrive for the batch pipeline.
WIDE_EVENT = _struct(
    user_id=_S, session_id=_S, timestamp=_L, key=_S, press_time=_D, release_time=_D,
    dwell_time=_D, flight_time=_D, pause_duration=_D, backspace=_I, error_flag=_I,
    typing_speed=_D, state=_S,
)

SESSIONS_TABLE = _struct(
    session_id=_S, pseudonymized_user_id=_S, session_type=_S, created_at=T.TimestampType(),
    sample_count=_L, status=_S,
)

ASSESSMENTS_TABLE = _struct(
    assessment_id=_S, session_id=_S, pseudonymized_user_id=_S, session_type=_S,
    created_at=T.TimestampType(), duration_s=_D, event_count=_L, mean_dwell_ms=_D,
    mean_flight_ms=_D, mean_pause_ms=_D, pause_rate=_D, typing_speed_wpm=_D,
    backspace_rate=_D, tdi_score=_D, tdi_divergence_level=_S, model_predicted_class=_S,
    model_confidence=_D, model_status=_S, assessment_json=_S,
)

# Columns an assessment keeps from its first insert when it is written again.
ASSESSMENT_FIXED = ("session_id", "pseudonymized_user_id", "session_type", "created_at")

BASELINE_STATS = _struct(
    user_id=_S, feature=_S, baseline_status=_S, session_count=_L, min_required_sessions=_I,
    mean=_D, std=_D, median=_D, mad=_D, iqr=_D, min=_D, max=_D, sample_count=_L,
)

# Assessment document as stored in the archive (one JSON file per session).
ASSESSMENT_DOCUMENT = T.StructType([
    T.StructField("session_id", _S),
    T.StructField("user_id", _S),
    T.StructField("session_type", _S),
    T.StructField("timestamp", _S),
    T.StructField("pipeline_status", _S),
    T.StructField("data_quality", T.StructType([
        T.StructField("is_valid", _B),
        T.StructField("verdict", _S),
        T.StructField("metrics", _struct(
            total_paired_events=_L, duration_seconds=_D, valid_dwell_count=_L,
            valid_flight_count=_L, paired_events_count=_L, active_duration_s=_D,
        )),
    ])),
    T.StructField("feature_summary", _struct(
        event_count=_L, mean_dwell_ms=_D, median_dwell_ms=_D, mean_flight_ms=_D,
        median_flight_ms=_D, pause_count=_L, pause_rate=_D, estimated_wpm=_D,
        backspace_count=_L, correction_count=_L, error_rate=_D, duration_seconds=_D,
    )),
    T.StructField("baseline_result", _struct(
        status=_S, session_count=_L, min_required_sessions=_I, typing_deviation_index=_D,
        deviation_level=_S,
    )),
    T.StructField("model_result", _struct(
        status=_S, predicted_class=_S, confidence=_D,
    )),
])
