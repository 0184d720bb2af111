"""Names, word lists and tables whose content decides results.

Every value below is part of the data contract and must stay as it is.
"""

# --- fixed values: column roles, in matching order -------------------------------------------

USER_PATTERNS = (
    "user_id", "user", "participant_id", "participant", "subject_id", "subject", "userid",
    "sub_id", "uid",
)
SESSION_PATTERNS = (
    "session_id", "session", "sess_id", "sess", "trial_id", "trial", "task_id", "task",
)
TIMESTAMP_PATTERNS = (
    "timestamp", "time", "press_time", "down_time", "datetime", "epoch", "press_timestamp",
)
KEYSTROKE_PATTERNS = (
    "dwell", "hold", "flight", "iki", "interval", "pause", "latency", "speed", "wpm",
    "backspace", "error", "press_time", "release_time", "down_time", "up_time", "keystroke",
)
LABEL_PATTERNS = (
    "state", "strain", "stress", "fatigue", "workload", "label", "target", "mood", "emotion",
    "condition", "class", "valence", "arousal", "mental_state",
)
SENSITIVE_TEXT_PATTERNS = (
    "text", "message", "sentence", "content", "typed_text", "word", "keystring", "raw_input",
    "keystrokes_text",
)

# --- fixed values: candidate columns of the raw event adapter ---------------------------------

ADAPTER_CANDIDATES = {
    "user": ("participant_id", "participant", "user_id", "subject", "sub_id", "uid"),
    "session": ("session", "session_id", "sess", "trial", "trial_id"),
    "time": ("time", "timestamp", "down_time", "press_time", "datetime"),
    "condition": ("condition", "state", "stress", "label", "task"),
    "event": ("event_type", "type", "action", "event"),
    "key": ("key", "keycode", "key_id", "char"),
}
CONDITION_LABELS = {
    "E": "neutral", "H": "stressed", "0": "neutral", "1": "stressed", "neutral": "neutral",
    "stressed": "stressed", "stress": "stressed", "baseline": "neutral",
}

# --- fixed values: names that must never carry data ------------------------------------------

FORBIDDEN_COLUMNS = (
    "key", "char", "character", "text", "word", "sentence", "message", "typed_text", "password",
    "pass", "secret", "token", "credential", "input_string", "user_input", "content",
    "keystring", "raw_input", "keystrokes_text", "raw_text", "input_text",
)
FORBIDDEN_PAYLOAD_KEYS = (
    "key", "char", "character", "text", "word", "sentence", "message", "typed_text", "password",
    "user_input", "content", "value", "input", "keystring", "raw_input", "keystrokes_text",
    "raw_text", "input_text", "val", "str",
)
FORBIDDEN_CANONICAL = (
    "key", "char", "character", "text", "word", "sentence", "message", "typed_text", "password",
    "user_input", "content", "keystring", "raw_input", "keystrokes_text", "raw_text",
    "input_text",
)
REDACTED_KEYS = (
    *FORBIDDEN_COLUMNS, "encryption_key", "secret_key", "salt", "plaintext",
)
REDACTED_PARTS = ("key", "secret", "token", "password")
USER_ID_COLUMNS = ("user_id", "subject_id", "participant_id", "student_id", "raw_user_id")
PURGE_ID_COLUMNS = ("user_id", "participant_id", "subject_id")

# --- fixed values: event vocabulary -----------------------------------------------------------

CANONICAL_REQUIRED = (
    "participant_id", "session_id", "timestamp", "event_type", "key_identifier", "press_time",
    "release_time", "condition",
)
ALLOWED_EVENT_TYPES = ("down", "up", "press", "release", "keydown", "keyup", "touch")
ABSTRACT_KEY = "^k_[a-zA-Z0-9_]+$"
PSEUDONYM = "^usr_[0-9a-f]{16}$"
NAMED_KEYS = ("backspace", "enter", "space", "tab")
BACKSPACE_LABELS = ("backspace", "key.backspace", "8", "[backspace]")
SEQUENCE_FEATURES = (
    "dwell_time", "flight_time", "pause_duration", "typing_speed", "backspace", "error_flag",
)
DURATION_COLUMNS = (
    "dwell_time", "flight_time", "pause_duration", "hold_time", "interval", "iki",
)
DWELL_COLUMNS = ("dwell_time", "hold_time")
FLIGHT_COLUMNS = ("flight_time", "iki")
BACKSPACE_COLUMNS = ("backspace", "is_backspace")
ERROR_COLUMNS = ("error_flag", "is_error", "error", "typing_error")
WORD_COLUMNS = ("word_time", "word_duration")

# --- fixed values: baseline features (unit, meaning, what a higher value is) ------------------

BASELINE_FEATURES = (
    "mean_typing_speed_wpm",
    "mean_dwell_time",
    "mean_flight_time",
    "backspace_rate",
    "pause_rate",
    "mean_pause_duration",
    "cv_flight_time",
    "cv_dwell_time",
    "error_rate",
)

# --- fixed values: feature catalogue (category, unit, alternative sets of needed columns) -----

_DWELL = (("dwell_time",), ("hold_time",), ("press_time", "release_time"))
_FLIGHT = (("flight_time",), ("iki",), ("press_time", "release_time"))
_PAUSE = (("flight_time",), ("pause_duration",), ("press_time", "release_time"))
_SPEED = (("typing_speed",), ("press_time", "release_time"))
_BACKSPACE = (("backspace",), ("key",))
_ERROR = (("error_flag",), ("is_error",), ("error",))
_WORD = (("word_time",), ("word_duration",), ("word_timestamp",))
FEATURE_CATALOGUE = {
    "mean_dwell_time": ("timing", "ms", _DWELL),
    "median_dwell_time": ("timing", "ms", _DWELL),
    "std_dwell_time": ("timing", "ms", _DWELL),
    "min_dwell_time": ("timing", "ms", _DWELL),
    "max_dwell_time": ("timing", "ms", _DWELL),
    "p25_dwell_time": ("timing", "ms", _DWELL),
    "p75_dwell_time": ("timing", "ms", _DWELL),
    "mean_flight_time": ("timing", "ms", _FLIGHT),
    "median_flight_time": ("timing", "ms", _FLIGHT),
    "std_flight_time": ("timing", "ms", _FLIGHT),
    "min_flight_time": ("timing", "ms", _FLIGHT),
    "max_flight_time": ("timing", "ms", _FLIGHT),
    "pause_rate": ("pause", "ratio", _PAUSE),
    "mean_pause_duration": ("pause", "ms", _PAUSE),
    "median_pause_duration": ("pause", "ms", _PAUSE),
    "max_pause_duration": ("pause", "ms", _PAUSE),
    "long_pause_count": ("pause", "count", _PAUSE),
    "mean_typing_speed_wpm": ("speed", "wpm", _SPEED),
    "median_typing_speed_wpm": ("speed", "wpm", _SPEED),
    "std_typing_speed_wpm": ("speed", "wpm", _SPEED),
    "cv_dwell_time": ("variability", "dimensionless", _DWELL),
    "cv_flight_time": ("variability", "dimensionless", _FLIGHT),
    "mad_dwell_time": ("variability", "ms", _DWELL),
    "mad_flight_time": ("variability", "ms", _FLIGHT),
    "total_backspaces": ("error_correction", "count", _BACKSPACE),
    "backspace_rate": ("error_correction", "ratio", _BACKSPACE),
    "total_errors": ("error_correction", "count", _ERROR),
    "error_rate": ("error_correction", "ratio", _ERROR),
    "mean_word_completion_time": ("word", "ms", _WORD),
    "word_completion_variability": ("word", "ms", _WORD),
    "session_duration_sec": ("session", "seconds", (("timestamp",), ("press_time",))),
    "keystroke_count": (
        "session", "count",
        (("timestamp",), ("press_time",), ("key",), ("dwell_time",), ("user_id",))),
}

# --- fixed values: digits of the published session features -----------------------------------

FEATURE_DIGITS = {
    "session_duration_sec": 2,
    "mean_dwell_time": 2, "median_dwell_time": 2, "min_dwell_time": 2, "max_dwell_time": 2,
    "p25_dwell_time": 2, "p75_dwell_time": 2,
    "std_dwell_time": 3, "cv_dwell_time": 4, "mad_dwell_time": 3,
    "mean_flight_time": 2, "median_flight_time": 2, "min_flight_time": 2, "max_flight_time": 2,
    "std_flight_time": 3, "cv_flight_time": 4, "mad_flight_time": 3,
    "pause_rate": 4, "mean_pause_duration": 2, "median_pause_duration": 2,
    "max_pause_duration": 2, "long_pause_ratio": 4,
    "mean_typing_speed_wpm": 2, "median_typing_speed_wpm": 2, "std_typing_speed_wpm": 2,
    "min_typing_speed_wpm": 2, "max_typing_speed_wpm": 2,
    "backspace_rate": 4, "backspace_proportion": 4, "error_rate": 4,
    "mean_word_completion_time": 2, "median_word_completion_time": 2,
    "word_completion_variability": 2,
}

# --- fixed values: retention days and storage policies ----------------------------------------
# artifact type: (sensitivity, encryption required, pseudonyms required, retention days)

STORAGE_POLICIES = {
    "raw_keystrokes": ("highly_sensitive", True, True, 7),
    "timing_features": ("sensitive", False, True, 90),
    "personal_baselines": ("sensitive", True, True, 90),
    "model_checkpoints": ("internal", False, False, 365),
    "assessment_reports": ("sensitive", True, True, 180),
    "audit_logs": ("internal", False, False, 365),
}
DEFAULT_POLICY = ("sensitive", True, True, 90)

# --- fixed values: dataset discovery ----------------------------------------------------------

SUPPORTED_EXTENSIONS = (".csv", ".xlsx", ".xls", ".parquet", ".json", ".tsv", ".zip")

# --- fixed values: chart metrics of a baseline comparison -------------------------------------

COMPARED_METRICS = {
    "mean_dwell_ms": "Dwell Time (ms)",
    "mean_flight_ms": "Flight Time (ms)",
    "pause_rate": "Pause Rate (%)",
    "estimated_wpm": "Cadence (WPM)",
    "backspace_count": "Corrections",
}

# --- fixed values: bands of the strain heuristic ----------------------------------------------

STRAIN_CATEGORIES = {
    "unknown": "Insufficient Data",
    "low": "Low Strain (Fluent Rhythm)",
    "moderate": "Moderate Strain (Occasional Hesitation)",
    "high": "High Strain (Fragmented Rhythm / Fatigue Indicators)",
}

# --- fixed values: assessment states ----------------------------------------------------------

ASSESSMENT_STATES = (
    "ready", "prediction_available", "baseline_available", "model_unavailable",
    "insufficient_data", "not_ready",
)
DISCLAIMER = (
    "Results describe typing rhythm and statistical deviation only. "
    "They are not a psychological, psychiatric or medical diagnosis."
)
