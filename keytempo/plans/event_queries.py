"""Queries on pairing, per-event columns and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from keytempo.operators import adapt, cleaning, events, features, pairing
from keytempo.plans.key_events import TIMES, down_up, key_events, stable, written
from keytempo.plans.registry import query
from keytempo.plans.sql import part, r, with_parts

PAIR_SQL = f"""user_id, session_id, sequence_index, press_time,
  release_time, {r('dwell_time')} AS dwell_time,
  {r('flight_time')} AS flight_time, key_token, is_backspace, is_enter, is_space, is_correction"""


def canonical(spark, sf_dir):
    return adapt.adapt_events(
        down_up(spark, sf_dir).select(
            F.col("user_id").alias("participant_id"),
            F.col("session_id").alias("session"),
            F.when(F.col("state") == "stressed", "H").otherwise("E").alias("condition"),
            F.col("timestamp_ms").alias("time"),
            F.col("key_token").alias("key"),
            F.col("event_type"),
            F.col("raw_id").alias("event_id"),
        )
    )


@query("paired_events", with_parts("raw", body=f"""
SELECT user_id AS participant_id, session_id, timestamp_ms AS "timestamp", event_type,
  'k_' || substr(md5(key_token), 1, 6) AS key_identifier, state AS condition,
  raw_id AS event_id, timestamp_ms AS press_time,
  CASE WHEN nxt = 'up' THEN nxt_time END AS release_time
FROM (SELECT *, lead(event_type) OVER k AS nxt, lead(timestamp_ms) OVER k AS nxt_time FROM raw
      WINDOW k AS (PARTITION BY user_id, session_id, key_token ORDER BY timestamp_ms, raw_id))
WHERE event_type = 'down'"""))
def paired_events(spark, sf_dir):
    return stable(pairing.pair_canonical(canonical(spark, sf_dir)))


@query("paired_live", with_parts("pairs", body=f"SELECT {PAIR_SQL} FROM pairs"))
def paired_live(spark, sf_dir):
    return stable(pairing.pair_live(down_up(spark, sf_dir)))


@query("flight_times", with_parts("fl", body=f"""
SELECT event_id, user_id, session_id, {r('dwell')} AS dwell_time, {r('flight')} AS flight_time
FROM fl"""))
def flight_times(spark, sf_dir):
    df = events.flight_times(key_events(spark, sf_dir))
    return stable(df.select(
        "event_id", "user_id", "session_id",
        (F.col("release_time") - F.col("press_time")).alias("dwell_time"), "flight_time"))


@query("correction_bursts", with_parts("pairs", body=f"""
SELECT {PAIR_SQL} FROM pairs WHERE is_correction"""))
def correction_bursts(spark, sf_dir):
    return stable(pairing.correction_bursts(down_up(spark, sf_dir)))


@query("rolling_wpm", with_parts("features", body=f"""
SELECT user_id, session_id, sequence_index, {r('typing_speed')} AS typing_speed FROM features"""))
def rolling_wpm(spark, sf_dir):
    return stable(events.rolling_wpm(down_up(spark, sf_dir)))


FRAME_SQL = ", ".join(
    ["user_id", "session_id", "sequence_index"]
    + [n if n in TIMES else f"{r(n)} AS {n}" for n in events.EVENT_COLUMNS[3:]]
)


@query("event_feature_frame", with_parts("features", body=f"SELECT {FRAME_SQL} FROM features"))
def event_feature_frame(spark, sf_dir):
    return stable(events.event_features(down_up(spark, sf_dir)))


@query("keep_last_events", with_parts("pairs", body=f"""
SELECT user_id, session_id, sequence_index, {r('dwell_time')} AS dwell_time,
  {r('flight_time')} AS flight_time
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_id
                                   ORDER BY sequence_index DESC) AS back FROM pairs)
WHERE back <= 10"""))
def keep_last_events(spark, sf_dir):
    return stable(events.event_features(down_up(spark, sf_dir), newest=10).select(
        "user_id", "session_id", "sequence_index", "dwell_time", "flight_time"))


@query("keep_last_presses", with_parts("fl", body=f"""
SELECT event_id, user_id, session_id, {r('flight')} AS flight_time
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_id
                                   ORDER BY press_time DESC, event_id DESC) AS back FROM fl)
WHERE back <= 5"""))
def keep_last_presses(spark, sf_dir):
    df = events.flight_times(key_events(spark, sf_dir))
    return stable(events.keep_last(df, 5, order=("press_time", "event_id")).select(
        "event_id", "user_id", "session_id", "flight_time"))


@query("dedup_raw_events", with_parts("raw", body=f"""
SELECT user_id, session_id, event_type, timestamp_ms, key_token,
  min(raw_id) AS raw_id
FROM raw GROUP BY user_id, session_id, event_type, timestamp_ms, key_token"""))
def dedup_raw_events(spark, sf_dir):
    """Every error event is delivered twice more: once with its id, once without any id."""
    raw = down_up(spark, sf_dir)
    again = raw.filter(F.col("is_backspace"))
    shifted = F.col("raw_id") + F.lit(1 << 40)
    delivered = raw.unionByName(again.withColumn("raw_id", shifted)).unionByName(
        again.withColumns({"raw_id": shifted * 2, "event_id": F.lit(None).cast("string")}))
    return stable(pairing.dedup_events(delivered).select(
        "user_id", "session_id", "event_type", "timestamp_ms", "key_token", "raw_id"))


part("marks", "raw", sql="""
SELECT *, CASE WHEN event_type = 'down' AND key_token = 'k_signup' THEN 'pause'
               WHEN event_type = 'down' AND key_token = 'k_purchase' THEN 'resume' END AS marker
FROM raw""")
part("parted", "marks", sql="""
SELECT *, CAST(sum(CASE WHEN marker = 'pause' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment,
  coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY user_id, session_id
    ORDER BY timestamp_ms, raw_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'resume')
    AS paused_state
FROM marks WINDOW w AS (PARTITION BY user_id, session_id ORDER BY timestamp_ms, raw_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")


@query("pause_segments", with_parts("parted", body=f"""
SELECT user_id, session_id, segment, key_token, down AS press_time,
  timestamp_ms AS release_time, row_number() OVER s - 1 AS sequence_index,
  {r('''CASE WHEN lag(timestamp_ms) OVER g IS NOT NULL
        THEN greatest(0.0, down - lag(timestamp_ms) OVER g) END''')} AS flight_time
FROM (SELECT *, lag(event_type) OVER k AS before, lag(timestamp_ms) OVER k AS down
      FROM parted WHERE marker IS NULL AND paused_state = 'resume'
      WINDOW k AS (PARTITION BY user_id, session_id, key_token, segment
                   ORDER BY timestamp_ms, raw_id))
WHERE event_type = 'up' AND before = 'down' AND timestamp_ms - down BETWEEN 0 AND 4000
WINDOW s AS (PARTITION BY user_id, session_id ORDER BY timestamp_ms, raw_id),
       g AS (PARTITION BY user_id, session_id, segment ORDER BY timestamp_ms, raw_id)"""))
def pause_segments(spark, sf_dir):
    """Presses of signup events pause a session, presses of purchase events resume it."""
    raw, markers = with_markers(down_up(spark, sf_dir))
    out = pairing.segment_by_pause(raw, markers)
    return stable(out.select(
        "user_id", "session_id", "segment", "key_token", "press_time", "release_time",
        "sequence_index", "flight_time"))


def with_markers(raw):
    down = F.col("event_type") == "down"
    marker = F.when(down & (F.col("key_token") == "k_signup"), "pause").when(
        down & (F.col("key_token") == "k_purchase"), "resume")
    marked = raw.withColumn("marker", marker)
    return (marked.filter(F.col("marker").isNull()).drop("marker"),
            marked.filter(F.col("marker").isNotNull()))


@query("active_duration", with_parts("parted", body=f"""
SELECT user_id, session_id, {r('span')} AS span_sec, {r('paused')} AS paused_sec,
  {r('span - paused')} AS active_sec
FROM (SELECT user_id, session_id, (max(timestamp_ms) - min(timestamp_ms)) / 1000.0 AS span,
        coalesce(sum(CASE WHEN paused_state = 'pause' THEN step END), 0.0) / 1000.0 AS paused
      FROM (SELECT *, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY user_id, session_id
                                    ORDER BY timestamp_ms, raw_id) AS step FROM parted)
      GROUP BY user_id, session_id)"""))
def active_duration(spark, sf_dir):
    return stable(pairing.active_duration(*with_markers(down_up(spark, sf_dir))))


# --- cleaning ---------------------------------------------------------------------------------

part("delivered", "fl", sql="""
SELECT event_id, user_id, session_id, "timestamp", key_token, press_time, release_time, flight
  AS flight_time, state FROM fl
UNION ALL
SELECT event_id, user_id, session_id, "timestamp", key_token, press_time, release_time, flight,
  state FROM fl WHERE backspace = 1""")
part("checked", "delivered", sql="""
SELECT event_id, user_id, session_id, "timestamp", key_token, press_time, release_time,
  flight_time, state, count(*) AS copies,
  CASE WHEN "timestamp" IS NULL OR "timestamp" < 0 THEN 'invalid_timestamp'
       WHEN release_time - press_time < 10 OR release_time - press_time > 450
         THEN 'bad_computed_dwell'
       WHEN flight_time < -200 THEN 'negative_flight'
       WHEN flight_time > 2500 THEN 'long_flight' END AS reason
FROM delivered GROUP BY ALL""")
BOUNDS = cleaning.Bounds(max_dwell_ms=450.0, max_flight_ms=2500.0)
CLEAN_SQL = f"""event_id, user_id, session_id, "timestamp", key_token,
  press_time, release_time,
  {r('flight_time')} AS flight_time, state"""


def delivered(spark, sf_dir):
    """Key events with flights; error events arrive twice."""
    rows = events.flight_times(key_events(spark, sf_dir)).drop("error_flag")
    return rows.unionByName(rows.filter("backspace = 1")).drop("backspace")


@query("clean_events", with_parts("checked", body=f"""
SELECT {CLEAN_SQL} FROM checked WHERE reason IS NULL"""))
def clean_events(spark, sf_dir):
    clean, _ = cleaning.clean_events(delivered(spark, sf_dir), BOUNDS)
    return stable(clean)


@query("clean_report", with_parts("checked", body="""
SELECT CAST(sum(copies) AS BIGINT) AS input_rows,
  count(*) FILTER (reason IS NULL) AS final_rows,
  CAST(sum(copies - 1) AS BIGINT) AS duplicates_removed,
  count(*) FILTER (reason = 'invalid_timestamp') AS invalid_timestamps,
  count(*) FILTER (reason IN ('bad_computed_dwell', 'negative_flight')) AS negative_durations,
  count(*) FILTER (reason = 'long_flight') AS extreme_outliers,
  CAST(sum(copies) - count(*) FILTER (reason IS NULL) AS BIGINT) AS removed_rows,
  round(100.0 * count(*) FILTER (reason IS NULL) / sum(copies), 2) AS retention_rate_pct,
  '' AS sensitive_text_columns_quarantined FROM checked"""))
def clean_report(spark, sf_dir):
    _, report = cleaning.clean_events(delivered(spark, sf_dir), BOUNDS)
    return report


@query("clean_rejects", with_parts("checked", body=f"""
SELECT {CLEAN_SQL}, reason, CAST(1 AS BIGINT) AS removed FROM checked WHERE reason IS NOT NULL
UNION ALL
SELECT {CLEAN_SQL}, 'duplicate' AS reason, copies - 1 AS removed FROM checked WHERE copies > 1"""))
def clean_rejects(spark, sf_dir):
    return stable(cleaning.rejects(cleaning.check_rows(delivered(spark, sf_dir), BOUNDS)))


@query("basic_clean", with_parts("fl", body=f"""
SELECT event_id, user_id, session_id, {r('dwell')} AS hold_time, {r('flight')} AS flight_time
FROM fl WHERE flight IS NOT NULL AND dwell BETWEEN 10 AND 2000 AND flight BETWEEN 0 AND 1500"""))
def basic_clean(spark, sf_dir):
    df = events.flight_times(key_events(spark, sf_dir)).select(
        "event_id", "user_id", "session_id",
        (F.col("release_time") - F.col("press_time")).alias("hold_time"), "flight_time")
    return stable(cleaning.basic_clean(df, max_flight_ms=1500.0))


# --- session features -------------------------------------------------------------------------

_FEATURES = [
    "keystroke_count", "session_duration_sec",
    *[f"{s}_dwell_time" for s in ("mean", "median", "min", "max", "p25", "p75", "std", "cv", "mad")],
    *[f"{s}_flight_time" for s in ("mean", "median", "min", "max", "std", "cv", "mad")],
    "pause_rate", "mean_pause_duration", "median_pause_duration", "max_pause_duration",
    "long_pause_count", "long_pause_ratio", "mean_typing_speed_wpm", "total_backspaces",
    "backspace_rate", "total_errors", "error_rate", "target_label",
]


def feature_sql(names) -> str:
    def one(n):
        plain = n in ("keystroke_count", "target_label")
        return f"{n}" if plain else f"{r(n)} AS {n}"
    return "user_id, session_id, " + ", ".join(map(one, names))


def session_table(spark, sf_dir):
    return features.session_features(key_events(spark, sf_dir))


def stored_sessions(spark, sf_dir):
    """The session table for queries that read it more than once."""
    return written(session_table(spark, sf_dir), "sessions")


@query("session_features", with_parts("sf", body=f"""
SELECT {feature_sql(_FEATURES)}, {r('mean_typing_speed_wpm')} AS median_typing_speed_wpm,
  {r('mean_typing_speed_wpm')} AS min_typing_speed_wpm,
  {r('mean_typing_speed_wpm')} AS max_typing_speed_wpm, 0.0::DOUBLE AS std_typing_speed_wpm,
  {r('backspace_rate')} AS backspace_proportion FROM sf"""))
def session_features(spark, sf_dir):
    return stable(session_table(spark, sf_dir))


def _columns(name, columns):
    @query(name, with_parts("sf", body=f"SELECT {feature_sql(columns)} FROM sf"))
    def plan(spark, sf_dir):
        return stable(session_table(spark, sf_dir).select("user_id", "session_id", *columns))


_columns("session_pauses", [
    "pause_rate", "mean_pause_duration", "median_pause_duration", "max_pause_duration",
    "long_pause_count", "long_pause_ratio"])
_columns("session_typing_speed", ["mean_typing_speed_wpm"])
_columns("session_backspace_error", [
    "total_backspaces", "backspace_rate", "total_errors", "error_rate"])
_columns("session_label_duration", ["session_duration_sec", "keystroke_count", "target_label"])


@query("session_variability", with_parts("sf", body=f"""
SELECT user_id, session_id, {r('std_dwell_time')} AS std_dwell_time,
  {r('cv_dwell_time')} AS cv_dwell_time, {r('mad_dwell_time')} AS mad_dwell_time FROM sf"""))
def session_variability(spark, sf_dir):
    df = key_events(spark, sf_dir).withColumn(
        "dwell_time", F.col("release_time") - F.col("press_time"))
    return stable(features.group_variability(df, "dwell_time"))


part("given", "fl", sql="""
SELECT user_id, session_id, count(*) AS n, avg(dwell) AS speed_mean, median(dwell) AS speed_median,
  stddev_samp(dwell) AS speed_std, min(dwell) AS speed_min, max(dwell) AS speed_max,
  count(flight) AS words, avg(flight) AS word_mean, median(flight) AS word_median,
  stddev_samp(flight) AS word_std FROM fl GROUP BY user_id, session_id""")


@query("session_given_speed_words", with_parts("given", body=f"""
SELECT user_id, session_id, {r('speed_mean')} AS mean_typing_speed_wpm,
  {r('speed_median')} AS median_typing_speed_wpm,
  {r('CASE WHEN n > 1 THEN speed_std ELSE 0.0 END')} AS std_typing_speed_wpm,
  {r('speed_min')} AS min_typing_speed_wpm, {r('speed_max')} AS max_typing_speed_wpm,
  {r('CASE WHEN words >= 2 THEN word_mean END')} AS mean_word_completion_time,
  {r('CASE WHEN words >= 2 THEN word_median END')} AS median_word_completion_time,
  {r('CASE WHEN words >= 2 THEN word_std END')} AS word_completion_variability FROM given"""))
def session_given_speed_words(spark, sf_dir):
    """Speed and word timing from given columns instead of press and release times."""
    df = events.flight_times(key_events(spark, sf_dir))
    df = df.withColumns({
        "typing_speed": F.col("release_time") - F.col("press_time"),
        "word_time": F.col("flight_time"),
    })
    out = features.session_features(df)
    names = [n for n in out.columns if "speed_wpm" in n or "word" in n]
    return stable(out.select("user_id", "session_id", *names))


part("basic", "fl", sql="""
SELECT user_id, session_id,
  CASE WHEN count(*) >= 2 THEN avg(dwell) ELSE 0 END AS mean_hold_time_ms,
  CASE WHEN count(*) >= 2 THEN stddev_pop(dwell) ELSE 0 END AS std_hold_time_ms,
  CASE WHEN count(*) >= 2 THEN avg(flight) ELSE 0 END AS mean_flight_time_ms,
  CASE WHEN count(*) >= 2 THEN stddev_pop(flight) ELSE 0 END AS std_flight_time_ms,
  CASE WHEN count(*) >= 2 THEN count(*) FILTER (flight > 500) / greatest(count(flight), 1) ELSE 0 END
    AS pause_rate, CAST(count(*) AS DOUBLE) AS keystroke_count
FROM fl GROUP BY user_id, session_id""")
BASIC_SQL = ", ".join(["user_id", "session_id"] + [f"{r(n)} AS {n}" for n in (
    "mean_hold_time_ms", "std_hold_time_ms", "mean_flight_time_ms", "std_flight_time_ms",
    "pause_rate", "keystroke_count")])


@query("basic_timing_features", with_parts("basic", body=f"SELECT {BASIC_SQL} FROM basic"))
def basic_timing_features(spark, sf_dir):
    return stable(features.timing_features(key_events(spark, sf_dir)))


TEL_COLUMNS = (
    "mean_dwell_ms", "median_dwell_ms", "mean_flight_ms", "median_flight_ms", "pause_rate",
    "estimated_wpm", "error_rate", "duration_seconds")


@query("session_telemetry", with_parts("tel", body="SELECT user_id, session_id, event_count, "
       "pause_count, backspace_count, correction_count, "
       + ", ".join(f"{r(n)} AS {n}" for n in TEL_COLUMNS) + " FROM tel"))
def session_telemetry(spark, sf_dir):
    return stable(features.telemetry(down_up(spark, sf_dir)))


part("strain", "basic", sql="""
SELECT user_id, session_id, keystroke_count >= 5 AS enough,
  CASE WHEN keystroke_count >= 5 THEN round(100.0 * (0.45 * least(pause_rate / 0.4, 1.0)
    + 0.35 * least(std_flight_time_ms / 300.0, 1.0)
    + 0.20 * least(greatest((mean_hold_time_ms - 80.0) / 150.0, 0.0), 1.0)), 1) ELSE 0.0 END
    AS strain_score FROM basic""")


@query("strain_score", with_parts("strain", body="""
SELECT user_id, session_id, strain_score,
  CASE WHEN NOT enough THEN 'Insufficient Data'
       WHEN strain_score < 35 THEN 'Low Strain (Fluent Rhythm)'
       WHEN strain_score < 70 THEN 'Moderate Strain (Occasional Hesitation)'
       ELSE 'High Strain (Fragmented Rhythm / Fatigue Indicators)' END AS strain_category,
  CASE WHEN enough THEN 0.75 ELSE 0.0 END::DOUBLE AS confidence, false AS is_medical_diagnosis
FROM strain"""))
def strain_score(spark, sf_dir):
    timing = features.timing_features(key_events(spark, sf_dir))
    return features.strain_score(timing).select(
        "user_id", "session_id", "strain_score", "strain_category", "confidence",
        "is_medical_diagnosis")
