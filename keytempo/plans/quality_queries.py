"""Queries on data quality, validation, readiness and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from keytempo.operators import charts, evaluation, events, features, pairing, quality
from keytempo.operators import validation, windows
from keytempo.operators.groups import over_groups
from keytempo.plans.event_queries import canonical, delivered, session_table
from keytempo.plans.key_events import down_up, key_events, stable, table
from keytempo.plans.registry import query
from keytempo.plans.sql import part, r, with_parts


def unpivoted(rows) -> str:
    """``UNION ALL`` of one SELECT per (name, expressions) pair."""
    return "\nUNION ALL\n".join(rows)


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                 "o_orderpriority")
LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query("missing_values", with_parts("fl", body="""
, counted AS (SELECT count(*) AS n, count(*) FILTER (user_id IS NULL) AS a,
  count(*) FILTER (session_id IS NULL) AS b, count(*) FILTER (dwell IS NULL) AS c,
  count(*) FILTER (flight IS NULL) AS d FROM fl)
SELECT column_name, missing_count, round(100.0 * missing_count / n, 2) AS missing_percentage
FROM (SELECT n, unnest(['user_id', 'session_id', 'dwell_time', 'flight_time']) AS column_name,
        unnest([a, b, c, d]) AS missing_count FROM counted)"""))
def missing_values(spark, sf_dir):
    df = events.flight_times(key_events(spark, sf_dir)).withColumn(
        "dwell_time", F.col("release_time") - F.col("press_time"))
    return quality.missing_values(df.select("user_id", "session_id", "dwell_time", "flight_time"))


@query("missing_values_orders", "WITH c AS (SELECT count(*) AS n, "
       + ", ".join(f"count(*) FILTER ({c} IS NULL) AS m{i}" for i, c in enumerate(ORDER_COLUMNS))
       + " FROM orders)\n" + unpivoted(
           f"SELECT '{c}' AS column_name, m{i} AS missing_count, round(100.0 * m{i} / n, 2) "
           "AS missing_percentage FROM c" for i, c in enumerate(ORDER_COLUMNS)))
def missing_values_orders(spark, sf_dir):
    return quality.missing_values(table(spark, sf_dir, "orders"))


@query("duplicates", """
SELECT CAST(sum(copies) AS BIGINT) AS total_rows, CAST(sum(copies - 1) AS BIGINT)
  AS duplicate_count, round(100.0 * sum(copies - 1) / sum(copies), 2) AS duplicate_percentage,
  sum(copies - 1) > 0 AS has_duplicates
FROM (SELECT count(*) AS copies FROM lineitem
      GROUP BY l_orderkey, l_returnflag, l_linestatus)""")
def duplicates(spark, sf_dir):
    return quality.duplicates(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag", "l_linestatus"])


@query("bad_timestamps", with_parts("ev", body="""
SELECT user_id, session_id, count(*) FILTER (release_time IS NULL) AS null_timestamps,
  count(*) FILTER (release_time < 0) AS negative_timestamps,
  count(*) FILTER (release_time < before) AS disordered_timestamps,
  count(*) FILTER (release_time IS NULL) = 0 AND count(*) FILTER (release_time < 0) = 0 AS is_valid
FROM (SELECT *, last_value(release_time IGNORE NULLS) OVER (PARTITION BY user_id, session_id
        ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev)
GROUP BY user_id, session_id"""))
def bad_timestamps(spark, sf_dir):
    return quality.bad_timestamps(key_events(spark, sf_dir), "release_time")


@query("negative_durations", with_parts("fl", body="""
, gaps AS (SELECT press_time - before AS gap, dwell - 100 AS d FROM fl)
SELECT 'dwell_time' AS column_name, count(*) FILTER (d < 0) AS violations FROM gaps
UNION ALL SELECT 'interval', count(*) FILTER (gap < 0) FROM gaps"""))
def negative_durations(spark, sf_dir):
    """Signed gaps between keys, and holds short of 100 ms."""
    df = key_events(spark, sf_dir)
    gaps = over_groups(
        df, ("user_id", "session_id"), ("press_time", "event_id"),
        lambda g: g.derive(g.rows, shift={"_before": ("release_time", 1)}).select(
            (F.col("release_time") - F.col("press_time") - 100.0).alias("dwell_time"),
            (F.col("press_time") - F.col("_before")).alias("interval")))
    return quality.negative_durations(gaps)


@query("numeric_anomalies", with_parts("fl", body="""
, x AS (SELECT CASE WHEN backspace = 1 THEN 'infinity'::DOUBLE ELSE dwell * 10 END AS dwell_time,
        flight AS flight_time FROM fl)
SELECT 'dwell_time' AS column_name, count(*) FILTER (isinf(dwell_time)) AS infinite_values,
  count(*) FILTER (dwell_time IS NULL) AS nan_values,
  count(*) FILTER (dwell_time > 4000) AS extreme_dwell FROM x
UNION ALL SELECT 'flight_time', count(*) FILTER (isinf(flight_time)),
  count(*) FILTER (flight_time IS NULL), 0 FROM x"""))
def numeric_anomalies(spark, sf_dir):
    """Holds scaled by ten, endless for error events."""
    df = events.flight_times(key_events(spark, sf_dir))
    hold = (F.col("release_time") - F.col("press_time")) * 10
    return quality.numeric_anomalies(df.select(
        F.when(F.col("backspace") == 1, F.lit(float("inf"))).otherwise(hold).alias("dwell_time"),
        "flight_time"))


@query("class_balance", """
SELECT label, class_count, round(class_count / sum(class_count) OVER (), 4) AS class_proportion,
  round(max(class_count) OVER () / min(class_count) OVER (), 2) AS imbalance_ratio,
  round(max(class_count) OVER () / min(class_count) OVER (), 2) > 3 AS is_imbalanced
FROM (SELECT event_type AS label, count(*) AS class_count FROM events GROUP BY event_type)""")
def class_balance(spark, sf_dir):
    return quality.class_balance(table(spark, sf_dir, "events"), "event_type")


part("scored", "fl", sql="""
SELECT user_id, session_id, key_token, dwell AS dwell_time, flight AS flight_time FROM fl
UNION ALL SELECT user_id, session_id, key_token, dwell, flight FROM fl WHERE backspace = 1""")
part("scored_rows", "scored", sql="""
SELECT user_id, session_id, key_token, dwell_time, flight_time, count(*) AS copies,
  CAST(flight_time IS NULL AS BIGINT) AS missing FROM scored GROUP BY ALL""")
part("totals", "scored_rows", sql="""
SELECT sum(copies) AS n, sum(missing * copies) AS missing, sum(copies - 1) AS dups,
  bool_or(missing > 0 OR dwell_time > 4000) AS odd FROM scored_rows""")


@query("quality_score", with_parts("totals", body="""
, s AS (SELECT *, 100.0 * missing / (n * 5) AS pct, greatest(0.0, least(100.0, round(100.0
    - least(100.0 * missing / (n * 5) * 3.0, 30.0)
    - least(round(100.0 * dups / n, 2) * 2.0, 20.0)
    - CASE WHEN odd THEN 15.0 ELSE 0.0 END, 1))) AS score FROM totals)
SELECT CAST(score AS DOUBLE) AS quality_score, CASE WHEN score >= 85 THEN 'EXCELLENT'
    WHEN score >= 65 THEN 'ACCEPTABLE' ELSE 'CRITICAL_ISSUES' END AS status,
  round(pct, 2) AS missing_percentage, CAST(missing AS BIGINT) AS total_missing_values,
  CAST(dups AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS negative_durations,
  odd AS has_numeric_anomalies FROM s"""))
def quality_score(spark, sf_dir):
    df = delivered(spark, sf_dir).select(
        "user_id", "session_id", "key_token",
        (F.col("release_time") - F.col("press_time")).alias("dwell_time"), "flight_time")
    return quality.quality_score(df)


@query("profile", with_parts("scored_rows", body="""
SELECT CAST(sum(copies) AS BIGINT) AS row_count, CAST(5 AS INTEGER) AS column_count,
  'user_id' AS user_column, 'session_id' AS session_column, 'dwell_time' AS timestamp_column,
  CAST(NULL AS VARCHAR) AS label_column, 'dwell_time,flight_time' AS keystroke_columns,
  '' AS sensitive_columns, CAST(sum(missing * copies) AS BIGINT) AS missing_cells,
  round(100.0 * sum(missing * copies) / (sum(copies) * 5), 2) AS missing_percentage,
  CAST(sum(copies - 1) AS BIGINT) AS duplicate_rows,
  round(100.0 * sum(copies - 1) / sum(copies), 2) AS duplicate_percentage,
  count(DISTINCT user_id) AS unique_users, count(DISTINCT session_id) AS unique_sessions,
  CAST(0 AS BIGINT) AS unique_labels FROM scored_rows"""))
def profile(spark, sf_dir):
    df = delivered(spark, sf_dir).select(
        "user_id", "session_id", "key_token",
        (F.col("release_time") - F.col("press_time")).alias("dwell_time"), "flight_time")
    return quality.profile(df)


_CHECKED = ("mean_dwell_time", "std_flight_time", "mean_flight_time", "pause_rate",
            "backspace_rate", "keystroke_count")


@query("feature_check", with_parts("sf", body=unpivoted(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing, CAST(0 AS BIGINT) "
    f"AS infinite, count(*) FILTER ({c} IS NULL) = 0 AS is_valid FROM sf" for c in _CHECKED)))
def feature_check(spark, sf_dir):
    return quality.feature_check(
        session_table(spark, sf_dir).select("user_id", "session_id", *_CHECKED))


@query("canonical_check", with_parts("raw", body="""
, p AS (SELECT *, CASE WHEN nxt = 'up' THEN nxt_time END AS release_time
  FROM (SELECT *, lead(event_type) OVER k AS nxt, lead(timestamp_ms) OVER k AS nxt_time FROM raw
        WINDOW k AS (PARTITION BY user_id, session_id, key_token ORDER BY timestamp_ms, raw_id))
  WHERE event_type = 'down')
""" + unpivoted(
    f"SELECT '{name}' AS check_name, CAST({expr} AS BIGINT) AS violations, "
    f"CAST({expr} AS BIGINT) = 0 AS passed, '{kind}' AS severity FROM p" for name, expr, kind in (
        ("empty_table", "CASE WHEN count(*) = 0 THEN 1 ELSE 0 END", "error"),
        ("forbidden_columns", "min(0)", "error"), ("missing_columns", "min(0)", "error"),
        ("null_participant_id", "count(*) - count(user_id)", "error"),
        ("null_session_id", "count(*) - count(session_id)", "error"),
        ("null_timestamp", "count(*) - count(timestamp_ms)", "error"),
        ("null_condition", "count(*) - count(state)", "error"),
        ("not_numeric_columns", "min(0)", "error"), ("raw_key_identifiers", "min(0)", "error"),
        ("event_types", "count(*) FILTER (event_type NOT IN ('down', 'up'))", "error"),
        ("release_before_press", "count(*) FILTER (release_time < timestamp_ms)", "warning")))))
def canonical_check(spark, sf_dir):
    return quality.canonical_check(pairing.pair_canonical(canonical(spark, sf_dir)), strict=True)


@query("privacy_audit", """
SELECT count(*) AS row_count, CAST(NULL AS DOUBLE) AS pseudonym_share, 'text' AS raw_text_columns,
  'UNKNOWN' AS pseudonymization_status, 'FAIL' AS privacy_result, false AS zero_text_compliant
FROM documents""")
def privacy_audit(spark, sf_dir):
    return quality.privacy_audit(table(spark, sf_dir, "documents"))


@query("privacy_audit_ids", """
SELECT count(*) AS row_count, 0.0::DOUBLE AS pseudonym_share, '' AS raw_text_columns,
  'UNMASKED_OR_NATIVE' AS pseudonymization_status, 'PASS' AS privacy_result,
  true AS zero_text_compliant FROM customer""")
def privacy_audit_ids(spark, sf_dir):
    return quality.privacy_audit(table(spark, sf_dir, "customer"), "c_name")


# --- validation -------------------------------------------------------------------------------

@query("participant_breakdown", with_parts("ev", body="""
SELECT user_id, count(DISTINCT session_id) AS session_count, count(*) AS record_count,
  count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views
FROM (SELECT *, substr(key_token, 3) AS event_type FROM ev) GROUP BY user_id"""))
def participant_breakdown(spark, sf_dir):
    df = validation.participant_breakdown(key_events(spark, sf_dir), label="key_token")
    per = F.col("condition_distribution")
    return df.select(
        "user_id", "session_count", "record_count",
        F.coalesce(F.try_element_at(per, F.lit("k_click")), F.lit(0)).alias("clicks"),
        F.coalesce(F.try_element_at(per, F.lit("k_view")), F.lit(0)).alias("views"))


@query("participant_spread", with_parts("ev", body="""
, p AS (SELECT count(DISTINCT session_id) AS s, count(*) AS n FROM ev GROUP BY user_id)
SELECT 'session_count' AS measure, min(s) AS min_value, median(s) AS median_value,
  max(s) AS max_value, count(*) AS participants FROM p
UNION ALL SELECT 'record_count', min(n), median(n), max(n), count(*) FROM p"""))
def participant_spread(spark, sf_dir):
    return validation.participant_spread(
        validation.participant_breakdown(key_events(spark, sf_dir)))


@query("length_profile", with_parts("ev", body="""
, l AS (SELECT count(*) AS n FROM ev GROUP BY user_id, session_id)
SELECT count(*) AS sessions, min(n) AS min_session_length,
  CAST(floor(quantile_cont(n, 0.25)) AS BIGINT) AS p25_session_length,
  CAST(floor(median(n)) AS BIGINT) AS median_session_length,
  CAST(floor(quantile_cont(n, 0.75)) AS BIGINT) AS p75_session_length,
  max(n) AS max_session_length,
  CAST(least(30, greatest(10, floor(floor(median(n)) / 2))) AS BIGINT)
    AS recommended_sequence_length FROM l"""))
def length_profile(spark, sf_dir):
    return validation.length_profile(key_events(spark, sf_dir))


@query("label_granularity", with_parts("ev", body="""
SELECT max(labels) AS max_labels, CASE WHEN max(labels) = 1 THEN 'session-level'
  ELSE 'event-level' END AS label_granularity
FROM (SELECT count(DISTINCT state) AS labels FROM ev GROUP BY session_id)"""))
def label_granularity(spark, sf_dir):
    return validation.label_granularity(key_events(spark, sf_dir))


part("gaps", "ev", sql="""
SELECT user_id, session_id, count(*) AS events, count(*) FILTER (step < 0) AS backward_steps,
  count(*) FILTER (step > 2000) AS large_gaps, min(release_time) AS first_time,
  max(release_time) AS last_time
FROM (SELECT *, release_time - lag(release_time) OVER (PARTITION BY user_id, session_id
                                                       ORDER BY event_id) AS step FROM ev)
GROUP BY user_id, session_id""")


@query("time_gaps", with_parts("gaps", body="""
SELECT user_id, session_id, events, backward_steps, large_gaps, first_time AS start_time,
  last_time AS end_time, backward_steps = 0 AS monotonic FROM gaps"""))
def time_gaps(spark, sf_dir):
    out = validation.time_gaps(key_events(spark, sf_dir), "release_time", gap_ms=2000.0)
    return out.withColumnsRenamed({"first_time": "start_time", "last_time": "end_time"})


def _check(name, value, passed):
    return (f"SELECT '{name}' AS check_name, CAST({value} AS DOUBLE) AS value, "
            f"CAST({passed} AS BOOLEAN) AS passed FROM v")


@query("validation_report", with_parts("delivered", body="""
, p AS (SELECT user_id, count(DISTINCT session_id) AS s, count(*) AS n FROM delivered
        GROUP BY user_id),
steps AS (SELECT *, "timestamp" - lag("timestamp") OVER (PARTITION BY user_id, session_id
            ORDER BY event_id) AS step FROM delivered),
d AS (SELECT flight_time, count(*) AS w FROM delivered
      GROUP BY user_id, session_id, "timestamp", key_token, press_time, release_time, flight_time,
        state),
v AS (SELECT (SELECT sum(n) FROM p) AS records, (SELECT count(*) FROM p) AS people,
  (SELECT sum(s) FROM p) AS sessions, (SELECT count(*) FILTER (s >= 5) FROM p) AS eligible,
  (SELECT count(DISTINCT state) FROM delivered) AS classes,
  (SELECT count(*) FILTER (step < 0) FROM steps) AS backward,
  (SELECT count(*) FILTER (step > 10000) FROM steps) AS gaps,
  (SELECT max("timestamp") - min("timestamp") FROM delivered) AS span,
  (SELECT sum(w - 1) FROM d) AS copies,
  (SELECT coalesce(sum(w) FILTER (flight_time < 0 OR flight_time > 10000), 0) FROM d) AS bad_flight)
""" + unpivoted(_check(*x) for x in (
    ("total_records", "records", "records > 0"), ("total_participants", "people", "people > 0"),
    ("total_sessions", "sessions", "sessions > 0"), ("missing_user_ids", "0", "true"),
    ("missing_labels", "0", "true"), ("duplicate_records", "copies", "copies = 0"),
    ("behavioral_classes", "classes", "classes >= 2"), ("labels_per_session", "1", "true"),
    ("backward_steps", "backward", "backward = 0"), ("large_timing_gaps", "gaps", "gaps = 0"),
    ("implausible_dwell", "0", "true"),
    ("implausible_flight", "bad_flight", "bad_flight = 0"), ("time_span", "span", "true"),
    ("groups_sufficient_for_splitting", "people >= 3 OR sessions >= 6",
     "people >= 3 OR sessions >= 6"),
    ("baseline_ready_participants", "eligible", "eligible > 0"),
    ("feature_dwell_time", "1", "true"), ("feature_flight_time", "1", "true"),
    ("feature_pause_duration", "1", "true"), ("feature_typing_speed", "1", "true"),
    ("feature_backspace_features", "0", "false"), ("feature_error_features", "0", "false"),
    ("feature_pressure", "0", "false"), ("feature_spatial_trajectory_xy", "0", "false"),
    ("feature_word_completion_time", "0", "false"),
    ("feature_explicit_lexical_token", "0", "false"),
    ("training_ready", "(people >= 3 OR sessions >= 6) AND classes >= 2",
     "(people >= 3 OR sessions >= 6) AND classes >= 2")))))
def validation_report(spark, sf_dir):
    return validation.validate_dataset(delivered(spark, sf_dir))


@query("dataset_verdict", with_parts("ev", body="""
SELECT CASE WHEN count(DISTINCT state) < 2 THEN 'blocked_missing_labels'
  WHEN count(DISTINCT user_id) >= 3 THEN 'validated' ELSE 'ready_for_validation' END AS status
FROM ev"""))
def dataset_verdict(spark, sf_dir):
    return validation.dataset_verdict(validation.validate_dataset(delivered(spark, sf_dir)))


_MANIFEST = {  # feature suffix or name: (source columns or NULL, share of presses that have it)
    "dwell_time": ("'press_time+release_time'", "1.0"), "flight_time": ("'flight_time'", "f"),
    "pause_rate": ("'flight_time'", "f"), "pause_duration": ("'flight_time'", "f"),
    "long_pause_count": ("'flight_time'", "f"),
    "typing_speed_wpm": ("'press_time+release_time'", "1.0"),
    "backspaces": ("'backspace'", "1.0"), "backspace_rate": ("'backspace'", "1.0"),
    "errors": ("'error_flag'", "1.0"), "error_rate": ("'error_flag'", "1.0"),
    "completion_time": ("NULL", "0.0"), "completion_variability": ("NULL", "0.0"),
    "session_duration_sec": ("'press_time'", "1.0"), "keystroke_count": ("'press_time'", "1.0"),
}
_FEATURES = (
    [f"{s}_dwell_time" for s in ("mean", "median", "std", "min", "max", "p25", "p75", "cv", "mad")]
    + [f"{s}_flight_time" for s in ("mean", "median", "std", "min", "max", "cv", "mad")]
    + ["pause_rate", "mean_pause_duration", "median_pause_duration", "max_pause_duration",
       "long_pause_count", "mean_typing_speed_wpm", "median_typing_speed_wpm",
       "std_typing_speed_wpm", "total_backspaces", "backspace_rate", "total_errors", "error_rate",
       "mean_word_completion_time", "word_completion_variability", "session_duration_sec",
       "keystroke_count"])


def _manifest_row(name: str) -> str:
    source, share = next(v for k, v in _MANIFEST.items() if name.endswith(k))
    return (f"SELECT '{name}' AS feature_name, {source} IS NOT NULL AS available, "
            f"CAST({source} AS VARCHAR) AS source_columns, {r(f'CAST({share} AS DOUBLE)')} "
            "AS non_null_share FROM n")


@query("feature_manifest", with_parts("fl", body="""
, n AS (SELECT count(flight) / count(*) AS f FROM fl)
""" + unpivoted(map(_manifest_row, _FEATURES))))
def feature_manifest(spark, sf_dir):
    return stable(validation.feature_manifest(
        events.flight_times(key_events(spark, sf_dir)).drop("timestamp")).select(
            "feature_name", "available", "source_columns", "non_null_share"))


part("gate", "pairs", sql="""
SELECT user_id, session_id, count(*) AS total_paired_events,
  CASE WHEN count(*) >= 2 THEN greatest(0.0, (arg_max(release_time, sequence_index)
    - arg_min(press_time, sequence_index)) / 1000.0) ELSE 0 END AS duration_seconds,
  count(*) FILTER (dwell_time > 0) AS valid_dwell_count,
  count(*) FILTER (flight_time >= 0) AS valid_flight_count,
  CAST(0 AS BIGINT) AS non_finite_count, CAST(0 AS BIGINT) AS negative_timing_count
FROM pairs GROUP BY user_id, session_id""")
part("gated", "gate", sql="""
SELECT *, concat_ws(',', CASE WHEN total_paired_events < 15 THEN 'insufficient_events' END,
  CASE WHEN duration_seconds < 3 THEN 'duration_too_short' END,
  CASE WHEN valid_dwell_count < 5 THEN 'insufficient_dwell' END,
  CASE WHEN valid_flight_count < 4 THEN 'insufficient_flight' END) AS reasons FROM gate""")


@query("session_gate", with_parts("gated", body=f"""
SELECT * REPLACE ({r('duration_seconds')} AS duration_seconds), reasons = '' AS is_valid,
  CASE WHEN reasons = '' THEN 'SESSION_VALID' ELSE 'INSUFFICIENT_DATA' END AS verdict
FROM gated"""))
def session_gate(spark, sf_dir):
    return stable(validation.session_gate(pairing.pair_live(down_up(spark, sf_dir))))


@query("session_evidence", with_parts("gated", "tel", body=f"""
SELECT g.user_id, g.session_id, total_paired_events, valid_dwell_count, valid_flight_count,
  reasons, {r('g.duration_seconds')} AS duration_seconds, {r('mean_dwell_ms')} AS mean_dwell_ms,
  {r('median_flight_ms')} AS median_flight_ms, {r('estimated_wpm')} AS estimated_wpm
FROM gated g JOIN tel t ON g.user_id = t.user_id AND g.session_id = t.session_id"""))
def session_evidence(spark, sf_dir):
    return stable(validation.session_evidence(down_up(spark, sf_dir)).select(
        "user_id", "session_id", "total_paired_events", "valid_dwell_count",
        "valid_flight_count", "reasons", "duration_seconds", "mean_dwell_ms",
        "median_flight_ms", "estimated_wpm"))


part("spans", "features", sql="""
SELECT user_id, session_id, n, first_label, unnest(range(0, (n - 10) // 5 + 1)) AS window_index
FROM (SELECT user_id, session_id, count(*) AS n, arg_min(state, sequence_index) AS first_label
      FROM features GROUP BY user_id, session_id) WHERE n >= 10""")


@query("training_readiness", with_parts("spans", body="""
, c AS (SELECT first_label, count(*) AS n FROM spans GROUP BY first_label),
v AS (SELECT (SELECT count(*) FROM spans) AS samples, (SELECT count(*) FROM c) AS classes,
  (SELECT min(n) FROM c) AS fewest, (SELECT max(n) FROM c) AS most,
  (SELECT count(DISTINCT user_id) FROM spans) AS users)
""" + unpivoted(
    f"SELECT '{k}' AS check_name, CAST({val} AS DOUBLE) AS value, "
    f"CAST({ok} AS BOOLEAN) AS passed, '{sev}' AS severity FROM v" for k, val, ok, sev in (
        ("samples", "samples", "samples > 0", "error"), ("nan_values", "0", "true", "error"),
        ("infinite_values", "0", "true", "error"), ("timesteps", "10", "true", "error"),
        ("features", "6", "true", "error"), ("null_labels", "0", "true", "error"),
        ("classes", "classes", "classes >= 2", "error"),
        ("smallest_class", "fewest", "fewest >= 2", "error"),
        ("imbalance_ratio", "round(most / fewest, 6)", "most / fewest <= 3", "warning"),
        ("users", "users", "users >= 2", "warning")))))
def training_readiness(spark, sf_dir):
    return stable(validation.training_readiness(
        labelled_windows(spark, sf_dir), timesteps=10, features=6))


def labelled_windows(spark, sf_dir, **options):
    """Windows of ten events every five, labelled with the session's condition."""
    spec = windows.Windows(length=10, stride=5, label="state", **options)
    return windows.live_windows(down_up(spark, sf_dir), spec)


# --- chart series -----------------------------------------------------------------------------

@query("hold_histogram", with_parts("fl", body=f"""
SELECT bin, {r('bin * 25.0::DOUBLE')} AS bin_start, {r('(bin + 1) * 25.0::DOUBLE')} AS bin_end, count(*) AS events
FROM (SELECT CAST(greatest(0, least(19, floor(dwell / 25.0))) AS INTEGER) AS bin FROM fl)
GROUP BY bin"""))
def hold_histogram(spark, sf_dir):
    df = key_events(spark, sf_dir).select(
        (F.col("release_time") - F.col("press_time")).alias("hold"))
    return stable(charts.chart_histogram(df, "hold", 0.0, 500.0))


@query("timing_timeline", with_parts("fl", body=f"""
SELECT user_id, session_id, row_number() OVER (PARTITION BY user_id, session_id
    ORDER BY press_time, event_id) - 1 AS event_index, {r('dwell')} AS dwell_time,
  {r('flight')} AS flight_time FROM fl"""))
def timing_timeline(spark, sf_dir):
    df = events.flight_times(key_events(spark, sf_dir)).withColumn(
        "dwell_time", F.col("release_time") - F.col("press_time"))
    return stable(charts.chart_timeline(
        df, ["dwell_time", "flight_time"], order=("press_time", "event_id")))


@query("pause_bars", with_parts("features", body=f"""
SELECT user_id, session_id, sequence_index AS event_index, {r('pause_duration')} AS pause_duration,
  500.0::DOUBLE AS threshold_ms, pause_duration > 500 AS is_pause FROM features"""))
def pause_bars(spark, sf_dir):
    return stable(charts.chart_pauses(events.event_features(down_up(spark, sf_dir))))


@query("cumulative_corrections", with_parts("ev", body="""
SELECT user_id, session_id, row_number() OVER w - 1 AS event_index, CAST(backspace AS BIGINT)
  AS correction, CAST(sum(backspace) OVER w AS BIGINT) AS cumulative_corrections
FROM ev WINDOW w AS (PARTITION BY user_id, session_id ORDER BY press_time, event_id)"""))
def cumulative_corrections(spark, sf_dir):
    return charts.chart_corrections(key_events(spark, sf_dir), order=("press_time", "event_id"))


part("personal", "tel", sql="""
SELECT user_id, avg(mean_dwell_ms) AS mean_dwell_ms, avg(mean_flight_ms) AS mean_flight_ms,
  avg(pause_rate) AS pause_rate, avg(estimated_wpm) AS estimated_wpm,
  avg(backspace_count) AS backspace_count FROM tel GROUP BY user_id""")


@query("baseline_comparison", with_parts("personal", body=unpivoted(
    f"SELECT t.user_id, t.session_id, '{label}' AS metric, {r(cur)} AS current_value, "
    f"{r(base)} AS baseline_value FROM tel t JOIN personal p USING (user_id)"
    for label, cur, base in (
        ("Dwell Time (ms)", "t.mean_dwell_ms", "p.mean_dwell_ms"),
        ("Flight Time (ms)", "t.mean_flight_ms", "p.mean_flight_ms"),
        ("Pause Rate (%)",
         "CASE WHEN t.pause_rate <= 1 THEN t.pause_rate * 100 ELSE t.pause_rate END",
         "CASE WHEN p.pause_rate <= 1 THEN p.pause_rate * 100 ELSE p.pause_rate END"),
        ("Cadence (WPM)", "t.estimated_wpm", "p.estimated_wpm"),
        ("Corrections", "CAST(t.backspace_count AS DOUBLE)", "p.backspace_count")))))
def baseline_comparison(spark, sf_dir):
    current = features.telemetry(down_up(spark, sf_dir))
    means = current.groupBy("user_id").agg(*[
        F.avg(m).alias(m) for m in ("mean_dwell_ms", "mean_flight_ms", "pause_rate",
                                    "estimated_wpm", "backspace_count")])
    return stable(charts.chart_baseline_compare(current, means))


# --- assessment gate --------------------------------------------------------------------------

@query("assessment_state", with_parts("sf", body="""
, b AS (SELECT user_id, count(*) >= 5 AS has_baseline FROM sf GROUP BY user_id)
SELECT user_id, session_id, keystroke_count,
  CASE WHEN keystroke_count < 5 THEN 'insufficient_data'
       WHEN keystroke_count >= 10 AND has_baseline THEN 'ready'
       WHEN keystroke_count >= 10 THEN 'prediction_available'
       WHEN has_baseline THEN 'baseline_available' ELSE 'model_unavailable' END
    AS assessment_state,
  keystroke_count >= 5 AND (keystroke_count >= 10 OR has_baseline) AS assessment_ready
FROM sf JOIN b USING (user_id)"""))
def assessment_state(spark, sf_dir):
    """Sessions of ten events have a model window, people with five sessions a baseline."""
    sessions = session_table(spark, sf_dir).select("user_id", "session_id", "keystroke_count")
    status = sessions.groupBy("user_id").agg(
        F.when(F.count(F.lit(1)) >= 5, "available").otherwise("insufficient_history")
        .alias("baseline_status"))
    joined = sessions.join(status, "user_id").withColumn(
        "model_available", F.col("keystroke_count") >= 10)
    return validation.assessment_state(joined).drop("baseline_status", "model_available")


# --- evaluation -------------------------------------------------------------------------------

part("cells", sql="""
SELECT quality AS y, toxic AS yhat, count(*) AS n FROM labels
WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL""")
part("per_class", "cells", sql="""
SELECT label, coalesce((SELECT sum(n) FROM cells WHERE y = label), 0) AS support,
  coalesce((SELECT sum(n) FROM cells WHERE yhat = label), 0) AS predicted,
  coalesce((SELECT sum(n) FROM cells WHERE y = label AND yhat = label), 0) AS hits
FROM (SELECT y AS label FROM cells UNION SELECT yhat FROM cells)""")
part("scores", "per_class", sql="""
SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT *,
  CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p,
  CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM per_class)""")


@query("classification_metrics", with_parts("scores", body=f"""
SELECT CAST(sum(support) AS BIGINT) AS samples_evaluated, count(*) AS num_classes,
  {r('sum(hits) / sum(support)')} AS accuracy,
  {r('avg(r) FILTER (support > 0)')} AS balanced_accuracy, {r('avg(p)')} AS macro_precision,
  {r('sum(p * support) / sum(support)')} AS weighted_precision, {r('avg(r)')} AS macro_recall,
  {r('sum(r * support) / sum(support)')} AS weighted_recall, {r('avg(f1)')} AS macro_f1,
  {r('sum(f1 * support) / sum(support)')} AS weighted_f1 FROM scores"""))
def classification_metrics(spark, sf_dir):
    return stable(evaluation.classification_metrics(
        table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("per_class_metrics", with_parts("scores", body=f"""
SELECT label, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted,
  CAST(hits AS BIGINT) AS hits, {r('p')} AS precision, {r('r')} AS recall, {r('f1')} AS f1_score
FROM scores"""))
def per_class_metrics(spark, sf_dir):
    return stable(evaluation.per_class_metrics(
        table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("confusion_matrix", with_parts("per_class", body=f"""
, grid AS (SELECT a.label AS y, b.label AS yhat FROM per_class a, per_class b)
SELECT y, yhat, coalesce(n, 0) AS n,
  {r('coalesce(n, 0) / greatest(sum(coalesce(n, 0)) OVER (PARTITION BY y), 1)')} AS row_share
FROM grid LEFT JOIN cells USING (y, yhat)"""))
def confusion_matrix(spark, sf_dir):
    return stable(evaluation.confusion_matrix(
        table(spark, sf_dir, "labels"), "quality", "toxic"))
