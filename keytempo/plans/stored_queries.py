"""Queries over tables that a run has stored, and on rows with faults: feature run, archive scan, splits, states, texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from keytempo.operators import assessments, baselines, cleaning, events, splits, validation
from keytempo.plans import feature_run
from keytempo.plans.baseline_queries import _STATS, LEVEL_SQL, deviations
from keytempo.plans.event_queries import session_table
from keytempo.plans.key_events import key_events, scratch, stable, table, written
from keytempo.plans.quality_queries import labelled_windows
from keytempo.plans.record_queries import NOW, artifacts, assessed
from keytempo.plans.record_queries import stored_sessions as stored_rows
from keytempo.plans.registry import query
from keytempo.plans.sql import r, with_parts
from keytempo.sources import dated, tables
from keytempo.streaming import incremental, sinks

_RUN_SQL = with_parts("split2", "ev", body="""
, clean AS (SELECT * FROM ev WHERE release_time - press_time BETWEEN 10 AND 4000),
sizes AS (SELECT user_id, session_id, count(*) AS n FROM clean GROUP BY user_id, session_id),
f AS (SELECT split, count(*) AS n FROM sizes JOIN split2 USING (user_id) GROUP BY split),
counts AS (
  SELECT 'clean_events' AS step, count(*) AS row_count FROM clean
  UNION ALL SELECT 'windows', CAST(coalesce(sum((n - 20) // 5 + 1), 0) AS BIGINT) FROM sizes WHERE n >= 20
  UNION ALL SELECT 'features_' || split, n FROM f)
SELECT source, step, row_count FROM counts, (VALUES ('csv'), ('json')) AS s(source)""")


@query("feature_run_counts", _RUN_SQL)
def feature_run_counts(spark, sf_dir):
    """The whole feature run on the events written as CSV and as JSON lines, with scaler and windows stored."""
    folder, out = scratch(spark), None
    for fmt, name in (("csv", "events.csv"), ("json", "events.jsonl")):
        tables.write_table(key_events(spark, sf_dir), f"{folder}/{name}", fmt)
        counts = feature_run.run_features(
            spark, f"{folder}/{name}", f"{folder}/{fmt}-run", row_id="event_id").withColumn("source", F.lit(fmt))
        out = counts if out is None else out.unionByName(counts)
    return out.select("source", "step", "row_count")


@query("archive_scan", with_parts("judgement", body=f"""
, k AS (SELECT *, TRY_CAST(user_id AS BIGINT) % 5 AS kind FROM judgement)
SELECT CASE WHEN kind = 0 THEN 'CORRUPTED' WHEN kind = 1 THEN 'BLOCKED' WHEN reasons = '' THEN 'VALID' ELSE 'INVALID' END
    AS quality, kind < 2 AS is_corrupted, count(*) AS sessions,
  CAST(sum(CASE WHEN kind < 2 THEN 0 ELSE total_paired_events END) AS BIGINT) AS event_count,
  {r("sum(CASE WHEN kind < 2 THEN 0 ELSE duration_seconds END)", 3)} AS duration_s,
  count(*) FILTER (kind >= 2 AND baseline_status = 'available') AS with_baseline,
  count(*) FILTER (kind >= 2) AS with_class FROM k GROUP BY ALL"""))
def archive_scan(spark, sf_dir):
    """Assessment documents of all persons and sessions, written as JSON lines and scanned again.

    The documents of every fifth person are damaged, those of the next hold a forbidden key.
    """
    rows = assessments.assessment_rows(assessed(spark, sf_dir))
    kind = F.col("pseudonymized_user_id").cast("long") % 5
    text = (F.when(kind == 0, F.expr("substring(assessment_json, 1, length(assessment_json) - 2)"))
            .when(kind == 1, F.concat(F.lit('{"raw_text": "x", '), F.expr("substring(assessment_json, 2)")))
            .otherwise(F.col("assessment_json")))
    folder = f"{scratch(spark)}/archive"
    tables.write_documents(rows.select(text.alias("assessment_json")), folder)
    found = tables.list_sessions(spark, folder, one_per_file=False)
    return stable(found.groupBy("quality", "is_corrupted").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("event_count").cast("long").alias("event_count"),
        F.round(F.sum("duration_s"), 3).alias("duration_s"),
        F.count_if(F.col("baseline_status") == "READY").alias("with_baseline"),
        F.count_if(F.col("predicted_class").isNotNull()).alias("with_class")))


@query("upsert_profiles", with_parts("sf", body=f"""
SELECT user_id, max(session_id) AS last_updated,
  {r("arg_max(mean_dwell_time, session_id)")} AS dwell, arg_max(keystroke_count, session_id) AS sample_count
FROM sf GROUP BY user_id"""))
def upsert_profiles(spark, sf_dir):
    """Profiles with a map of features: every session writes its person's profile, the last one stays."""
    rows = session_table(spark, sf_dir).select(
        "user_id", F.col("session_id").alias("last_updated"),
        F.create_map(F.lit("mean_dwell_time"), F.col("mean_dwell_time")).alias("features"),
        F.col("keystroke_count").alias("sample_count"))
    base = rows.filter(F.col("last_updated") < "2024-01-15")
    merged = assessments.merge_by_key(
        assessments.latest_profile(base).select(*rows.columns), rows, ["user_id"], "last_updated")
    return stable(merged.select("user_id", "last_updated", F.element_at("features", F.lit("mean_dwell_time")).alias("dwell"),
                                "sample_count"))


@query("sequential_split_text_id", """
WITH n AS (SELECT count(*) AS n FROM orders), k AS (
  SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR))) - 1 AS rank FROM orders)
SELECT o_orderkey, CASE WHEN rank < CAST(floor(n * (1.0::DOUBLE - 0.15::DOUBLE - 0.15::DOUBLE)) AS BIGINT) THEN 'train'
  WHEN rank < CAST(floor(n * (1.0::DOUBLE - 0.15::DOUBLE)) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM k, n""")
def sequential_split_text_id(spark, sf_dir):
    """Rows cut in the order of a text."""
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("id"))
    return splits.sequential_split(rows, "id", 0.15, 0.15).select("o_orderkey", "split")


@query("grouped_split_missing", with_parts("split2", body="""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN event_id % 7 = 0 THEN 'unassigned' ELSE split END AS split FROM ev JOIN split2 USING (user_id)"""))
def grouped_split_missing(spark, sf_dir):
    """Every seventh event has lost its person and stays in the result without a partition."""
    rows = key_events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("user_id"))
    return splits.grouped_split(rows)


_FAULTS = """CASE event_id % 9 WHEN 0 THEN -1.0 WHEN 1 THEN NULL ELSE "timestamp" END"""


@query("clean_reasons", with_parts("fl", body=f"""
, w AS (SELECT event_id, {_FAULTS} AS t, CASE event_id % 9 WHEN 2 THEN 3.0 WHEN 3 THEN 9000.0 ELSE dwell END AS d,
    CASE event_id % 9 WHEN 4 THEN press_time - 5.0 ELSE release_time END AS release_time, press_time,
    CASE event_id % 9 WHEN 5 THEN -500.0 WHEN 6 THEN 20000.0 WHEN 7 THEN -50.0 ELSE flight END AS f FROM fl),
j AS (SELECT *, CASE WHEN t IS NULL OR t < 0 THEN 'invalid_timestamp' WHEN d < 10 THEN 'short_dwell'
    WHEN d > 4000 THEN 'long_dwell' WHEN release_time - press_time < 10 OR release_time - press_time > 4000 THEN
      'bad_computed_dwell' WHEN f < -200 THEN 'negative_flight' WHEN f > 10000 THEN 'long_flight' END AS reason FROM w)
SELECT event_id, reason, {r('CASE WHEN reason IS NULL AND f < 0 THEN 0.0 ELSE f END')} AS flight_time FROM j"""))
def clean_reasons(spark, sf_dir):
    """Rows with a fault of every kind; mildly negative flights of clean rows become 0."""
    nth = F.col("event_id") % 9
    rows = events.flight_times(key_events(spark, sf_dir)).select(
        "event_id", "press_time",
        F.when(nth == 0, -1.0).when(nth == 1, F.lit(None)).otherwise(F.col("timestamp")).alias("timestamp"),
        F.when(nth == 2, 3.0).when(nth == 3, 9000.0).otherwise(F.col("release_time") - F.col("press_time"))
        .alias("dwell_time"),
        F.when(nth == 4, F.col("press_time") - 5.0).otherwise(F.col("release_time")).alias("release_time"),
        F.when(nth == 5, -500.0).when(nth == 6, 20000.0).when(nth == 7, -50.0).otherwise(F.col("flight_time"))
        .alias("flight_time"))
    clean, _ = cleaning.clean_events(rows)
    bad = cleaning.check_rows(rows).filter("reason IS NOT NULL").select("event_id", "reason", "flight_time")
    return stable(bad.unionByName(
        clean.select("event_id", F.lit(None).cast("string").alias("reason"), "flight_time")))


@query("sequence_state", with_parts("sf", "spans", body="""
, b AS (SELECT DISTINCT user_id, session_id, CAST(user_id AS BIGINT) % 3 < 2 AS damaged FROM spans)
SELECT user_id, session_id, CASE WHEN keystroke_count < 5 THEN 'insufficient_data'
    WHEN coalesce(damaged, false) THEN 'not_ready'
    WHEN keystroke_count >= 8 THEN 'prediction_available' ELSE 'model_unavailable' END AS assessment_state,
  keystroke_count >= 8 AND NOT coalesce(damaged, false) AS assessment_ready
FROM sf LEFT JOIN b USING (user_id, session_id)"""))
def sequence_state(spark, sf_dir):
    """States of sessions whose windows hold bad numbers (every third person) or lack a step (the next)."""
    person = F.col("user_id").cast("long") % 3
    windows = labelled_windows(spark, sf_dir, features=("dwell_time", "flight_time"))
    nan = F.array(F.array(F.lit(float("nan")).cast("float"), F.lit(0.0).cast("float")))
    broken = windows.withColumn("values", F.when(person == 0, F.concat(nan, F.slice("values", 2, 9)))
                                .when(person == 1, F.slice("values", 1, 9)).otherwise(F.col("values")))
    blocked = broken.groupBy("user_id", "session_id").agg(
        F.bool_or(validation.sequence_problem("values", 10, 2)).alias("blocked"))
    sessions = session_table(spark, sf_dir).select("user_id", "session_id", "keystroke_count").join(
        blocked, ["user_id", "session_id"], "left").withColumns({
            "model_available": F.col("keystroke_count") >= 8, "baseline_status": F.lit("unavailable")})
    return validation.assessment_state(sessions, blocked=F.col("blocked")).select(
        "user_id", "session_id", "assessment_state", "assessment_ready")


@query("narratives", with_parts("judgement", body=f"""
, m AS (SELECT user_id, session_id, max(p) FILTER (place = 1) - coalesce(max(p) FILTER (place = 2), 0) AS margin
        FROM shares GROUP BY user_id, session_id),
j AS (SELECT *, {LEVEL_SQL} AS level, printf('%.2f', typing_deviation_index) AS i,
        CAST(round(top_probability * 100.0) AS INTEGER) || '%' AS chance
      FROM judgement JOIN m USING (user_id, session_id))
SELECT user_id, session_id, CASE WHEN total_paired_events < 5
  THEN 'Too few key presses (' || total_paired_events || ') for an assessment; at least 5 are needed.'
  ELSE CASE level
      WHEN 'higher_deviation' THEN 'Typing rhythm is far from the personal baseline (index ' || i || ' of 100).'
      WHEN 'moderate_deviation' THEN
        'Typing rhythm differs moderately from the personal baseline (index ' || i || ' of 100).'
      WHEN 'expected_variance' THEN 'Typing rhythm is within the usual personal range (index ' || i || ' of 100).'
      ELSE 'There is no personal baseline yet; more sessions are needed.' END || ' ' ||
    CASE WHEN margin >= 0.15 THEN 'The model matches class ''' || predicted_class || ''' (' || chance || ', ' ||
        CASE WHEN margin >= 0.30 THEN 'high' ELSE 'moderate' END || ' separation).'
      ELSE 'The model ranks class ''' || predicted_class || ''' first (' || chance || '), but other classes are close.'
    END
  END AS overall_interpretation FROM j"""))
def narratives(spark, sf_dir):
    """The summary sentences of every session."""
    return assessed(spark, sf_dir).select("user_id", "session_id", "overall_interpretation")


@query("deviation_texts", with_parts("dev", body="""
SELECT user_id, session_id, CAST(rank AS INTEGER) AS rank,
  CASE WHEN z > 0 THEN '+' ELSE '' END || printf('%.1f', z) || ' SD ' || direction || ' than baseline' AS descriptor
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_id ORDER BY abs(z) DESC, feature) AS rank
      FROM (SELECT * REPLACE (round(z, 9) AS z) FROM dev)) WHERE rank <= 5"""))
def deviation_texts(spark, sf_dir):
    """The descriptions of the largest deviations."""
    df = deviations(spark, sf_dir).withColumn("z_score", F.round("z_score", 9))
    return baselines.top_deviations(df).select("user_id", "session_id", "rank", "descriptor")


@query("erased_table", with_parts("stored", body="""
SELECT session_id, pseudonymized_user_id, sample_count FROM stored WHERE CAST(pseudonymized_user_id AS BIGINT) % 7 <> 0"""))
def erased_table(spark, sf_dir):
    """A stored table after every seventh person is erased: touched buckets are rewritten and old files deleted."""
    rows = stored_rows(spark, sf_dir).select("session_id", "pseudonymized_user_id", "sample_count")
    target = sinks.KeyedTable(spark, f"{scratch(spark)}/sessions",
                              "session_id string, pseudonymized_user_id string, sample_count long")
    target.merge(rows, 0, ["session_id"], "sample_count")
    people = rows.filter(F.col("pseudonymized_user_id").cast("long") % 7 == 0)
    target.erase(1, ["pseudonymized_user_id"], people)
    target.vacuum()
    return target.current()[1]


_SESSIONS = "session_id string, pseudonymized_user_id string, sample_count long"


@query("grown_table", with_parts("stored", body="""
SELECT session_id, pseudonymized_user_id, sample_count + CASE WHEN day >= '2024-01-15' THEN 100 ELSE 0 END AS sample_count
FROM stored"""))
def grown_table(spark, sf_dir):
    """A stored table that takes the sessions week by week, every week but the first two a second time, and grows from one
    bucket to as many as its rows need."""
    # Every batch reads them.
    rows = written(stored_rows(spark, sf_dir).select(*[c.split()[0] for c in _SESSIONS.split(", ")], "created_at"), "rows")
    target = sinks.KeyedTable(spark, f"{scratch(spark)}/sessions", _SESSIONS, rows_per_bucket=200)
    weeks = ("2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29")
    for batch, (start, end) in enumerate(zip((None, *weeks), (*weeks, None), strict=True)):
        new = rows
        if start:
            new = new.filter(F.col("created_at") >= start)
        if end:
            new = new.filter(F.col("created_at") < end)
        target.merge(new.drop("created_at"), batch, ["session_id"], "sample_count")
    again = rows.filter(F.col("created_at") >= "2024-01-15").withColumn("sample_count", F.col("sample_count") + 100)
    target.merge(again.drop("created_at"), len(weeks) + 1, ["session_id"], "sample_count")
    return target.current()[1]


@query("stored_detail", with_parts("stored", body="""
SELECT session_id, pseudonymized_user_id, sample_count FROM stored WHERE session_id = (SELECT max(session_id) FROM stored)"""))
def stored_detail(spark, sf_dir):
    """One session read by its key from the stored table: a single bucket of it is opened."""
    rows = stored_rows(spark, sf_dir).select(*[c.split()[0] for c in _SESSIONS.split(", ")])
    target = sinks.KeyedTable(spark, f"{scratch(spark)}/sessions", _SESSIONS, rows_per_bucket=100)
    target.merge(rows, 0, ["session_id"], "sample_count")
    return target.lookup(rows.agg(F.max("session_id").alias("session_id")))


_ARTIFACTS = "event_id long, value double, created_at timestamp"


@query("retained_table", with_parts("artifacts", body="""
SELECT event_id, value FROM artifacts WHERE ts + to_days(CAST(days AS INTEGER)) > TIMESTAMP '2024-04-08'"""))
def retained_table(spark, sf_dir):
    """A stored table by kind and day after the retention run: old partitions are gone, the ones at the limit rewritten."""
    path = f"{scratch(spark)}/artifacts"
    dated.store_by_day(artifacts(spark, sf_dir).select("event_id", "value", "created_at", "artifact_type"), path)
    dated.retain(spark, path, NOW)
    return dated.read_by_day(spark, path, _ARTIFACTS).select("event_id", "value")


@query("purged_tables", with_parts("stored", body="""
SELECT 'events' AS name, CAST(event_id AS VARCHAR) AS id FROM events WHERE user_id <> 8
UNION ALL SELECT 'sessions', session_id FROM stored WHERE pseudonymized_user_id <> '8'"""))
def purged_tables(spark, sf_dir):
    """Two stored tables after a person is erased from both, with a second run that finds everything done."""
    folder = scratch(spark)
    dated.store_by_day(table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), f"{folder}/events", "ts", None)
    dated.store_by_day(stored_rows(spark, sf_dir).select("session_id", F.col("pseudonymized_user_id").alias("user_id"), "created_at"),
                       f"{folder}/sessions", "created_at", None)
    both = {n: (f"{folder}/{n}", ["day"]) for n in ("events", "sessions")}
    for _ in range(2):
        dated.purge_tables(spark, both, "8", f"{folder}/journal")
    left = dated.read_by_day(spark, f"{folder}/events", "event_id long", None).select(
        F.lit("events").alias("name"), F.col("event_id").cast("string").alias("id"))
    return left.unionByName(dated.read_by_day(spark, f"{folder}/sessions", "session_id string", None).select(
        F.lit("sessions").alias("name"), F.col("session_id").alias("id")))


@query("incremental_baselines", with_parts("base", body="SELECT user_id, feature, sample_count, "
       + ", ".join(f"{r(s)} AS {s}" for s in _STATS) + " FROM base"))
def incremental_baselines(spark, sf_dir):
    """Sessions of the last week arrive as an update and the one before is sent again; older sessions are not read again."""
    sessions = written(session_table(spark, sf_dir), "sessions")  # both batches read them
    kept = incremental.IncrementalBaselines(spark, f"{scratch(spark)}/baselines")
    kept.update(sessions.filter(F.col("session_id") < "2024-01-29"), 0)
    kept.update(sessions.filter(F.col("session_id") >= "2024-01-22"), 1)
    return stable(kept.baselines.current()[1].select("user_id", "feature", "sample_count", *_STATS))
