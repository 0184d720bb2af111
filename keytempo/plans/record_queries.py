"""Queries on adaptation, privacy, stored assessments and sources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from keytempo.functions.columns import map_condition, mask_key
from keytempo.operators import adapt, assessments, baselines, evaluation, privacy
from keytempo.operators import validation
from keytempo.plans.baseline_queries import LEVEL_SQL, indexed
from keytempo.plans.event_queries import session_table
from keytempo.plans.key_events import down_up, key_events, scratch, stable, table, written
from keytempo.plans.registry import query
from keytempo.plans.sql import part, r, with_parts
from keytempo.sources import events as event_sources
from keytempo.sources import tables

SECRET = "example-secret"  # for checks on generated tables only
KEY = b"0123456789abcdef"


def hmac_sql(expr: str) -> str:
    """HMAC-SHA256 in SQL: two nested digests with the padded key."""
    padded = SECRET.encode().ljust(64, b"\0")

    def blob(x: int) -> str:
        return "'" + "".join(f"\\x{b ^ x:02X}" for b in padded) + "'::BLOB"

    inner = f"unhex(sha256({blob(0x36)} || encode({expr})))"
    return f"sha256({blob(0x5C)} || {inner})"


def usr_sql(expr: str) -> str:
    return f"'usr_' || substr({hmac_sql(expr)}, 1, 16)"


# --- adaptation -------------------------------------------------------------------------------

@query("adapted_events", with_parts("raw", body=f"""
SELECT {usr_sql('user_id')} AS participant_id, session_id, timestamp_ms AS "timestamp", event_type,
  'k_' || substr(md5(key_token), 1, 6) AS key_identifier, state AS condition, raw_id AS event_id
FROM raw"""))
def adapted_events(spark, sf_dir):
    return adapt.adapt_events(down_up(spark, sf_dir).select(
        F.col("user_id").alias("Subject"), F.col("session_id").alias("trial"),
        F.when(F.col("state") == "stressed", "h").otherwise("baseline").alias("task"),
        F.col("timestamp_ms").alias("time"), F.col("key_token").alias("keycode"),
        F.upper("event_type").alias("action"), F.col("raw_id").alias("event_id"),
    ), secret=SECRET)


@query("masked_keys", """
SELECT event_id, 'k_' || substr(md5(event_type), 1, 6) AS key_identifier FROM events""")
def masked_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", mask_key(F.col("event_type")).alias("key_identifier"))


@query("mapped_conditions", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'neutral' WHEN 'F' THEN 'stressed'
  ELSE o_orderstatus END AS condition FROM orders""")
def mapped_conditions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", map_condition(
        F.lower("o_orderstatus"), {"O": "neutral", "F": "stressed", "p": "P"}).alias("condition"))


@query("pseudonymized_ids", f"""
SELECT c_custkey, {usr_sql('trim(c_name)')} AS c_name FROM customer""")
def pseudonymized_ids(spark, sf_dir):
    return adapt.pseudonymize(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name"], SECRET)


@query("stripped_text", "SELECT conv_id, turn, role FROM conversations")
def stripped_text(spark, sf_dir):
    return adapt.strip_text(table(spark, sf_dir, "conversations"))


@query("quarantined_text", "SELECT doc_id, lang, source, n_chars FROM documents")
def quarantined_text(spark, sf_dir):
    return adapt.quarantine_text(table(spark, sf_dir, "documents"))


@query("minimized", f"""
SELECT event_id, {usr_sql('CAST(user_id AS VARCHAR)')} AS user_id, value FROM events""")
def minimized(spark, sf_dir):
    return adapt.minimize(
        table(spark, sf_dir, "events").withColumn("text", F.col("props")), SECRET,
        allowed=["event_id", "user_id", "value"])


@query("minimize_report", """
WITH n AS (SELECT count(*) AS row_count FROM events)
SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS column_name,
  unnest(['retained', 'dropped_not_allowed', 'pseudonymized', 'dropped_not_allowed', 'retained',
          'dropped_not_allowed']) AS action, row_count FROM n""")
def minimize_report(spark, sf_dir):
    return adapt.minimize_report(
        table(spark, sf_dir, "events"), allowed=["event_id", "user_id", "value"])


def payloads(events):
    """Browser payloads of events with faults by event type: forbidden key, bad type, bad time, one letter."""
    kind = F.col("event_type")
    entries = [
        (F.lit("type"), F.when(kind == "view", "keypress").when(kind == "click", "KeyDown")
         .otherwise("up")),
        (F.when(kind == "signup", "Text").otherwise("source"), F.lit("web")),
        (F.lit("timestamp_ms"), (F.col("value") - F.when(kind == "click", 100.0).otherwise(0.0))
         .cast("string")),
        (F.lit("key_token"), F.when(F.col("value") > 400, "x").when(kind == "error", "Backspace")
         .otherwise(F.concat(F.lit("k_"), kind))),
        (F.lit("event_id"), F.col("event_id").cast("string")),
    ]
    payload = F.map_from_entries(F.array(*[
        F.struct(k.alias("k"), v.alias("v")) for k, v in entries]))
    return events.select(
        F.col("event_id").alias("row_id"), F.col("user_id").cast("string").alias("user_id"),
        payload.alias("payload"))


part("judged", sql="""
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, value,
  value - CASE WHEN event_type = 'click' THEN 100.0 ELSE 0.0 END AS t,
  CASE WHEN event_type = 'signup' THEN 'forbidden_key'
       WHEN event_type = 'view' THEN 'unknown_event_type'
       WHEN event_type = 'click' AND value < 100 THEN 'bad_timestamp'
       WHEN value > 400 THEN 'raw_character' END AS reason FROM events""")


SANITIZED_SQL = with_parts("judged", body=f"""
SELECT event_id AS row_id, user_id, CASE WHEN event_type = 'click' THEN 'down' ELSE 'up' END
  AS event_type, {r('t')} AS timestamp_ms, CASE WHEN event_type = 'error' THEN 'k_backspace'
    ELSE 'k_' || event_type END AS key_token, event_type = 'error' AS is_backspace,
  false AS is_enter, false AS is_space, CAST(event_id AS VARCHAR) AS event_id
FROM judged WHERE reason IS NULL""")


@query("sanitized_events", SANITIZED_SQL)
def sanitized_events(spark, sf_dir):
    clean, _ = adapt.sanitize_events(payloads(table(spark, sf_dir, "events")), keep=["row_id", "user_id"])
    return clean.withColumn("timestamp_ms", F.round("timestamp_ms", 6) + F.lit(0.0))


@query("rejected_events", with_parts("judged", body="""
SELECT event_id AS row_id, user_id, reason FROM judged WHERE reason IS NOT NULL"""))
def rejected_events(spark, sf_dir):
    _, rejects = adapt.sanitize_events(payloads(table(spark, sf_dir, "events")), keep=["row_id", "user_id"])
    return rejects


@query("payload_audit", """
SELECT event_id AS row_id, CASE WHEN event_type = 'signup' THEN 'text' ELSE '' END
  AS forbidden_keys FROM events""")
def payload_audit(spark, sf_dir):
    found = adapt.audit_payload(payloads(table(spark, sf_dir, "events")), "payload")
    return found.select("row_id", F.array_join("forbidden_keys", ",").alias("forbidden_keys"))


@query("chronological_events", with_parts("ev", body="""
SELECT user_id, session_id, press_time, event_id FROM ev"""))
def chronological_events(spark, sf_dir):
    df = key_events(spark, sf_dir).select("user_id", "session_id", "press_time", "event_id")
    return adapt.chronological(df, ["user_id", "session_id"], ["press_time", "event_id"])


# --- privacy ----------------------------------------------------------------------------------

def noise_sql(scale: str) -> str:
    """The seeded noise of a group: 52 bits of md5 through the inverse Laplace distribution."""
    return f"""-({scale}) * sign(u - 0.5) * ln(greatest(1.0::DOUBLE - 2.0::DOUBLE * abs(u - 0.5::DOUBLE), 5e-324))"""


part("noisy", sql="""
SELECT *, (('0x' || substr(md5('7:' || event_type), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
FROM (SELECT event_type, avg(least(greatest(value, 0.0), 500.0)) AS mean, count(*) AS n FROM events
      GROUP BY event_type)""")


@query("private_mean", with_parts("noisy", body=f"""
SELECT event_type, {r('mean + ' + noise_sql('500.0::DOUBLE / n'))} AS private_value, 1.0::DOUBLE AS epsilon,
  {r('500.0::DOUBLE / n', 9)} AS sensitivity, {r('500.0::DOUBLE / n', 9)} AS noise_scale, n AS sample_size,
  'Laplace' AS mechanism FROM noisy"""))
def private_mean(spark, sf_dir):
    df = privacy.private_mean(
        table(spark, sf_dir, "events"), "value", (0.0, 500.0), seed=7, keys=["event_type"])
    return df.withColumns({
        "private_value": F.round("private_value", 6) + 0.0, "sensitivity": F.round("sensitivity", 9) + 0.0,
        "noise_scale": F.round("noise_scale", 9) + 0.0})


@query("private_count", with_parts("noisy", body=f"""
SELECT event_type, {r('greatest(0.0::DOUBLE, n + ' + noise_sql('1.0::DOUBLE') + ')')} AS private_value,
  1.0::DOUBLE AS epsilon, 1.0::DOUBLE AS sensitivity, 1.0::DOUBLE AS noise_scale, 'Laplace' AS mechanism FROM noisy"""))
def private_count(spark, sf_dir):
    return stable(privacy.private_count(table(spark, sf_dir, "events"), seed=7, keys=["event_type"]))


@query("private_mean_parameters", f"""
SELECT event_type, {r('500.0 / count(*)', 9)} AS sensitivity,
  {r('500.0 / count(*) / 0.5', 9)} AS noise_scale, count(*) AS sample_size FROM events
GROUP BY event_type""")
def private_mean_parameters(spark, sf_dir):
    """The published parameters of a noisy mean; the noisy value itself has no fixed answer."""
    df = privacy.private_mean(
        table(spark, sf_dir, "events"), "value", (0.0, 500.0), epsilon=0.5, keys=["event_type"])
    return stable(df.select("event_type", "sensitivity", "noise_scale", "sample_size"), 9)


@query("privacy_budget", f"""
SELECT event_type, {r('sum(value / 1000.0)')} AS total_epsilon, count(*) AS query_count
FROM events GROUP BY event_type""")
def privacy_budget(spark, sf_dir):
    """Each event stands for a query that spent value / 1000."""
    log = table(spark, sf_dir, "events").withColumn("epsilon", F.col("value") / 1000.0)
    return stable(privacy.privacy_budget(log, ["event_type"]))


@query("privacy_spending", f"""
SELECT event_id, user_id, {r('sum(value / 1000.0) OVER (PARTITION BY user_id ORDER BY event_id)')}
  AS spent_epsilon FROM events""")
def privacy_spending(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        "event_id", "user_id", (F.col("value") / 1000.0).alias("epsilon"))
    return stable(privacy.privacy_spending(log, ["user_id"], ["event_id"]).drop("epsilon"))


NOW = datetime(2024, 4, 8)
_KINDS = {"click": "raw_keystrokes", "view": "timing_features", "error": "Audit_Logs "}


def artifacts(spark, sf_dir):
    kind = F.col("event_type")
    typed = F.lit("other_artifact")
    for k, v in _KINDS.items():
        typed = F.when(kind == k, v).otherwise(typed)
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("created_at"), typed.alias("artifact_type"), "value",
        "user_id")


part("artifacts", sql="""
SELECT event_id, ts, value, user_id, CASE event_type WHEN 'click' THEN 7 WHEN 'view' THEN 90
  WHEN 'error' THEN 365 ELSE 90 END AS days, CASE event_type WHEN 'click' THEN 'highly_sensitive'
  WHEN 'error' THEN 'internal' ELSE 'sensitive' END AS level,
  event_type NOT IN ('view', 'error') AS needs_encryption, event_type <> 'error' AS needs_pseudonym
FROM events""")


@query("expired_rows", with_parts("artifacts", body="""
SELECT event_id, CAST(days AS INTEGER) AS retention_days,
  ts + to_days(CAST(days AS INTEGER)) <= TIMESTAMP '2024-04-08' AS is_expired FROM artifacts"""))
def expired_rows(spark, sf_dir):
    return privacy.expired(artifacts(spark, sf_dir), NOW).select(
        "event_id", "retention_days", "is_expired")


@query("retained_rows", with_parts("artifacts", body="""
SELECT event_id, value FROM artifacts
WHERE ts + to_days(CAST(days AS INTEGER)) > TIMESTAMP '2024-04-08'"""))
def retained_rows(spark, sf_dir):
    return privacy.drop_expired(artifacts(spark, sf_dir), now=NOW).select("event_id", "value")


@query("storage_compliance", with_parts("artifacts", body="""
, v AS (SELECT *, concat_ws(',', CASE WHEN value > 400 THEN 'raw_text' END,
  CASE WHEN needs_pseudonym AND user_id % 2 = 0 THEN 'not_pseudonymized' END,
  CASE WHEN needs_encryption AND value < 50 THEN 'not_encrypted' END) AS violations FROM artifacts)
SELECT event_id, level AS sensitivity_level, CAST(days AS INTEGER) AS retention_days, violations,
  violations = '' AS compliant FROM v"""))
def storage_compliance(spark, sf_dir):
    rows = artifacts(spark, sf_dir).withColumns({
        "has_raw_text": F.col("value") > 400, "is_pseudonymized": F.col("user_id") % 2 == 1,
        "is_encrypted": F.col("value") >= 50})
    return privacy.storage_compliance(rows).select(
        "event_id", "sensitivity_level", F.col("retention_days").cast("int").alias(
            "retention_days"), "violations", "compliant")


@query("purge_counts", """
SELECT 'events.user_id' AS table_column, count(*) AS records_found FROM events WHERE user_id = 8
UNION ALL SELECT 'sessions.user_id', count(DISTINCT date_trunc('week', ts)) FROM events
  WHERE user_id = 8""")
def purge_counts(spark, sf_dir):
    return privacy.purge_counts({
        "events": table(spark, sf_dir, "events"),
        "sessions": session_table(spark, sf_dir),
        "orders": table(spark, sf_dir, "orders"),
    }, "8")


@query("purged_events", "SELECT event_id, user_id FROM events WHERE user_id <> 8")
def purged_events(spark, sf_dir):
    left = privacy.purge_user({"events": table(spark, sf_dir, "events")}, "8")
    return left["events"].select("event_id", "user_id")


@query("encrypted_roundtrip", """
SELECT c_custkey, c_name, true AS hidden FROM customer""")
def encrypted_roundtrip(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_name").alias("n"))
    sealed = privacy.encrypt_columns(df, ["c_name"], KEY)
    sealed = sealed.withColumn("hidden", ~F.col("c_name").contains(F.col("n"))).drop("n")
    return privacy.decrypt_columns(sealed, ["c_name"], KEY)


@query("encryption_rejects", """
SELECT c_custkey, c_mktsegment = 'BUILDING' AS rejected FROM customer""")
def encryption_rejects(spark, sf_dir):
    """Values of one market segment are damaged after encryption."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    sealed = privacy.encrypt_columns(df, ["c_name"], KEY)
    sealed = sealed.withColumn("c_name", F.when(
        F.col("c_mktsegment") == "BUILDING", F.overlay("c_name", F.lit("AAAA"), 1))
        .otherwise(F.col("c_name")))
    good, bad = privacy.decrypt_or_reject(sealed, ["c_name"], KEY)
    return good.select("c_custkey", F.lit(False).alias("rejected")).unionByName(
        bad.select("c_custkey", F.lit(True).alias("rejected")))


@query("redacted_details", """
SELECT event_id, json_extract_string(props, '$.k') AS k, '[REDACTED]' AS api_token,
  event_type AS note, '[REDACTED]' AS inner_password, '[REDACTED]' AS entry_secret, value AS amount
FROM events""")
def redacted_details(spark, sf_dir):
    details = F.struct(
        F.from_json("props", "map<string,string>").alias("props"),
        F.lit("abc").alias("api_token"),
        F.struct(F.col("event_type").alias("note"), F.lit("pw").alias("password")).alias("inner"),
        F.array(F.struct(F.col("value").alias("amount"), F.lit("s").alias("secret")))
        .alias("entries"))
    df = privacy.redact(
        table(spark, sf_dir, "events").select("event_id", details.alias("details")), "details")
    return df.select(
        "event_id", F.try_element_at("details.props", F.lit("k")).alias("k"),
        F.col("details.api_token").alias("api_token"), F.col("details.inner.note").alias("note"),
        F.col("details.inner.password").alias("inner_password"),
        F.col("details.entries")[0]["secret"].alias("entry_secret"),
        F.col("details.entries")[0]["amount"].alias("amount"))


# --- stored assessments -----------------------------------------------------------------------

def stored_sessions(spark, sf_dir):
    """A sessions table: one row per (person, week) known before the last week."""
    return session_table(spark, sf_dir).select(
        F.concat_ws("-", "user_id", "session_id").alias("session_id"),
        F.col("user_id").alias("pseudonymized_user_id"),
        F.to_timestamp("session_id").alias("created_at"),
        F.col("keystroke_count").alias("sample_count"),
        F.lit("ANALYSIS").alias("session_type"))


part("stored", "ev", sql="""
SELECT user_id || '-' || session_id AS session_id, user_id AS pseudonymized_user_id,
  session_id AS day, count(*) AS sample_count FROM ev GROUP BY user_id, ev.session_id""")


@query("upsert_sessions", with_parts("stored", body="""
SELECT session_id, pseudonymized_user_id, sample_count + CASE WHEN day >= '2024-01-22' THEN 100
    ELSE 0 END AS sample_count,
  CASE WHEN day >= '2024-01-29' THEN 'completed' ELSE 'ANALYSIS' END AS session_type
FROM stored"""))
def upsert_sessions(spark, sf_dir):
    """The last two weeks are written again; on known sessions only the count changes."""
    rows = stored_sessions(spark, sf_dir)
    base = rows.filter(F.col("created_at") < "2024-01-29").drop("created_at")
    again = rows.filter(F.col("created_at") >= "2024-01-22").select(
        "session_id", "pseudonymized_user_id", F.lit("completed").alias("session_type"),
        F.explode(F.array(F.lit(50), F.lit(100))).alias("version"),
        F.col("sample_count").alias("n"))
    updates = again.withColumn("sample_count", F.col("n") + F.col("version")).drop("n")
    return assessments.merge_by_key(
        base, updates, ["session_id"], "version", update_cols=["sample_count"])


@query("history_merge", with_parts("stored", body="""
SELECT session_id, CASE WHEN day < '2024-01-15' THEN 'archive' ELSE 'table' END AS origin,
  sample_count FROM stored"""))
def history_merge(spark, sf_dir):
    rows = stored_sessions(spark, sf_dir)
    archive = rows.filter(F.col("created_at") < "2024-01-15").select(
        "session_id", F.lit("archive").alias("origin"), "sample_count")
    stored = rows.select("session_id", F.lit("table").alias("origin"), "sample_count")
    return assessments.history(archive, stored)


@query("recent_assessments", with_parts("stored", body="""
SELECT 'asmt_' || session_id AS assessment_id, session_id, sample_count FROM stored
ORDER BY day DESC, assessment_id LIMIT 100"""))
def recent_assessments(spark, sf_dir):
    rows = stored_sessions(spark, sf_dir).withColumn(
        "assessment_id", F.concat(F.lit("asmt_"), F.col("session_id")))
    return assessments.recent_assessments(rows).select(
        "assessment_id", "session_id", "sample_count")


@query("recent_of_person", with_parts("stored", body="""
SELECT session_id, sample_count FROM stored WHERE pseudonymized_user_id = '8'
ORDER BY day DESC, session_id LIMIT 3"""))
def recent_of_person(spark, sf_dir):
    rows = stored_sessions(spark, sf_dir).withColumn("assessment_id", F.col("session_id"))
    return assessments.recent_assessments(rows, "8", 3).select("session_id", "sample_count")


@query("assessment_detail", with_parts("stored", body="""
SELECT session_id, sample_count FROM stored WHERE session_id = '8-2024-01-08'"""))
def assessment_detail(spark, sf_dir):
    rows = stored_sessions(spark, sf_dir).withColumn(
        "assessment_id", F.concat(F.lit("asmt_"), F.col("session_id")))
    return assessments.assessment_detail(rows, "asmt_8-2024-01-08").select(
        "session_id", "sample_count")


@query("latest_profile", with_parts("stored", body="""
SELECT pseudonymized_user_id AS user_id, arg_max(sample_count, day) AS sample_count FROM stored
GROUP BY pseudonymized_user_id"""))
def latest_profile(spark, sf_dir):
    rows = stored_sessions(spark, sf_dir).select(
        F.col("pseudonymized_user_id").alias("user_id"), F.col("created_at").alias("last_updated"),
        "sample_count")
    return assessments.latest_profile(rows).select("user_id", "sample_count")


@query("delete_sessions", with_parts("stored", body="""
SELECT session_id, sample_count FROM stored WHERE sample_count >= 5"""))
def delete_sessions(spark, sf_dir):
    rows = stored_sessions(spark, sf_dir).select("session_id", "sample_count")
    return assessments.delete_sessions(rows, rows.filter("sample_count < 5"))


part("judgement", "gated", "tel", "tdi_all", "shares", sql="""
SELECT user_id, session_id, total_paired_events, g.duration_seconds, g.reasons, mean_dwell_ms,
  estimated_wpm, backspace_count, baseline_status, typing_deviation_index, t.session_count,
  place.name AS predicted_class, place.p AS top_probability
FROM gated g JOIN tel USING (user_id, session_id) LEFT JOIN tdi_all t USING (user_id, session_id)
LEFT JOIN (SELECT * FROM shares WHERE place = 1) place USING (user_id, session_id)""")


def assessed(spark, sf_dir, top=False):
    evidence = validation.session_evidence(down_up(spark, sf_dir))
    counts = key_events(spark, sf_dir).groupBy("user_id", "session_id", "key_token").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    probs = counts.groupBy("user_id", "session_id").agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("key_token", "n")))).alias("class_probabilities"))
    prediction = evaluation.interpret_probabilities(probs)
    sessions = written(session_table(spark, sf_dir), "sessions")
    ranked = baselines.top_deviations(baselines.session_deviation(
        sessions, baselines.user_baselines(sessions))) if top else None
    return assessments.assess_sessions(
        evidence, indexed(spark, sf_dir, sessions), prediction, ranked)


@query("assessments", with_parts("judgement", body=f"""
SELECT user_id, session_id, total_paired_events, {r('duration_seconds')} AS duration_seconds,
  reasons, {r('mean_dwell_ms')} AS mean_dwell_ms, {r('estimated_wpm')} AS estimated_wpm,
  backspace_count, baseline_status, {r('typing_deviation_index', 4)} AS typing_deviation_index,
  {LEVEL_SQL} AS deviation_level, predicted_class, {r('top_probability')} AS top_probability,
  CASE WHEN total_paired_events < 5 THEN 'insufficient_data'
       WHEN baseline_status = 'available' THEN 'ready' ELSE 'prediction_available' END
    AS assessment_state FROM judgement"""))
def assessments_query(spark, sf_dir):
    df = assessed(spark, sf_dir).select(
        "user_id", "session_id", "total_paired_events", "duration_seconds", "reasons",
        "mean_dwell_ms", "estimated_wpm", "backspace_count", "baseline_status",
        F.round("typing_deviation_index", 4).alias("typing_deviation_index"), "deviation_level",
        "predicted_class", "top_probability", "assessment_state")
    return stable(df)


@query("reports")
def reports(spark, sf_dir):
    return assessments.render_reports(assessed(spark, sf_dir, top=True))


@query("report_lines", with_parts("judgement", body="""
SELECT user_id, session_id, '- **Paired events**: ' || total_paired_events AS events_line,
  '- **Reasons**: ' || CASE WHEN reasons = '' THEN 'none' ELSE reasons END AS reasons_line,
  '- **Class**: ' || predicted_class AS class_line FROM judgement"""))
def report_lines(spark, sf_dir):
    """Three lines of every Markdown report, cut out of the rendered text."""
    text = assessments.render_reports(assessed(spark, sf_dir))
    lines = F.split("markdown", "\n")

    def line(label):
        return F.get(F.filter(lines, lambda x: x.startswith(f"- **{label}**")), F.lit(0))

    return text.select(
        "user_id", "session_id", line("Paired events").alias("events_line"),
        line("Reasons").alias("reasons_line"), line("Class").alias("class_line"))


@query("recent_audit", """
SELECT 'DP_QUERY_EXECUTED' AS event_type, 'RESEARCHER' AS actor_role, CAST(event_id AS VARCHAR)
  AS query_id, '[REDACTED]' AS access_token FROM events ORDER BY ts DESC, event_id LIMIT 50""")
def recent_audit(spark, sf_dir):
    """Every event is logged as a query; the newest 50 are read back from the log."""
    log = table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit("DP_QUERY_EXECUTED").alias("event_type"), F.lit("RESEARCHER").alias("actor_role"),
        F.create_map(F.lit("query_id"), F.col("event_id").cast("string"),
                     F.lit("access_token"), F.col("props")).alias("details"))
    folder = f"{scratch(spark)}/audit"
    tables.append_audit(log, folder)
    return tables.recent_audit(spark, folder).select(
        "event_type", "actor_role", F.col("details")["query_id"].alias("query_id"),
        F.col("details")["access_token"].alias("access_token"))


@query("baseline_round_trip", with_parts("base", body=f"""
SELECT user_id, feature, sample_count, {r('mean')} AS mean, {r('std')} AS std,
  {r('median')} AS median, {r('mad')} AS mad FROM base"""))
def baseline_round_trip(spark, sf_dir):
    """Baselines stored as nested JSON and read back."""
    folder = scratch(spark)
    tables.save_baselines(baselines.user_baselines(session_table(spark, sf_dir)), folder)
    back = tables.load_baselines(spark, folder).filter("feature IS NOT NULL")
    return stable(back.select("user_id", "feature", "sample_count", "mean", "std", "median", "mad"))


@query("flatten_json", with_parts("judgement", body=f"""
SELECT user_id, session_id, CASE WHEN reasons = '' THEN 'SESSION_VALID' ELSE 'INSUFFICIENT_DATA' END
    AS quality_verdict, reasons = '' AS is_valid, {r('duration_seconds')} AS duration_s,
  total_paired_events AS event_count, {r('mean_dwell_ms')} AS mean_dwell_ms,
  CASE WHEN baseline_status = 'available' THEN 'READY' ELSE 'NOT_READY' END AS baseline_status,
  {r('typing_deviation_index', 4)} AS tdi, 'MODEL_READY' AS model_status, predicted_class
FROM judgement"""))
def flatten_json(spark, sf_dir):
    """Assessment rows with their JSON document, read back out of the document."""
    rows = assessments.assessment_rows(assessed(spark, sf_dir)).select(
        F.col("pseudonymized_user_id").alias("user_id"), "session_id", "assessment_json")
    flat = assessments.flatten_assessments(rows).drop("mean_flight_ms")
    return stable(flat.withColumn("tdi", F.round("tdi", 4)))


# --- sources ----------------------------------------------------------------------------------

_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
         "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query("dataset_fingerprint", f"""
WITH h AS (SELECT ('0x' || substr(md5({' || '.join(
    f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in _LINE)}), 1, 15))::BIGINT AS h FROM lineitem)
SELECT count(*) AS row_count, bit_xor(h) AS xor_hash, CAST(sum(h % 1048576) AS BIGINT) AS sum_hash FROM h""")
def dataset_fingerprint(spark, sf_dir):
    return event_sources.dataset_fingerprint(table(spark, sf_dir, "lineitem").select(*_LINE))
