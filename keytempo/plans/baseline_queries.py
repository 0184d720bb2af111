"""Queries on personal baselines, deviations and training-data preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from keytempo import names
from keytempo.operators import baselines, charts, evaluation, models, scaling, splits
from keytempo.operators import windows
from keytempo.operators.groups import pin
from keytempo.plans.event_queries import session_table, stored_sessions
from keytempo.plans.key_events import key_events, stable
from keytempo.plans.quality_queries import labelled_windows
from keytempo.plans.registry import query
from keytempo.plans.sql import part, r, with_parts

_ALL = list(names.BASELINE_FEATURES)

part("lf", "sf", sql="""
UNPIVOT (SELECT user_id, session_id, mean_typing_speed_wpm, mean_dwell_time, mean_flight_time,
  backspace_rate, pause_rate, mean_pause_duration, cv_flight_time, cv_dwell_time, error_rate
  FROM sf) ON COLUMNS(* EXCLUDE (user_id, session_id)) INTO NAME feature VALUE value""")
part("history", "sf", sql="SELECT user_id, count(*) AS session_count FROM sf GROUP BY user_id")
part("lc", "lf", sql="""
SELECT *, median(value) OVER (PARTITION BY user_id, feature) AS centre FROM lf""")
part("base", "lc", "history", sql="""
SELECT user_id, feature, any_value(session_count) AS session_count, avg(value) AS mean,
  CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END AS std, median(value) AS median,
  median(abs(value - centre)) AS mad,
  quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
  min(value) AS min, max(value) AS max, count(*) AS sample_count
FROM lc JOIN history USING (user_id) WHERE session_count >= 5 GROUP BY user_id, feature""")
_STATS = ("mean", "std", "median", "mad", "iqr", "min", "max")


@query("user_baselines", with_parts("base", body="SELECT user_id, 'available' AS baseline_status, "
       "session_count, CAST(5 AS INTEGER) AS min_required_sessions, feature, sample_count, "
       + ", ".join(f"{r(s)} AS {s}" for s in _STATS) + """ FROM base
UNION ALL SELECT user_id, 'insufficient_history', session_count, 5, NULL, NULL, NULL, NULL, NULL,
  NULL, NULL, NULL, NULL FROM history WHERE session_count < 5"""))
def user_baselines(spark, sf_dir):
    return stable(baselines.user_baselines(session_table(spark, sf_dir)))


@query("baseline_outliers", with_parts("base", body=f"""
SELECT user_id, session_id, feature, {r('value')} AS value, {r('median')} AS median,
  {r('cutoff')} AS cutoff
FROM (SELECT *, CASE WHEN mad > 1e-4 THEN 2.5 * mad ELSE 2.5 * std END AS cutoff
      FROM lf JOIN base USING (user_id, feature))
WHERE cutoff > 1e-4 AND abs(value - median) > cutoff"""))
def baseline_outliers(spark, sf_dir):
    sessions = stored_sessions(spark, sf_dir)
    return stable(baselines.baseline_outliers(sessions, baselines.user_baselines(sessions)))


part("dev", "base", sql="""
SELECT *, CASE WHEN abs(mean) > 1e-5 THEN (value - mean) / mean * 100 ELSE 0 END AS pct,
  CASE WHEN z > 0.5 THEN 'higher' WHEN z < -0.5 THEN 'lower' ELSE 'within_baseline' END
    AS direction
FROM (SELECT *, CASE WHEN std > 1e-5 THEN (value - mean) / std
    WHEN mad > 1e-5 THEN (value - median) / (1.4826 * mad) ELSE 0 END AS z
  FROM lf JOIN base USING (user_id, feature))""")


def deviations(spark, sf_dir):
    sessions = stored_sessions(spark, sf_dir)
    return baselines.session_deviation(sessions, baselines.user_baselines(sessions))


@query("session_deviation", with_parts("dev", body=f"""
SELECT user_id, session_id, feature, {r('value')} AS value, {r('mean')} AS baseline_mean,
  {r('std')} AS baseline_std, {r('median')} AS baseline_median, {r('mad')} AS baseline_mad,
  {r('value - mean')} AS absolute_deviation, {r('pct', 4)} AS percentage_deviation,
  {r('z')} AS z_score, NOT (std > 1e-5) AS has_zero_variance, direction,
  CASE WHEN direction = 'within_baseline' THEN 'within_expected_variance' ELSE 'deviated' END
    AS status FROM dev"""))
def session_deviation(spark, sf_dir):
    df = deviations(spark, sf_dir)
    return stable(df.withColumn(
        "percentage_deviation", F.round("percentage_deviation", 4) + F.lit(0.0)))


part("tdi", "dev", sql="""
SELECT user_id, session_id, avg(least(abs(z), 4)) * 25 AS typing_deviation_index,
  count(*) AS evaluated_features FROM dev GROUP BY user_id, session_id""")
part("tdi_all", "tdi", "history", sql="""
SELECT user_id, session_id, CASE WHEN h.session_count >= 5 THEN coalesce(typing_deviation_index, 0)
  END AS typing_deviation_index, evaluated_features, h.session_count,
  CASE WHEN h.session_count >= 5 THEN 'available' ELSE 'insufficient_history' END
    AS baseline_status
FROM sf LEFT JOIN tdi USING (user_id, session_id) JOIN history h USING (user_id)""")
LEVEL_SQL = """CASE WHEN typing_deviation_index IS NULL THEN 'unavailable'
  WHEN typing_deviation_index >= 60 THEN 'higher_deviation'
  WHEN typing_deviation_index >= 30 THEN 'moderate_deviation' ELSE 'expected_variance' END"""


@query("deviation_index", with_parts("tdi", body=f"""
SELECT user_id, session_id, {r('typing_deviation_index', 4)} AS typing_deviation_index,
  evaluated_features FROM tdi"""))
def deviation_index(spark, sf_dir):
    index = indexed(spark, sf_dir).filter("evaluated_features > 0")
    return stable(index.select("user_id", "session_id", "typing_deviation_index", "evaluated_features"), 4)


def indexed(spark, sf_dir, sessions=None):
    sessions = stored_sessions(spark, sf_dir) if sessions is None else sessions
    return baselines.session_index(sessions, baselines.user_baselines(sessions))


@query("deviation_level", with_parts("tdi_all", body=f"""
SELECT user_id, session_id, {r('typing_deviation_index', 4)} AS typing_deviation_index,
  evaluated_features, session_count, baseline_status, {LEVEL_SQL} AS deviation_level
FROM tdi_all"""))
def deviation_level(spark, sf_dir):
    df = indexed(spark, sf_dir)
    return stable(df.withColumn(
        "deviation_level", baselines.deviation_level(F.col("typing_deviation_index"))), 4)


@query("top_deviations", with_parts("dev", body=f"""
SELECT user_id, session_id, CAST(rank AS INTEGER) AS rank, feature, {r('z')} AS z_score, direction
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session_id
        ORDER BY abs(round(z, 9)) DESC, feature) AS rank FROM dev)
WHERE rank <= 5"""))
def top_deviations(spark, sf_dir):
    # Rounded first: equal deviations must rank by name, whatever the order of additions was.
    df = deviations(spark, sf_dir).withColumn("z_score", F.round("z_score", 9))
    return stable(baselines.top_deviations(df).select(
        "user_id", "session_id", "rank", "feature", "z_score", "direction"))


@query("deviation_bands", with_parts("dev", body=f"""
SELECT user_id, session_id, array_to_string(list_transform(string_split(feature, '_'),
    lambda x: upper(x[1]) || x[2:]), ' ') AS feature_label, {r('z', 2)} AS z_score,
  CASE WHEN abs(round(z, 2)) >= 2 THEN 'beyond_2_sigma'
       WHEN abs(round(z, 2)) >= 1 THEN 'beyond_1_sigma' ELSE 'within_1_sigma' END AS band
FROM (SELECT * REPLACE (round(z, 9) AS z) FROM dev)"""))
def deviation_bands(spark, sf_dir):
    df = deviations(spark, sf_dir).withColumn("z_score", F.round("z_score", 9))
    return charts.chart_deviation(df)


@query("calibration_progress", with_parts("sf", body="""
, d AS (SELECT user_id, count(*) FILTER (keystroke_count >= 10) AS done FROM sf GROUP BY user_id)
SELECT user_id, done AS completed_sessions, CAST(5 AS INTEGER) AS required_sessions,
  greatest(0, 5 - done) AS remaining_sessions, done >= 5 AS ready,
  CASE WHEN done >= 5 THEN 'BASELINE_READY' ELSE 'BASELINE_NOT_READY' END AS status FROM d"""))
def calibration_progress(spark, sf_dir):
    """Sessions of at least ten events count as calibration."""
    sessions = session_table(spark, sf_dir).select("user_id", F.when(
        F.col("keystroke_count") >= 10, "CALIBRATION").otherwise("ANALYSIS")
        .alias("session_type"))
    return baselines.calibration_progress(sessions)


@query("rolling_deviation", with_parts("sf", body=f"""
, h AS (SELECT *, row_number() OVER w - 1 AS earlier,
    count(value) OVER p AS history, avg(value) OVER p AS mean, stddev_samp(value) OVER p AS std
  FROM (SELECT user_id, session_id, 'mean_dwell_time' AS feature, mean_dwell_time AS value FROM sf
        UNION ALL SELECT user_id, session_id, 'mean_flight_time', mean_flight_time FROM sf
        UNION ALL SELECT user_id, session_id, 'pause_rate', pause_rate FROM sf)
  WINDOW w AS (PARTITION BY user_id, feature ORDER BY session_id),
    p AS (PARTITION BY user_id, feature ORDER BY session_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, session_id, feature, {r('value')} AS value, history, {r('mean')} AS baseline_mean,
  {r('std')} AS baseline_std,
  {r('CASE WHEN std > 1e-5 THEN (value - mean) / std ELSE 0 END')} AS z_score
FROM h WHERE earlier >= 3 AND history >= 2 AND value IS NOT NULL"""))
def rolling_deviation(spark, sf_dir):
    sessions = session_table(spark, sf_dir).withColumn("day", F.to_date("session_id"))
    return stable(baselines.rolling_deviation(
        sessions, ("day", "session_id"), ("mean_dwell_time", "mean_flight_time", "pause_rate"),
        min_sessions=3))


@query("updated_baselines", with_parts("base", body="SELECT user_id, feature, sample_count, "
       + ", ".join(f"{r(s)} AS {s}" for s in _STATS) + " FROM base"))
def updated_baselines(spark, sf_dir):
    """Sessions of the last week arrive as an update and the one before is sent again."""
    sessions = session_table(spark, sf_dir)
    old = sessions.filter(F.col("session_id") < "2024-01-29")
    new = sessions.filter(F.col("session_id") >= "2024-01-22")
    out = baselines.update_baselines(old, new).filter("feature IS NOT NULL")
    return stable(out.select("user_id", "feature", "sample_count", *_STATS))


@query("wide_baselines", with_parts("base", "history", body="""
SELECT h.user_id, CASE WHEN h.session_count >= 5 THEN 'available' ELSE 'insufficient_history' END
    AS baseline_status, h.session_count, CAST(5 AS INTEGER) AS min_required_sessions, """
       + ", ".join(f"{r(f'''max(b.{s}) FILTER (feature = '{f}')''')} AS {f}_{s}"
                   for f in _ALL for s in ("mean", "std", "median", "mad")) + """
FROM history h LEFT JOIN base b ON b.user_id = h.user_id GROUP BY h.user_id, h.session_count"""))
def wide_baselines(spark, sf_dir):
    return stable(baselines.wide_baselines(
        baselines.user_baselines(session_table(spark, sf_dir))))


# --- windows ----------------------------------------------------------------------------------

part("members", "features", "spans", sql="""
SELECT s.window_index, s.first_label, f.* FROM features f JOIN spans s
  ON f.user_id = s.user_id AND f.session_id = s.session_id
  AND f.sequence_index >= s.window_index * 5 AND f.sequence_index < s.window_index * 5 + 10""")


@query("sliding_windows", with_parts("members", body="""
SELECT user_id, session_id, window_index, first_label AS label, window_index * 5 AS start_index,
  window_index * 5 + 10 AS end_index, arg_min(press_time, sequence_index) AS start_time,
  arg_max(release_time, sequence_index) AS end_time,
  string_agg(CAST(round(dwell_time::FLOAT::DOUBLE * 1000) AS BIGINT) || '/' ||
    CAST(round(coalesce(flight_time, 0)::FLOAT::DOUBLE * 100) AS BIGINT) || '/' ||
    CAST(backspace AS BIGINT), ',' ORDER BY sequence_index) AS window_values
FROM members GROUP BY user_id, session_id, window_index, first_label"""))
def sliding_windows(spark, sf_dir):
    """Ten events every five; values shown as scaled whole numbers of three features."""
    df = labelled_windows(
        spark, sf_dir, features=("dwell_time", "flight_time", "backspace"),
        times=("press_time", "release_time"))

    def whole(x, scale):
        return F.round(x.cast("double") * scale).cast("long").cast("string")

    text = F.array_join(F.transform("values", lambda v: F.concat_ws(
        "/", whole(v[0], 1000), whole(v[1], 100), v[2].cast("long").cast("string"))), ",")
    return df.withColumn("window_values", text).drop("values")


_AGG = [(s, f) for f in names.SEQUENCE_FEATURES for s in windows.STATS]
_AGG_SQL = {"mean": "avg(coalesce({f}, 0))", "std": "stddev_pop(coalesce({f}, 0))",
            "median": "median(coalesce({f}, 0))", "min": "min(coalesce({f}, 0))",
            "max": "max(coalesce({f}, 0))"}
part("vectors", "members", sql="SELECT user_id, session_id, window_index, first_label AS label, "
     + ", ".join(f"{_AGG_SQL[s].format(f=f)} AS {s}_{f}" for s, f in _AGG)
     + " FROM members GROUP BY user_id, session_id, window_index, first_label")


def vectors(spark, sf_dir):
    return labelled_windows(spark, sf_dir, summary=True)


@query("window_aggregates", with_parts("vectors", body="""
SELECT user_id, session_id, window_index, label, window_index * 5 AS start_index,
  window_index * 5 + 10 AS end_index, """
       + ", ".join(f"{r(f'{s}_{f}')} AS {s}_{f}" for s, f in _AGG) + " FROM vectors"))
def window_aggregates(spark, sf_dir):
    return stable(vectors(spark, sf_dir))


@query("press_windows", with_parts("fl", body=f"""
, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id
                                     ORDER BY press_time, event_id) - 1 AS pos FROM fl),
k AS (SELECT user_id, session_id, unnest(range(0, (count(*) - 8) // 4 + 1)) AS window_index FROM n
      GROUP BY user_id, session_id HAVING count(*) >= 8)
SELECT k.user_id, k.session_id, window_index, window_index * 4 AS start_index,
  window_index * 4 + 8 AS end_index, {r('avg(dwell)')} AS mean_dwell,
  {r('stddev_pop(dwell)')} AS std_dwell, {r('median(dwell)')} AS median_dwell,
  {r('min(dwell)')} AS min_dwell, {r('max(dwell)')} AS max_dwell
FROM k JOIN n ON n.user_id = k.user_id AND n.session_id = k.session_id
  AND pos >= window_index * 4 AND pos < window_index * 4 + 8 GROUP BY ALL"""))
def press_windows(spark, sf_dir):
    """Windows over a table of presses: eight every four."""
    df = key_events(spark, sf_dir).withColumn(
        "dwell", F.col("release_time") - F.col("press_time"))
    return stable(windows.window_aggregates(
        df, ("dwell",), length=8, stride=4, order=("press_time", "event_id")))


# --- splits -----------------------------------------------------------------------------------

part("ranked", "ev", sql="""
SELECT user_id, row_number() OVER (ORDER BY md5('42:' || user_id), user_id) - 1 AS rank,
  count(*) OVER () AS groups FROM (SELECT DISTINCT user_id FROM ev)""")
part("split2", "ranked", sql="""
SELECT user_id, CASE WHEN rank < ceil(0.2::DOUBLE * groups) THEN 'test' ELSE 'train' END AS split
FROM ranked""")
part("split3", "ranked", sql="""
SELECT user_id, CASE WHEN rank < t THEN 'test'
  WHEN rank < t + CASE WHEN groups - t >= 2 THEN ceil((0.15::DOUBLE / 0.85) * (groups - t)) ELSE 0
    END THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, ceil(0.15::DOUBLE * groups) AS t FROM ranked)""")


@query("grouped_split", with_parts("split2", body="""
SELECT event_id, user_id, split FROM ev JOIN split2 USING (user_id)"""))
def grouped_split(spark, sf_dir):
    return splits.grouped_split(key_events(spark, sf_dir).select("event_id", "user_id"))


@query("grouped_split3", with_parts("split3", body="""
SELECT event_id, user_id, split FROM ev JOIN split3 USING (user_id)"""))
def grouped_split3(spark, sf_dir):
    return splits.grouped_split3(key_events(spark, sf_dir).select("event_id", "user_id"))


@query("sequential_split", """
WITH n AS (SELECT count(*) AS n FROM events)
SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_id) - 1
    < CAST(floor(n * (1.0::DOUBLE - 0.15::DOUBLE - 0.15::DOUBLE)) AS BIGINT) THEN 'train'
  WHEN row_number() OVER (ORDER BY event_id) - 1
    < CAST(floor(n * (1.0::DOUBLE - 0.15::DOUBLE)) AS BIGINT) THEN 'val' ELSE 'test' END AS split
FROM events, n""")
def sequential_split(spark, sf_dir):
    return splits.sequential_split(
        key_events(spark, sf_dir).select("event_id"), "event_id", 0.15, 0.15)


@query("split_events", with_parts("split2", body="""
SELECT event_id, user_id, session_id FROM ev
WHERE user_id IN (SELECT user_id FROM split2 WHERE split = 'train')"""))
def split_events(spark, sf_dir):
    """Events of the sessions whose feature row is in the training part."""
    sessions = splits.grouped_split(session_table(spark, sf_dir).select("user_id", "session_id"))
    train = sessions.filter("split = 'train'")
    return splits.apply_split(
        key_events(spark, sf_dir).select("event_id", "user_id", "session_id"), train,
        ["user_id", "session_id"])


@query("leakage_audit", with_parts("split3", body="""
, p AS (SELECT ev.*, split FROM ev JOIN split3 USING (user_id))
SELECT 'user_overlap' AS check_name, count(*) AS value, count(*) = 0 AS passed FROM
  (SELECT user_id FROM p GROUP BY user_id HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'session_overlap', count(*), count(*) = 0 FROM
  (SELECT user_id, session_id FROM p GROUP BY ALL HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'duplicate_windows', count(*), count(*) = 0 FROM
  (SELECT key_token FROM p GROUP BY ALL HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'leaked_features', 1, false
UNION ALL SELECT 'scaler_outside_train', 0, true"""))
def leakage_audit(spark, sf_dir):
    """Key tokens stand for equal content here, so that overlap is found."""
    parts = splits.grouped_split3(
        key_events(spark, sf_dir).select("user_id", "session_id", "key_token"))
    return splits.leakage_audit(
        parts, ["mean_dwell_time", "state"], "state", content="key_token")


@query("window_split_audit", with_parts("members", "split3", body="""
, w AS (SELECT user_id, session_id, window_index, list([""" + ", ".join(
    f"coalesce({f}, 0)::FLOAT" for f in names.SEQUENCE_FEATURES) + """] ORDER BY sequence_index) AS content
  FROM members GROUP BY user_id, session_id, window_index),
p AS (SELECT w.*, split FROM w JOIN split3 USING (user_id))
SELECT 'user_overlap' AS check_name, count(*) AS value, count(*) = 0 AS passed FROM
  (SELECT user_id FROM p GROUP BY user_id HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'session_overlap', count(*), count(*) = 0 FROM
  (SELECT user_id, session_id FROM p GROUP BY ALL HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'duplicate_windows', count(*), count(*) = 0 FROM
  (SELECT content FROM p GROUP BY content HAVING count(DISTINCT split) > 1)
UNION ALL SELECT 'leaked_features', 0, true
UNION ALL SELECT 'scaler_outside_train', 0, true"""))
def window_split_audit(spark, sf_dir):
    """Windows split by person, checked with real content hashes."""
    parts = splits.split_windows(windows.window_hash(labelled_windows(spark, sf_dir)))
    return splits.leakage_audit(parts, names.SEQUENCE_FEATURES, "state", content="window_hash")


# --- scaling and labels -----------------------------------------------------------------------

_SCALED = ("mean_dwell_time", "std_dwell_time", "backspace_rate")
part("trained", "sf", "split2", sql="""
SELECT sf.*, split FROM sf JOIN split2 USING (user_id)""")


def _scaled_sql(centre: str, scale: str) -> str:
    params = ", ".join(f"{centre.format(f=f)} AS c_{f}, {scale.format(f=f)} AS s_{f}"
                       for f in _SCALED)
    columns = ", ".join(
        r(f"({f} - c_{f}) / CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END") + f" AS {f}"
        for f in _SCALED)
    return with_parts("trained", body=f"""
, p AS (SELECT {params} FROM trained WHERE split = 'train')
SELECT user_id, session_id, split, {columns} FROM trained, p""")


def _scaled(spark, sf_dir, kind):
    # Split, fit and application read the few columns they need from one stored step.
    rows = pin(session_table(spark, sf_dir).select("user_id", "session_id", *_SCALED))
    parts = splits.grouped_split(rows)
    params = scaling.fit_scaler(parts.filter("split = 'train'"), _SCALED, kind)
    return stable(scaling.apply_scaler(parts, params, _SCALED))


@query("scaled_standard", _scaled_sql("avg({f})", "stddev_pop({f})"))
def scaled_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@query("scaled_robust", _scaled_sql(
    "median({f})", "quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)"))
def scaled_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, "robust")


@query("scaled_windows", with_parts("members", "split2", body=f"""
, p AS (SELECT avg(dwell_time) AS c, stddev_pop(dwell_time) AS s
        FROM members JOIN split2 USING (user_id) WHERE split = 'train')
SELECT user_id, session_id, window_index, split, {r('avg((dwell_time - c) / s)', 3)} AS mean_scaled
FROM members JOIN split2 USING (user_id), p GROUP BY user_id, session_id, window_index, split"""))
def scaled_windows(spark, sf_dir):
    """Windows scaled over all time steps of the training windows, shown by their mean."""
    rows = labelled_windows(spark, sf_dir, features=("dwell_time",))
    parts = splits.grouped_split(rows)
    params = scaling.fit_window_scaler(parts.filter("split = 'train'"), ("dwell_time",))
    scaled = scaling.apply_window_scaler(parts, params, ("dwell_time",))
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v[0].cast("double"))
    return stable(scaled.select(
        "user_id", "session_id", "window_index", "split",
        (total / F.size("values")).alias("mean_scaled")), 3)


@query("encoded_labels", """
SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER)
  AS label_id, event_type AS decoded FROM events""")
def encoded_labels(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    mapping = scaling.label_mapping(df, "event_type")
    return scaling.decode_labels(
        scaling.encode_labels(df, "event_type", mapping), mapping, out="decoded")


@query("inspected_labels", with_parts("ev", body="""
, c AS (SELECT CASE WHEN key_token <> 'k_view' THEN key_token END AS label, count(*) AS n
        FROM ev GROUP BY 1)
SELECT label, n AS class_count, round(n / (SELECT sum(n) FROM c WHERE label IS NOT NULL), 4)
  AS class_proportion, (SELECT count(label) FROM c) AS num_classes,
  CAST((SELECT sum(n) FROM c WHERE label IS NULL) AS BIGINT) AS null_count
FROM c WHERE label IS NOT NULL"""))
def inspected_labels(spark, sf_dir):
    """View events count as unlabelled."""
    df = key_events(spark, sf_dir).select(
        F.when(F.col("key_token") != "k_view", F.col("key_token")).alias("label"))
    return scaling.inspect_labels(df, "label")


@query("class_weights", f"""
SELECT event_type, n AS class_count, {r('sum(n) OVER () / (count(*) OVER () * n)')} AS class_weight
FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)""")
def class_weights(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type")
    return stable(scaling.class_weights(df, "event_type"))


# --- scoring ----------------------------------------------------------------------------------

_VECTOR = [f"{s}_{f}" for s, f in _AGG]


def _classified(spark, sf_dir, kind):
    # The mapping, the split, every pass of the fit and the scores read the vectors.
    rows = scaling.encode_labels(pin(vectors(spark, sf_dir)), "label")
    parts = pin(splits.grouped_split3(rows))
    model = models.fit_baseline_classifier(parts.filter("split = 'train'"), _VECTOR, kind=kind)
    scored, _ = models.score_windows(model, parts, _VECTOR)
    return scored


@query("classifier_scores")
def classifier_scores(spark, sf_dir):
    return _classified(spark, sf_dir, "random_forest").select(
        "user_id", "session_id", "window_index", "split", "label_id", "predicted_id",
        "confidence")


#: Inputs and steps of the logistic scores: few enough that SQL can follow every step.
_LOGISTIC = ("mean_dwell_time", "std_dwell_time", "mean_flight_time", "max_flight_time")
_STEPS, _RIDGE = 6, 1.0


def _newton_sql() -> str:
    """CTEs up to ``scores`` (vectors with p, the probability of the second class): every step of the least squares sums the
    normal equations in one row and eliminates one unknown after the other."""
    size = len(_LOGISTIC) + 1
    z = ["1.0::DOUBLE", *[f"z{i}" for i in range(1, size)]]
    eta = " + ".join(f"b{i} * {z[i]}" for i in range(size))
    out = [f""", coded AS MATERIALIZED (
SELECT *, split = 'train' AND y >= 0 AS learns FROM (SELECT v.*, split,
  CASE WHEN label IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY label IS NULL ORDER BY label) - 1 END AS y
  FROM vectors v JOIN split3 USING (user_id))),
moments AS (SELECT """ + ", ".join(
        f"avg({f}) AS m{i}, coalesce(nullif(stddev_pop({f}), 0), 1) AS s{i}" for i, f in enumerate(_LOGISTIC, 1))
        + """ FROM coded WHERE learns),
weights AS (SELECT y, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS cw FROM coded WHERE learns GROUP BY y),
z AS MATERIALIZED (SELECT c.*, cw, """ + ", ".join(f"({f} - m{i}) / s{i} AS z{i}" for i, f in enumerate(_LOGISTIC, 1))
        + """ FROM coded c CROSS JOIN moments LEFT JOIN weights w ON w.y = c.y),
b_0 AS (SELECT """ + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(size)) + ")"]
    for step in range(1, _STEPS + 1):
        sums = [f"sum(cw * p * (1 - p) * {z[i]} * {z[j]}) + {_RIDGE if i == j > 0 else 0.0} AS a{i}_{j}"
                for i in range(size) for j in range(size)]
        sums += [f"sum(cw * (y - p) * {z[i]}) - {_RIDGE if i else 0.0} * any_value(b{i}) AS a{i}_{size}" for i in range(size)]
        out.append(f"e_{step}_0 AS (SELECT {', '.join(sums)}, {', '.join(f'any_value(b{i}) AS b{i}' for i in range(size))}\n"
                   f"  FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS p FROM z, b_{step - 1} WHERE learns))")
        for k in range(size):
            cells = [f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}"
                     for i in range(size) for j in range(k + 1, size + 1)]
            out.append(f"e_{step}_{k + 1} AS (SELECT {', '.join(cells)}, {', '.join(f'b{i}' for i in range(size))} FROM e_{step}_{k})")
        out.append(f"b_{step} AS (SELECT {', '.join(f'b{i} + a{i}_{size} AS b{i}' for i in range(size))} FROM e_{step}_{size})")
    out.append(f"scores AS (SELECT z.*, 1 / (1 + exp(-({eta}))) AS p FROM z, b_{_STEPS})")
    return ",\n".join(out)


def _logistic(spark, sf_dir):
    rows = pin(scaling.encode_labels(
        vectors(spark, sf_dir).select("user_id", "session_id", "window_index", "label", *_LOGISTIC), "label"))
    parts = splits.grouped_split3(rows)
    model = models.fit_newton_logistic(parts.filter("split = 'train'"), _LOGISTIC, rounds=_STEPS, ridge=_RIDGE)
    return models.score_windows(model, parts, _LOGISTIC)[0]


@query("logistic_scores", with_parts("vectors", "split3", body=_newton_sql() + f"""
SELECT user_id, session_id, window_index, split, CAST(y AS INTEGER) AS label_id,
  CAST(p > 0.5 AS INTEGER) AS predicted_id, {r('greatest(p, 1 - p)')} AS confidence FROM scores"""))
def logistic_scores(spark, sf_dir):
    """Window scores of a logistic regression fitted by reweighted least squares."""
    return stable(_logistic(spark, sf_dir).select(
        "user_id", "session_id", "window_index", "split", "label_id", "predicted_id", "confidence"))


@query("session_probability", with_parts("vectors", "split3", body=_newton_sql() + f"""
SELECT user_id, session_id, CAST(class_id AS INTEGER) AS class_id,
  {r('avg(CASE class_id WHEN 1 THEN p ELSE 1 - p END)')} AS mean_probability, count(*) AS windows
FROM scores, (VALUES (0), (1)) AS c(class_id) GROUP BY user_id, session_id, class_id"""))
def session_probability(spark, sf_dir):
    return stable(models.session_probability(_logistic(spark, sf_dir)))


@query("overfit_report", f"""
WITH s AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'val' WHEN doc_id % 3 = 1 THEN 'test' ELSE 'train' END
          AS split, quality AS y, toxic AS yhat FROM labels),
c AS (SELECT split, y, yhat, count(*) AS n FROM s WHERE y IS NOT NULL AND yhat IS NOT NULL
      GROUP BY ALL),
l AS (SELECT split, y AS label FROM c UNION SELECT split, yhat FROM c),
k AS (SELECT l.split, label, coalesce(sum(n) FILTER (y = label), 0) AS support,
    coalesce(sum(n) FILTER (yhat = label), 0) AS predicted,
    coalesce(sum(n) FILTER (y = label AND yhat = label), 0) AS hits
  FROM l JOIN c ON c.split = l.split GROUP BY l.split, label),
f AS (SELECT split, avg(CASE WHEN hits > 0 THEN 2.0 * hits / (support + predicted) ELSE 0 END)
        AS f1, sum(hits) / sum(support) AS acc FROM k GROUP BY split),
w AS (SELECT max(f1) FILTER (split = 'train') AS a, max(f1) FILTER (split = 'val') AS b,
  max(f1) FILTER (split = 'test') AS t, max(acc) FILTER (split = 'train') AS x,
  max(acc) FILTER (split = 'val') AS z FROM f)
SELECT {r('a')} AS train_macro_f1, {r('b')} AS val_macro_f1, {r('t')} AS test_macro_f1,
  {r('a - b')} AS f1_gap_train_val, {r('x - z')} AS accuracy_gap_train_val,
  a - b > 0.15 AS overfitting_detected, CASE WHEN a - b > 0.15 THEN 'train_exceeds_val'
    WHEN a - b < -0.10 THEN 'val_exceeds_train' ELSE 'narrow_gap' END AS observation,
  abs(b - t) > 0.15 AS test_divergence FROM w""")
def overfit_report(spark, sf_dir):
    """Three parts by document number, compared like fitted partitions."""
    third = F.col("doc_id") % 3
    df = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn(
        "split", F.when(third == 0, "val").when(third == 1, "test").otherwise("train"))
    metrics = evaluation.classification_metrics(df, "quality", "toxic", by=["split"])
    return stable(evaluation.overfit_report(metrics))


part("probs", "ev", sql="""
SELECT user_id, session_id, key_token AS name, count(*) AS n FROM ev GROUP BY ALL""")
part("shares", "probs", sql="""
SELECT *, n / sum(n) OVER g AS p, count(*) OVER g AS k,
  row_number() OVER (PARTITION BY user_id, session_id ORDER BY n DESC, name) AS place
FROM probs WINDOW g AS (PARTITION BY user_id, session_id)""")


@query("prediction_uncertainty", with_parts("shares", body=f"""
, u AS (SELECT user_id, session_id, max(name) FILTER (place = 1) AS predicted_class,
    max(p) FILTER (place = 1) AS top, max(name) FILTER (place = 2) AS second_class,
    max(p) FILTER (place = 2) AS second, sum(-p * log2(p)) AS entropy, max(k) AS k
  FROM shares GROUP BY user_id, session_id)
SELECT user_id, session_id, predicted_class, {r('top')} AS top_probability, second_class,
  {r('second')} AS second_probability, {r('top - coalesce(second, 0)')} AS probability_margin,
  {r('entropy')} AS entropy,
  {r('entropy / CASE WHEN k > 1 THEN log2(k) ELSE 1 END')} AS normalized_entropy,
  CASE WHEN round(top - coalesce(second, 0), 9) >= 0.3 THEN 'HIGH_SEPARATION'
       WHEN round(top - coalesce(second, 0), 9) >= 0.15 THEN 'MODERATE_SEPARATION'
       ELSE 'LOW_SEPARATION' END AS reliability FROM u"""))
def prediction_uncertainty(spark, sf_dir):
    """Event counts per key in a session serve as class weights."""
    counts = key_events(spark, sf_dir).groupBy("user_id", "session_id", "key_token").agg(
        F.count(F.lit(1)).cast("double").alias("n"))
    # At most one entry per key name.
    probs = counts.groupBy("user_id", "session_id").agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("key_token", "n")))).alias("class_probabilities"))
    out = evaluation.interpret_probabilities(probs).drop("class_probabilities")
    return stable(out)
