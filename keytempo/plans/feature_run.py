"""Batch run from an event file to scaled features, windows and baselines on disk.

Each step is written before the next one reads it, so no step is computed twice and a lost
executor only repeats the step it worked on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo import names
from keytempo.operators import adapt, baselines, cleaning, evaluation, features, models, scaling
from keytempo.operators import splits, validation, windows
from keytempo.operators.quality import numeric_columns
from keytempo.sources import events, tables

META = ("user_id", "session_id", "target_label", "split", "label_id")


def _written(df: DataFrame, path: str, partition_by=()) -> DataFrame:
    tables.write_table(df, path, partition_by=partition_by)
    return df.sparkSession.read.parquet(path)


def run_features(
    spark: SparkSession,
    source: str,
    out: str,
    length: int = 20,
    stride: int = 5,
    test: float = 0.2,
    scaler: str = "standard",
    row_id: str | None = None,
    bounds: cleaning.Bounds = cleaning.Bounds(),
    seed: int = 42,
) -> DataFrame:
    """Clean, build features, split by person, scale on train, window, and store everything.

    Returns the row count of every stored step.  ``row_id`` names a unique row number if the
    source has one; it settles ties in time.
    """
    raw = events.read_events(spark, source)
    role = adapt.detect_roles(raw.columns)
    renamed = {role[r]: n for r, n in (
        ("user", "user_id"), ("session", "session_id"), ("label", "state"))
        if role[r] and role[r] != n}
    raw = raw.withColumnsRenamed(renamed)
    time = role["timestamp"] if role["timestamp"] in raw.columns else "timestamp"

    clean, report = cleaning.clean_events(raw, bounds, time, row_id)
    clean = _written(clean, f"{out}/events")
    _written(report, f"{out}/clean_report")
    _written(validation.feature_manifest(clean), f"{out}/feature_manifest")

    order = [n for n in ("press_time", time, row_id) if n and n in clean.columns]
    table = features.session_features(clean, order=order, time_col=time)
    parts = splits.grouped_split(table, "user_id", test, seed, row_id="session_id")
    parts = _written(parts, f"{out}/features_raw", ["split"])
    columns = [n for n in numeric_columns(parts) if n not in META]
    train = parts.filter("split = 'train'")
    params = _written(scaling.fit_scaler(train, columns, scaler), f"{out}/scaler")
    mapping = _written(scaling.label_mapping(train, "target_label"), f"{out}/labels")
    scaled = scaling.encode_labels(
        scaling.apply_scaler(parts, params, columns), "target_label", mapping)
    scaled = _written(scaled, f"{out}/features", ["split"])

    members = parts.select("user_id", "session_id", "split")
    timed = _sequence_columns(clean, order)
    inputs = [n for n in names.SEQUENCE_FEATURES if n in timed.columns]
    rows = timed.join(members, ["user_id", "session_id"])
    rows = _written(rows, f"{out}/sequence_events", ["split"])
    steps = _written(
        scaling.fit_scaler(rows.filter("split = 'train'"), inputs, scaler),
        f"{out}/event_scaler")
    win = windows.sliding_windows(
        scaling.apply_scaler(rows, steps, inputs), inputs, length, stride, order=order,
        label="state" if "state" in rows.columns else None)
    win = win.join(members, ["user_id", "session_id"])
    win = _written(win, f"{out}/windows", ["split"])

    base = baselines.user_baselines(parts)
    tables.save_baselines(base, f"{out}/baselines")

    counted = None
    for step, df in (("clean_events", clean), ("windows", win)):
        n = df.agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("row_count"))
        counted = n if counted is None else counted.unionByName(n)
    per_split = scaled.groupBy("split").agg(F.count(F.lit(1)).alias("row_count"))
    return counted.unionByName(per_split.select(
        F.concat(F.lit("features_"), F.col("split")).alias("step"), "row_count"))


def _sequence_columns(clean: DataFrame, order: list[str]) -> DataFrame:
    """The sequence features a cleaned event table can give."""
    from keytempo.operators import events as ev

    out = ev.flight_times(clean, order=order)
    hold = ev.dwell(out)
    added = {"pause_duration": F.when(
        F.col("flight_time") > ev.LIVE_PAUSE_MS, F.col("flight_time")).otherwise(0.0)}
    if hold is not None and "dwell_time" not in out.columns:
        added["dwell_time"] = hold
    return out.withColumns(added)


def run_training(
    windows_path: str,
    spark: SparkSession,
    features_in: list[str],
    kind: str = "random_forest",
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Readiness, leakage audit, classical model and metrics from stored windows.

    ``windows_path`` holds window rows with ``values`` and ``label``.  Returns the readiness
    checks, the audit and, if both pass, metrics per split, per-class metrics, the confusion
    matrix and the gap report.
    """
    win = spark.read.parquet(windows_path).drop("split")
    ready = validation.training_readiness(win, features=len(features_in))
    parts = splits.split_windows(windows.window_hash(win), seed=seed)
    audit = splits.leakage_audit(parts, features_in, "label", content="window_hash")
    out = {"readiness": ready, "audit": audit}
    blocked = ready.filter("severity = 'error' AND NOT passed").unionByName(
        audit.filter("NOT passed"), allowMissingColumns=True)
    if not blocked.isEmpty():
        return out
    vectors = _vectors(parts, features_in)
    inputs = [f"{s}_{f}" for f in features_in for s in windows.STATS]
    coded = scaling.encode_labels(vectors, "label", scaling.label_mapping(
        vectors.filter("split = 'train'"), "label"))
    model = models.fit_baseline_classifier(
        coded.filter("split = 'train'"), inputs, kind=kind, seed=seed)
    scored, rejected = models.score_windows(model, coded, inputs)
    metrics = evaluation.classification_metrics(scored, "label_id", "predicted_id", ["split"])
    tested = scored.filter("split = 'test'")
    return out | {
        "metrics": metrics,
        "per_class": evaluation.per_class_metrics(tested, "label_id", "predicted_id"),
        "confusion": evaluation.confusion_matrix(tested, "label_id", "predicted_id"),
        "gaps": evaluation.overfit_report(metrics),
        "scores": scored, "rejected": rejected,
    }


def _series(i: int) -> Column:
    return F.transform("values", lambda v: v[i].cast("double"))


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def _spread(xs: Column, mean: Column) -> Column:
    return F.sqrt(_mean(F.transform(xs, lambda x: (x - mean) * (x - mean))))


def _vectors(parts: DataFrame, features_in: list[str]) -> DataFrame:
    """Summary vector of each stored window; a window holds a fixed number of steps."""
    out = parts.withColumns({
        f"_x_{f}": F.array_sort(_series(i)) for i, f in enumerate(features_in)})
    out = out.withColumns({f"mean_{f}": _mean(F.col(f"_x_{f}")) for f in features_in})
    middle = (F.size("values") - 1) / 2
    for f in features_in:
        xs = F.col(f"_x_{f}")
        out = out.withColumns({
            f"std_{f}": _spread(xs, F.col(f"mean_{f}")),
            f"median_{f}": (F.get(xs, F.floor(middle)) + F.get(xs, F.ceil(middle))) / 2.0,
            f"min_{f}": F.array_min(xs),
            f"max_{f}": F.array_max(xs),
        })
    return out.drop(*[f"_x_{f}" for f in features_in])
