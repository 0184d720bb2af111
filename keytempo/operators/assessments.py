"""Session assessments, reports and the history of stored assessments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytempo import names
from keytempo.operators.baselines import deviation_level
from keytempo.operators.pairing import KEYS
from keytempo.operators.validation import assessment_state
from keytempo.schemas import ASSESSMENT_DOCUMENT

PREDICTION = (
    "predicted_class", "top_probability", "probability_margin", "normalized_entropy",
    "reliability",
)


def assess_sessions(
    evidence: DataFrame,
    index: DataFrame,
    prediction: DataFrame | None = None,
    top: DataFrame | None = None,
) -> DataFrame:
    """One row per session with quality, telemetry, baseline and model signals side by side.

    ``evidence`` is gate and telemetry.  All inputs have one row per (person, session) except
    ``top``, the ranked deviations; equal keys let all joins share one partitioning.  Model
    and baseline signals stay separate columns and are never merged into one score.
    """
    keys = list(KEYS)
    out = evidence.join(
        index.select(*keys, "baseline_status", "typing_deviation_index", "session_count"),
        keys, "left")
    if prediction is not None:
        out = out.join(prediction.select(*keys, *PREDICTION), keys, "left")
    else:
        out = out.withColumns({
            n: F.lit(None).cast("string" if n in ("predicted_class", "reliability") else "double")
            for n in PREDICTION})
    if top is not None:
        # At most k rows per session.
        ranked = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
            "rank", "feature", "z_score", "direction", "descriptor"))).alias("largest_deviations"))
        out = out.join(ranked, keys, "left")
    out = out.withColumns({
        "baseline_status": F.coalesce("baseline_status", F.lit("unavailable")),
        "model_available": F.col("predicted_class").isNotNull(),
        "deviation_level": deviation_level(F.col("typing_deviation_index")),
    })
    out = assessment_state(out, count="total_paired_events")
    return out.withColumn("overall_interpretation", narrative())


def _percent(p: Column) -> Column:
    return F.concat(F.round(p * 100.0).cast("int").cast("string"), F.lit("%"))


def narrative() -> Column:
    """Sentences that follow from state, deviation level and model separation."""
    index = F.format_string("%.2f", F.col("typing_deviation_index"))
    baseline = (
        F.when(F.col("deviation_level") == "higher_deviation", F.concat(
            F.lit("Typing rhythm is far from the personal baseline (index "), index,
            F.lit(" of 100).")))
        .when(F.col("deviation_level") == "moderate_deviation", F.concat(
            F.lit("Typing rhythm differs moderately from the personal baseline (index "), index,
            F.lit(" of 100).")))
        .when(F.col("deviation_level") == "expected_variance", F.concat(
            F.lit("Typing rhythm is within the usual personal range (index "), index,
            F.lit(" of 100).")))
        .otherwise("There is no personal baseline yet; more sessions are needed.")
    )
    chance = _percent(F.col("top_probability"))
    model = (
        F.when(~F.col("model_available"), "No trained model was available for a prediction.")
        .when(F.col("reliability") == "LOW_SEPARATION", F.concat(
            F.lit("The model ranks class '"), F.col("predicted_class"), F.lit("' first ("), chance,
            F.lit("), but other classes are close.")))
        .otherwise(F.concat(
            F.lit("The model matches class '"), F.col("predicted_class"), F.lit("' ("), chance,
            F.lit(", "), F.lower(F.replace("reliability", F.lit("_"), F.lit(" "))), F.lit(").")))
    )
    few = F.concat(
        F.lit("Too few key presses ("), F.col("total_paired_events").cast("string"),
        F.lit(") for an assessment; at least 5 are needed."))
    return (
        F.when(F.col("assessment_state") == "insufficient_data", few)
        .when(F.col("assessment_state") == "not_ready",
              "The session data failed a check, so no assessment was made.")
        .otherwise(F.concat_ws(" ", baseline, model))
    )


def render_reports(assessed: DataFrame) -> DataFrame:
    """Markdown and plain text per session, from ``assess_sessions`` columns."""
    def num(col: str, digits: int = 1) -> Column:
        return F.coalesce(F.format_string(f"%.{digits}f", F.col(col).cast("double")), F.lit("n/a"))

    def line(label: str, *value: Column) -> Column:
        return F.concat(F.lit(f"- **{label}**: "), *value)

    def text(col: str) -> Column:
        return F.coalesce(F.col(col).cast("string"), F.lit("n/a"))

    deviations = F.lit(None).cast("string")
    if "largest_deviations" in assessed.columns:
        deviations = F.array_join(F.transform(
            "largest_deviations",
            lambda d: F.concat(F.lit("  - `"), d["feature"], F.lit("`: "), d["descriptor"])), "\n")
    markdown = F.concat_ws(
        "\n",
        F.lit("# Typing Session Report"), F.lit(""),
        F.concat(F.lit("**Session**: `"), F.col("session_id"), F.lit("`")),
        F.concat(F.lit("**State**: `"), F.col("assessment_state"), F.lit("`")), F.lit(""),
        F.lit("## Data Quality"),
        line("Verdict", text("verdict")),
        line("Reasons", F.when(F.col("reasons") == "", "none").otherwise(F.col("reasons"))),
        line("Paired events", text("total_paired_events")),
        line("Active seconds", num("duration_seconds")), F.lit(""),
        F.lit("## Personal Baseline"),
        line("Status", text("baseline_status")),
        line("Sessions", text("session_count")),
        line("Deviation index", num("typing_deviation_index"), F.lit(" / 100")),
        line("Level", text("deviation_level")),
        deviations, F.lit(""),
        F.lit("## Model"),
        line("Class", text("predicted_class")),
        line("Probability", num("top_probability", 3)),
        line("Margin", num("probability_margin", 3)),
        line("Separation", text("reliability")), F.lit(""),
        F.lit("## Telemetry"),
        line("Mean dwell", num("mean_dwell_ms"), F.lit(" ms")),
        line("Mean flight", num("mean_flight_ms"), F.lit(" ms")),
        line("Speed", num("estimated_wpm"), F.lit(" WPM")),
        line("Pauses", text("pause_count")),
        line("Backspaces", text("backspace_count")), F.lit(""),
        F.lit("## Summary"),
        F.concat(F.lit("> "), F.col("overall_interpretation")), F.lit(""),
        F.lit(f"_{names.DISCLAIMER}_"),
    )
    plain = F.regexp_replace(F.regexp_replace(
        F.col("markdown"), "(?m)^(#+ |> )", ""), "\\*\\*|`|(?m)^_|_$", "")
    return assessed.select(*KEYS, markdown.alias("markdown")).withColumn("plain_text", plain)


def assessment_rows(assessed: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Rows for the assessments table, with the whole document as JSON."""
    document = F.to_json(F.struct(
        "session_id", "user_id",
        F.struct("is_valid", "verdict", F.struct(
            "total_paired_events", "duration_seconds", "valid_dwell_count", "valid_flight_count")
            .alias("metrics")).alias("data_quality"),
        F.struct(F.col("total_paired_events").alias("event_count"), "mean_dwell_ms",
                 "mean_flight_ms", "pause_rate", "estimated_wpm", "backspace_count")
        .alias("feature_summary"),
        F.struct(F.when(F.col("baseline_status") == "available", "READY").otherwise("NOT_READY")
                 .alias("status"), "session_count", "typing_deviation_index", "deviation_level")
        .alias("baseline_result"),
        F.struct(F.when(F.col("model_available"), "MODEL_READY").otherwise("MODEL_NOT_READY")
                 .alias("status"), "predicted_class",
                 F.col("top_probability").alias("confidence")).alias("model_result"),
    ))
    return assessed.select(
        F.concat(F.lit("asmt_"), F.concat_ws("_", "user_id", "session_id")).alias("assessment_id"),
        "session_id", F.col("user_id").alias("pseudonymized_user_id"),
        F.lit("ANALYSIS").alias("session_type"),
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
        F.col("duration_seconds").alias("duration_s"),
        F.col("total_paired_events").alias("event_count"),
        "mean_dwell_ms", "mean_flight_ms", "pause_rate",
        F.col("estimated_wpm").alias("typing_speed_wpm"),
        (F.col("backspace_count") / F.greatest(F.col("total_paired_events"), F.lit(1)))
        .alias("backspace_rate"),
        F.col("typing_deviation_index").alias("tdi_score"),
        F.col("deviation_level").alias("tdi_divergence_level"),
        F.col("predicted_class").alias("model_predicted_class"),
        F.col("top_probability").alias("model_confidence"),
        F.when(F.col("model_available"), "MODEL_READY").otherwise("MODEL_NOT_READY")
        .alias("model_status"),
        document.alias("assessment_json"),
    )


def flatten_assessments(df: DataFrame, column: str = "assessment_json") -> DataFrame:
    """Metrics out of assessment JSON.  Old and new metric names are both read."""
    doc = F.from_json(F.col(column), ASSESSMENT_DOCUMENT)
    metrics = F.col("_d.data_quality.metrics")
    return df.withColumn("_d", doc).select(
        *[n for n in df.columns if n != column],
        F.col("_d.data_quality.verdict").alias("quality_verdict"),
        F.coalesce(F.col("_d.data_quality.is_valid"), F.lit(False)).alias("is_valid"),
        F.coalesce(metrics["duration_seconds"], metrics["active_duration_s"], F.lit(0.0))
        .alias("duration_s"),
        F.coalesce(metrics["total_paired_events"], metrics["paired_events_count"], F.lit(0))
        .alias("event_count"),
        F.col("_d.feature_summary.mean_dwell_ms").alias("mean_dwell_ms"),
        F.col("_d.feature_summary.mean_flight_ms").alias("mean_flight_ms"),
        F.coalesce(F.col("_d.baseline_result.status"), F.lit("NOT_READY"))
        .alias("baseline_status"),
        F.col("_d.baseline_result.typing_deviation_index").alias("tdi"),
        F.coalesce(F.col("_d.model_result.status"), F.lit("MODEL_NOT_READY"))
        .alias("model_status"),
        F.col("_d.model_result.predicted_class").alias("predicted_class"),
    )


SESSION = ("pseudonymized_user_id", "session_id")


def session_keys(*frames: DataFrame) -> list[str]:
    """Person and session where the tables have both; a session id alone may belong to several people."""
    return [k for k in SESSION if all(k in df.columns for df in frames)]


def history(archive: DataFrame, stored: DataFrame) -> DataFrame:
    """Archive rows plus table rows of sessions the archive does not have."""
    keys = session_keys(archive, stored)
    missing = stored.join(archive.select(*keys).distinct(), keys, "left_anti")
    return archive.unionByName(missing, allowMissingColumns=True)


def recent_assessments(df: DataFrame, user: str | None = None, n: int = 100) -> DataFrame:
    """The newest ``n`` assessments, of one person if given (a top-k, no full sort)."""
    if user is not None:
        df = df.filter(F.col("pseudonymized_user_id") == user)
    return df.orderBy(F.col("created_at").desc(), "assessment_id").limit(n)


def assessment_detail(df: DataFrame, session_or_id: str, user: str | None = None) -> DataFrame:
    """Assessments of a session id (of one person if given) or of an assessment id."""
    clean = session_or_id.removeprefix("assessment_").removesuffix(".json")
    found = df.filter((F.col("session_id") == clean) | (F.col("assessment_id") == clean)
                      | (F.col("assessment_id") == f"asmt_{clean}"))
    return found if user is None else found.filter(F.col("pseudonymized_user_id") == user)


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key as (keys, ``_new``): the last by ``order``; full ties are settled by a hash of the row.

    Only the order and the hash are compared, so the other columns may have any type, also maps.
    """
    rest = [n for n in df.columns if n not in keys]
    tie = F.xxhash64(F.to_json(F.struct(*rest)))
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, tie)).alias("_new"))


def latest_profile(profiles: DataFrame, keys: Sequence[str] = ("user_id",)) -> DataFrame:
    """Newest baseline profile per person."""
    return newest_rows(profiles, keys, ["last_updated"]).select(*keys, "_new.*")


def delete_sessions(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows that stay when the sessions in ``ids`` are deleted."""
    keys = session_keys(df, ids)
    return df.join(ids.select(*keys).distinct(), keys, "left_anti")


def merge_by_key(
    base: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    update_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Insert new keys and overwrite existing ones with their newest update, the last by ``order``.

    ``order`` is one column or several, the later ones to settle ties.  ``update_cols`` limits which columns change on an existing row.  Repeated updates of a key
    are reduced by an aggregate before the join, so a key with very many updates is no problem.
    """
    keys = list(keys)
    columns = [n for n in base.columns if n not in keys]
    change = set(update_cols if update_cols is not None else columns)
    newest = newest_rows(updates, keys, [order] if isinstance(order, str) else order)
    old = base.select(*keys, F.struct(*columns).alias("_old"))
    given = set(updates.columns)

    def value(n: str) -> Column:
        kept = F.col("_old")[n]
        if n not in given:
            return kept
        fresh = F.col("_new")[n]
        if n in change:
            return F.when(F.col("_new").isNotNull(), fresh).otherwise(kept)
        return F.when(F.col("_old").isNotNull(), kept).otherwise(fresh)

    joined = old.join(newest, keys, "full")
    return joined.select(*keys, *[value(n).alias(n) for n in columns]).select(*base.columns)
