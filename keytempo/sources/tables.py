"""Tables out and in: features, windows, baselines, assessment archive and audit log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo import names
from keytempo.operators.assessments import flatten_assessments
from keytempo.operators.baselines import profiles, wide_baselines
from keytempo.operators.privacy import redact
from keytempo.sources.dated import newest_partitions

ROWS_PER_FILE = 5_000_000


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Write Parquet, CSV or JSON.

    Partitioned output is rebalanced first: adaptive execution merges small pieces and splits a
    partition value that holds a large share of the rows.
    """
    out = df.hint("rebalance", *partition_by) if partition_by else df
    writer = out.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_windows(windows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Window arrays as Parquet, by split when there is one."""
    write_table(windows, path, partition_by=partition_by)


def save_baselines(baselines: DataFrame, folder: str) -> None:
    """The wide table as CSV and one nested JSON document per person."""
    write_table(wide_baselines(baselines), f"{folder}/user_baselines_csv", "csv")
    write_table(nest_baselines(baselines), f"{folder}/baseline_metadata_json", "json")


def nest_baselines(baselines: DataFrame) -> DataFrame:
    """One row per person with all features in a map."""
    required = baselines.groupBy("user_id").agg(
        F.first("min_required_sessions").alias("min_required_sessions"))
    return profiles(baselines).withColumnRenamed("_profile", "features").join(
        required, "user_id")


def load_baselines(spark: SparkSession, folder: str) -> DataFrame:
    """Long baseline table from the nested JSON."""
    stats = ("mean double, std double, median double, mad double, iqr double, min double, "
             "max double, sample_count long")
    schema = ("user_id string, baseline_status string, session_count long, "
              f"min_required_sessions int, features map<string, struct<{_colons(stats)}>>")
    nested = spark.read.schema(schema).json(f"{folder}/baseline_metadata_json")
    kept = ["user_id", "baseline_status", "session_count", "min_required_sessions"]
    return nested.select(*kept, F.explode_outer("features").alias("feature", "s")).select(
        *kept, "feature", "s.*")


def _colons(fields: str) -> str:
    return ", ".join(":".join(f.split()) for f in fields.split(", "))


def write_documents(assessment_rows: DataFrame, folder: str) -> None:
    """Assessment documents as JSON lines, one line per session."""
    assessment_rows.select(F.col("assessment_json").alias("value")).write.mode("append").text(
        folder)


def json_keys(text: Column) -> Column:
    """The keys of a JSON text at any depth, in lower case.

    All strings are taken one after the other, so a key can't be read inside of a value; keys are those before a colon.
    """
    strings = F.regexp_extract_all(text, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:?'), F.lit(0))
    keys = F.filter(strings, lambda s: s.endswith(":"))
    return F.transform(keys, lambda s: F.lower(F.trim(F.regexp_replace(s, r'^"|"\s*:$', ""))))


def list_sessions(spark: SparkSession, folder: str, one_per_file: bool = True) -> DataFrame:
    """Scan a folder with one assessment document per JSON file, or one per line as ``write_documents`` leaves them.

    Broken documents become rows with quality CORRUPTED, documents with a forbidden key at any depth
    become BLOCKED and show nothing of their content.
    """
    docs = (
        (spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True) if one_per_file
         else spark.read.text(folder))
        .select(
            F.col("value").alias("assessment_json"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("_metadata.file_modification_time").alias("modified"))
    )
    keys = json_keys(F.col("assessment_json"))
    parsed = docs.withColumns({
        "_broken": F.try_parse_json("assessment_json").isNull(),
        "_blocked": F.coalesce(F.arrays_overlap(
            keys, F.array(*map(F.lit, names.FORBIDDEN_PAYLOAD_KEYS))), F.lit(False)),
        "_id": F.get_json_object("assessment_json", "$.session_id"),
        "_type": F.get_json_object("assessment_json", "$.session_type"),
        "_time": F.get_json_object("assessment_json", "$.timestamp"),
    })
    flat = flatten_assessments(parsed)
    stem = F.regexp_replace(F.regexp_replace("file_name", "\\.json$", ""), "^assessment_", "")
    bad = F.col("_broken") | F.col("_blocked")

    def shown(good: Column, broken: str | None, blocked: str | None) -> Column:
        return (F.when(F.col("_broken"), F.lit(broken)).when(F.col("_blocked"), F.lit(blocked))
                .otherwise(good))

    return flat.select(
        F.when(bad, stem).otherwise(F.coalesce("_id", stem)).alias("session_id"),
        "file_name", "modified",
        F.when(bad, F.date_format("modified", "yyyy-MM-dd HH:mm:ss")).otherwise(F.coalesce(
            F.replace(F.substring("_time", 1, 19), F.lit("T"), F.lit(" ")),
            F.date_format("modified", "yyyy-MM-dd HH:mm:ss"))).alias("date"),
        shown(F.coalesce("_type", F.lit("ANALYSIS")), "UNKNOWN", "BLOCKED").alias("session_type"),
        F.when(bad, 0.0).otherwise(F.col("duration_s")).alias("duration_s"),
        F.when(bad, F.lit(0)).otherwise(F.col("event_count")).alias("event_count"),
        shown(F.when(F.col("is_valid"), "VALID").otherwise("INVALID"), "CORRUPTED", "BLOCKED")
        .alias("quality"),
        shown(F.coalesce("quality_verdict", F.lit("UNKNOWN")), "CORRUPTED_JSON",
              "PRIVACY_VIOLATION").alias("quality_verdict"),
        shown(F.col("baseline_status"), "N/A", "BLOCKED").alias("baseline_status"),
        F.when(~bad, F.col("tdi")).alias("tdi"),
        shown(F.col("model_status"), "N/A", "BLOCKED").alias("model_status"),
        F.when(~bad, F.col("predicted_class")).alias("predicted_class"),
        bad.alias("is_corrupted"),
    )


def newest_first(sessions: DataFrame, n: int | None = None) -> DataFrame:
    ordered = sessions.orderBy(F.col("modified").desc(), "file_name")
    return ordered if n is None else ordered.limit(n)


def append_audit(events: DataFrame, path: str, details: str = "details") -> None:
    """Append redacted audit events as JSON lines, by day of their time."""
    rows = redact(events, details).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    rows.hint("rebalance", "day").write.mode("append").partitionBy("day").json(path)


def recent_audit(
    spark: SparkSession, path: str, n: int = 50, details: str = "map<string,string>"
) -> DataFrame:
    """The newest ``n`` audit events; only the newest days that hold that many are read."""
    schema = f"timestamp timestamp, event_type string, actor_role string, details {details}"
    days = newest_partitions(spark, path, n)
    log = spark.read.schema(schema).json(days) if days else spark.createDataFrame([], schema)
    return log.orderBy(F.col("timestamp").desc(), "event_type", "actor_role").limit(n)
