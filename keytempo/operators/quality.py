"""Data quality: every check is one aggregate over the table, reported as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytempo import names
from keytempo.functions import columns as c
from keytempo.operators.adapt import detect_roles
from keytempo.operators.groups import over_groups

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")
EXTREME_DWELL_MS = 4000.0


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def _infinite(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] not in ("double", "float"):
        return F.lit(False)
    return F.abs(F.col(name)) == F.lit(float("inf"))


def _percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(0.0)


def _report(one_row: DataFrame, entries: Sequence[tuple[str, dict[str, Column]]], key: str):
    """Turn one wide row into one row per entry."""
    lines = F.array(*[
        F.struct(F.lit(name).alias(key), *[e.alias(n) for n, e in values.items()])
        for name, values in entries
    ])
    return one_row.select(F.explode(lines).alias("r")).select("r.*")


def missing_values(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column."""
    wide = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(c.is_missing(df, n)).alias(f"_m{i}") for i, n in enumerate(df.columns)],
    )
    return _report(wide, [
        (n, {"missing_count": F.col(f"_m{i}"),
             "missing_percentage": _percent(F.col(f"_m{i}"), F.col("_rows"))})
        for i, n in enumerate(df.columns)
    ], "column_name")


def duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier one, on all columns or a subset; NULLs compare equal."""
    groups = df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("copies"))
    counted = groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_count"),
    )
    return counted.withColumns({
        "duplicate_percentage": _percent(F.col("duplicate_count"), F.col("total_rows")),
        "has_duplicates": F.col("duplicate_count") > 0,
    })


def bad_timestamps(
    df: DataFrame,
    time_col: str = "timestamp",
    keys: Sequence[str] = ("user_id", "session_id"),
    ingest: str = "event_id",
    limit: int | None = None,
) -> DataFrame:
    """Null, negative and out-of-order times per session, in the order rows arrived."""
    t = c.number(time_col)
    timed = df.withColumn("_t", t)

    def body(g):
        rows = g.derive(g.rows, last={"_before": F.col("_t")})
        return g.aggregate(rows, {
            "null_timestamps": F.count_if(F.col("_t").isNull()),
            "negative_timestamps": F.count_if(F.col("_t") < 0),
            "disordered_timestamps": F.count_if(F.col("_t") < F.col("_before")),
        })

    out = over_groups(timed, keys, (ingest,), body, limit)
    return out.withColumn(
        "is_valid", (F.col("null_timestamps") == 0) & (F.col("negative_timestamps") == 0))


def negative_durations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or [n for n in names.DURATION_COLUMNS if n in df.columns])
    wide = df.agg(*[F.count_if(c.number(n) < 0).alias(f"_v{i}") for i, n in enumerate(columns)])
    return _report(wide, [
        (n, {"violations": F.col(f"_v{i}")}) for i, n in enumerate(columns)
    ], "column_name")


def numeric_anomalies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Infinite and missing values per numeric column, and very long holds."""
    columns = list(columns or numeric_columns(df))
    aggs = []
    for i, n in enumerate(columns):
        aggs += [
            F.count_if(_infinite(df, n)).alias(f"_i{i}"),
            F.count_if(c.is_missing(df, n)).alias(f"_m{i}"),
            F.count_if(F.col(n) > EXTREME_DWELL_MS).alias(f"_x{i}"),
        ]
    return _report(df.agg(*aggs), [
        (n, {
            "infinite_values": F.col(f"_i{i}"), "nan_values": F.col(f"_m{i}"),
            "extreme_dwell": F.col(f"_x{i}") if n in names.DWELL_COLUMNS
            else F.lit(0).cast("long"),
        }) for i, n in enumerate(columns)
    ], "column_name")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Count and share per class with the max/min ratio and an imbalance flag."""
    counts = (df.filter(F.col(label).isNotNull()).groupBy(label)
              .agg(F.count(F.lit(1)).alias("class_count")))
    # One row of totals, looked up while the plan runs; classes may be many.
    total = counts.agg(F.struct(F.max("class_count").alias("most"), F.min("class_count").alias("fewest"),
                                F.sum("class_count").alias("rows")).alias("t")).scalar()
    ratio = F.col("_total.most") / F.greatest(F.col("_total.fewest"), F.lit(1))
    return counts.withColumn("_total", total).select(
        F.col(label).cast("string").alias("label"),
        "class_count",
        F.round(F.col("class_count") / F.col("_total.rows"), 4)
        .alias("class_proportion"),
        F.round(ratio, 2).alias("imbalance_ratio"),
        (F.round(ratio, 2) > 3.0).alias("is_imbalanced"),
    )


def quality_score(df: DataFrame) -> DataFrame:
    """Score 0-100 from missing cells, repeated rows, negative durations and anomalies.

    Everything is counted on distinct rows weighted by their copies, so the table is read once.
    """
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    w = F.col("_copies")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, w)), F.lit(0))

    missing = sum((c.is_missing(df, n).cast("long") for n in df.columns), F.lit(0))
    durations = [n for n in names.DURATION_COLUMNS if n in df.columns]
    negative = sum((F.coalesce((c.number(n) < 0).cast("long"), F.lit(0)) for n in durations),
                   F.lit(0))
    numeric = numeric_columns(df)
    odd = [_infinite(df, n) | c.is_missing(df, n) for n in numeric]
    odd += [F.coalesce(F.col(n) > EXTREME_DWELL_MS, F.lit(False))
            for n in names.DWELL_COLUMNS if n in numeric]
    counted = rows.agg(
        F.coalesce(F.sum(w), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum(missing * w), F.lit(0)).alias("total_missing_values"),
        F.coalesce(F.sum(w - 1), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(negative * w), F.lit(0)).alias("negative_durations"),
        (total(c.any_of(odd)) > 0).alias("has_numeric_anomalies"),
    )
    cells = F.greatest(F.col("_rows") * len(df.columns), F.lit(1))
    missing_pct = 100.0 * F.col("total_missing_values") / cells
    score = (
        100.0
        - F.least(missing_pct * 3.0, F.lit(30.0))
        - F.least(_percent(F.col("duplicate_rows"), F.col("_rows")) * 2.0, F.lit(20.0))
        - F.least(F.col("negative_durations") * 2.0, F.lit(30.0))
        - F.when(F.col("has_numeric_anomalies"), 15.0).otherwise(0.0)
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(score, 1)))
    return counted.select(
        score.alias("quality_score"),
        F.when(score >= 85, "EXCELLENT").when(score >= 65, "ACCEPTABLE")
        .otherwise("CRITICAL_ISSUES").alias("status"),
        F.round(missing_pct, 2).alias("missing_percentage"),
        "total_missing_values", "duplicate_rows", "negative_durations", "has_numeric_anomalies",
    )


def profile(df: DataFrame) -> DataFrame:
    """One row: size, detected columns, missing and repeated share, people, sessions."""
    roles = detect_roles(df.columns)
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    w = F.col("_copies")
    missing = sum((c.is_missing(df, n).cast("long") for n in df.columns), F.lit(0))

    def distinct(role: str) -> Column:
        col = roles[role]
        return F.count_distinct(col) if col else F.lit(0).cast("long")

    counted = rows.agg(
        F.coalesce(F.sum(w), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(missing * w), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(w - 1), F.lit(0)).alias("duplicate_rows"),
        distinct("user").alias("unique_users"),
        distinct("session").alias("unique_sessions"),
        distinct("label").alias("unique_labels"),
    )
    cells = F.greatest(F.col("row_count") * len(df.columns), F.lit(1))
    text = {k: ",".join(v) if isinstance(v, list) else v for k, v in roles.items()}
    return counted.select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        *[F.lit(text[r]).cast("string").alias(f"{r}_column")
          for r in ("user", "session", "timestamp", "label")],
        F.lit(text["keystroke"]).alias("keystroke_columns"),
        F.lit(text["sensitive"]).alias("sensitive_columns"),
        "missing_cells",
        F.round(100.0 * F.col("missing_cells") / cells, 2).alias("missing_percentage"),
        "duplicate_rows",
        _percent(F.col("duplicate_rows"), F.col("row_count")).alias("duplicate_percentage"),
        "unique_users", "unique_sessions", "unique_labels",
    )


def feature_check(features: DataFrame, skip: Sequence[str] = (
        "user_id", "session_id", "target_label")) -> DataFrame:
    """Missing and infinite values per feature column."""
    columns = [n for n in numeric_columns(features) if n not in skip]
    return numeric_anomalies(features, columns).select(
        "column_name", F.col("nan_values").alias("missing"), F.col("infinite_values")
        .alias("infinite"),
        ((F.col("nan_values") == 0) & (F.col("infinite_values") == 0)).alias("is_valid"),
    )


def canonical_check(df: DataFrame, strict: bool = False) -> DataFrame:
    """Rows (check, violations, passed, severity) for a canonical event table."""
    lowered = {n.strip().lower() for n in df.columns}
    absent = [n for n in names.CANONICAL_REQUIRED if n not in df.columns]
    forbidden = sorted(lowered & set(names.FORBIDDEN_CANONICAL))
    fixed = [
        ("forbidden_columns", F.lit(len(forbidden)).cast("long"), "error"),
        ("missing_columns", F.lit(len(absent)).cast("long"), "error"),
    ]
    if forbidden or absent:
        return _checks(df.agg(F.count(F.lit(1)).alias("_rows")), fixed)
    types = dict(df.dtypes)
    not_numeric = [n for n in ("timestamp", "press_time", "release_time")
                   if types[n] not in NUMERIC]
    key = F.col("key_identifier").cast("string")
    raw_key = ~key.rlike(names.ABSTRACT_KEY) & (F.length(key) < 3)
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(c.is_missing(df, n)).alias(f"_null_{n}")
          for n in ("participant_id", "session_id", "timestamp", "condition")],
        F.count_if(raw_key).alias("_raw_key"),
        F.count_if(~F.lower("event_type").isin(*names.ALLOWED_EVENT_TYPES)).alias("_type"),
        F.count_if(F.col("release_time") < F.col("press_time")).alias("_negative"),
    )
    checks = [
        ("empty_table", F.when(F.col("_rows") == 0, 1).otherwise(0).cast("long"), "error"),
        *fixed,
        *[(f"null_{n}", F.col(f"_null_{n}"), "error")
          for n in ("participant_id", "session_id", "timestamp", "condition")],
        ("not_numeric_columns", F.lit(len(not_numeric)).cast("long"), "error"),
        ("raw_key_identifiers", F.col("_raw_key"), "error"),
        ("event_types", F.col("_type"), "error" if strict else "ignored"),
        ("release_before_press", F.col("_negative"), "warning"),
    ]
    return _checks(counted, checks)


def _checks(one_row: DataFrame, checks) -> DataFrame:
    return _report(one_row, [
        (name, {"violations": bad, "passed": (bad == 0) | F.lit(kind == "ignored"),
                "severity": F.lit(kind)}) for name, bad, kind in checks
    ], "check_name")


def privacy_audit(df: DataFrame, user_col: str | None = None) -> DataFrame:
    """Forbidden columns by name, and the share of ids that are pseudonyms over all rows."""
    found = [n for n in df.columns if n.strip().lower() in names.FORBIDDEN_COLUMNS]
    known = user_col is not None and user_col in df.columns
    share = F.avg(c.is_pseudonym(F.col(user_col)).cast("double")) if known else F.lit(None)
    out = df.agg(F.count(F.lit(1)).alias("row_count"),
                 share.cast("double").alias("pseudonym_share"))
    return out.withColumns({
        "raw_text_columns": F.lit(",".join(found)),
        "pseudonymization_status": F.when(F.col("pseudonym_share").isNull(), "UNKNOWN")
        .when(F.col("pseudonym_share") == 1.0, "ACTIVE").otherwise("UNMASKED_OR_NATIVE"),
        "privacy_result": F.lit("FAIL" if found else "PASS"),
        "zero_text_compliant": F.lit(not found),
    })
