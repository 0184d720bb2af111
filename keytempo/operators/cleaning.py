"""Cleaning with a reason for every removed row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytempo import names
from keytempo.functions import columns as c
from keytempo.operators.adapt import quarantine_text, text_columns


@dataclass(frozen=True)
class Bounds:
    min_dwell_ms: float = 10.0
    max_dwell_ms: float = 4000.0
    min_flight_ms: float = -200.0
    max_flight_ms: float = 10000.0


def _true(cond: Column) -> Column:
    """Missing values pass every check."""
    return F.coalesce(cond, F.lit(False))


def check_rows(
    df: DataFrame,
    bounds: Bounds = Bounds(),
    time_col: str | None = "timestamp",
    row_id: str | None = None,
) -> DataFrame:
    """Distinct rows with ``copies`` and the first failing ``reason`` (NULL when clean).

    ``row_id`` is left out of the comparison of rows and keeps its smallest value.  Exact copies
    are found by an aggregate that combines before the shuffle.
    """
    rows = quarantine_text(df)
    compared = [n for n in rows.columns if n != row_id]
    aggs = [F.count(F.lit(1)).alias("copies")]
    if row_id:
        aggs.append(F.min(row_id).alias(row_id))
    rows = rows.groupBy(*compared).agg(*aggs)

    checks: list[tuple[Column, str]] = []
    if time_col and time_col in rows.columns:
        t = F.col(time_col)
        checks.append((c.is_missing(rows, time_col) | (t < 0), "invalid_timestamp"))
    for name in names.DWELL_COLUMNS:
        if name in rows.columns:
            d = c.number(name)
            checks.append((_true(d < bounds.min_dwell_ms), "short_dwell"))
            checks.append((_true(d > bounds.max_dwell_ms), "long_dwell"))
    if {"press_time", "release_time"} <= set(rows.columns):
        d = c.number("release_time") - c.number("press_time")
        outside = (d < bounds.min_dwell_ms) | (d > bounds.max_dwell_ms)
        checks.append((_true(outside), "bad_computed_dwell"))
    for name in names.FLIGHT_COLUMNS:
        if name in rows.columns:
            f = c.number(name)
            checks.append((_true(f < bounds.min_flight_ms), "negative_flight"))
            checks.append((_true(f > bounds.max_flight_ms), "long_flight"))
    reason = F.lit(None).cast("string")
    for cond, text in reversed(checks):
        reason = F.when(cond, text).otherwise(reason)
    return rows.withColumn("reason", reason)


def clean_events(
    df: DataFrame,
    bounds: Bounds = Bounds(),
    time_col: str | None = "timestamp",
    row_id: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(clean rows, one-row report).  Flights that are mildly negative become 0."""
    checked = check_rows(df, bounds, time_col, row_id)
    clean = checked.filter(F.col("reason").isNull()).drop("reason", "copies")
    flights = [n for n in names.FLIGHT_COLUMNS if n in clean.columns]
    clean = clean.withColumns({
        n: F.when(F.col(n) < 0, F.lit(0).cast(dict(clean.dtypes)[n])).otherwise(F.col(n))
        for n in flights
    })
    return clean, clean_report(checked, text_columns(df))


def clean_report(checked: DataFrame, quarantined: Sequence[str] = ()) -> DataFrame:
    def failed(*reasons: str) -> Column:
        return F.count_if(F.col("reason").isin(*reasons))

    report = checked.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("input_rows"),
        F.count_if(F.col("reason").isNull()).alias("final_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
        failed("invalid_timestamp").alias("invalid_timestamps"),
        failed("short_dwell", "bad_computed_dwell", "negative_flight").alias("negative_durations"),
        failed("long_dwell", "long_flight").alias("extreme_outliers"),
    )
    return report.withColumns({
        "removed_rows": F.col("input_rows") - F.col("final_rows"),
        "retention_rate_pct": F.round(100.0 * c.ratio(F.col("final_rows"), F.col("input_rows")), 2),
        "sensitive_text_columns_quarantined": F.lit(",".join(quarantined)),
    })


def rejects(checked: DataFrame) -> DataFrame:
    """Removed rows with their reason and how many input rows they stand for.

    Extra copies of a row appear as one row with reason ``duplicate``.
    """
    failed = checked.filter(F.col("reason").isNotNull()).withColumn("removed", F.lit(1).cast("long"))
    copies = checked.filter(F.col("copies") > 1).withColumns({
        "reason": F.lit("duplicate"), "removed": F.col("copies") - 1,
    })
    return failed.unionByName(copies).drop("copies")


def basic_clean(
    df: DataFrame,
    min_hold_ms: float = 10.0,
    max_hold_ms: float = 2000.0,
    max_flight_ms: float = 5000.0,
) -> DataFrame:
    """Drop rows with any missing value, then holds and flights outside their bounds."""
    keep = [~c.is_missing(df, n) for n in df.columns]
    if "hold_time" in df.columns:
        keep.append(F.col("hold_time").between(min_hold_ms, max_hold_ms))
    if "flight_time" in df.columns:
        keep.append(F.col("flight_time").between(0.0, max_flight_ms))
    out = df
    for cond in keep:
        out = out.filter(cond)
    return out
