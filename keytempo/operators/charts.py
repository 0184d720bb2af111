"""Series behind the charts: histograms, timelines, running totals and comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytempo import names
from keytempo.operators.groups import over_groups
from keytempo.operators.pairing import KEYS


def chart_histogram(
    df: DataFrame, col: str, low: float, high: float, bins: int = 20
) -> DataFrame:
    """Counts in ``bins`` equal steps from ``low`` to ``high``; outliers join the end bins."""
    step = (high - low) / bins
    at = F.floor((F.col(col) - low) / step)
    slot = F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("int")
    counted = df.filter(F.col(col).isNotNull()).groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("events"))
    return counted.select(
        "bin", (F.lit(low) + F.col("bin") * step).alias("bin_start"),
        (F.lit(low) + (F.col("bin") + 1) * step).alias("bin_end"), "events")


def chart_timeline(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("sequence_index",),
    limit: int | None = None,
) -> DataFrame:
    """Values by their position in the session."""
    return over_groups(
        df, keys, order,
        lambda g: g.derive(g.rows, number="event_index").select(*keys, "event_index", *columns),
        limit)


def chart_pauses(
    df: DataFrame, threshold_ms: float = 500.0, keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("sequence_index",), limit: int | None = None,
) -> DataFrame:
    """Pause bars with the threshold they are compared with."""
    rows = chart_timeline(df, ["pause_duration"], keys, order, limit)
    return rows.withColumns({
        "threshold_ms": F.lit(threshold_ms),
        "is_pause": F.col("pause_duration") > threshold_ms,
    })


def chart_corrections(
    df: DataFrame, flag: str = "backspace", keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("sequence_index",), limit: int | None = None,
) -> DataFrame:
    """Correction flag and its running total by position in the session."""
    def body(g):
        rows = g.derive(
            g.rows, number="event_index",
            sums={"cumulative_corrections": F.col(flag).cast("long")})
        return rows.select(
            *keys, "event_index", F.col(flag).cast("long").alias("correction"),
            F.col("cumulative_corrections").cast("long").alias("cumulative_corrections"))

    return over_groups(df, keys, order, body, limit)


def chart_baseline_compare(
    current: DataFrame,
    baseline_means: DataFrame,
    user: str = "user_id",
    metrics: Mapping[str, str] = names.COMPARED_METRICS,
) -> DataFrame:
    """Current value next to the personal mean, one row per (session, metric).

    Rates up to 1 are shown as percent.  When no named metric is shared, the first five shared
    columns are compared.
    """
    shared = {m: label for m, label in metrics.items()
              if m in current.columns and m in baseline_means.columns}
    if not shared:
        both = [n for n in current.columns
                if n in baseline_means.columns and n not in (user, "session_id")]
        shared = {n: n.replace("_", " ").title() for n in both[:5]}
    means = baseline_means.select(user, *[F.col(m).alias(f"_b_{m}") for m in shared])
    joined = current.join(means, user)

    def value(name: str, metric: str):
        v = F.col(name).cast("double")
        return F.when(v <= 1.0, v * 100.0).otherwise(v) if metric == "pause_rate" else v

    rows = F.array(*[
        F.struct(F.lit(label).alias("metric"), value(m, m).alias("current_value"),
                 value(f"_b_{m}", m).alias("baseline_value"))
        for m, label in shared.items()
    ])
    return joined.select(user, "session_id", F.explode(rows).alias("r")).select(
        user, "session_id", "r.*")


def chart_deviation(deviations: DataFrame) -> DataFrame:
    """z-scores with their 1-sigma and 2-sigma band."""
    size = F.abs(F.round("z_score", 2))
    return deviations.select(
        "user_id", "session_id",
        F.initcap(F.replace("feature", F.lit("_"), F.lit(" "))).alias("feature_label"),
        (F.round("z_score", 2) + F.lit(0.0)).alias("z_score"),
        F.when(size >= 2.0, "beyond_2_sigma").when(size >= 1.0, "beyond_1_sigma")
        .otherwise("within_1_sigma").alias("band"),
    )
