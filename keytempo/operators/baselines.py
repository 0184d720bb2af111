"""Personal baselines and how far sessions lie from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytempo import names
from keytempo.functions import columns as c
from keytempo.operators.groups import over_groups

MIN_SESSIONS = 5
TOLERANCE = 0.5
NEAR_ZERO = 1e-5
CUTOFF_FLOOR = 1e-4
OUTLIER_FACTOR = 2.5
MAD_SCALE = 1.4826
STATS = ("mean", "std", "median", "mad", "iqr", "min", "max", "sample_count")


def baseline_features(df: DataFrame, wanted: Sequence[str] | None = None) -> list[str]:
    return [f for f in (wanted or names.BASELINE_FEATURES) if f in df.columns]


def user_baselines(
    sessions: DataFrame,
    min_sessions: int = MIN_SESSIONS,
    features: Sequence[str] | None = None,
    user: str = "user_id",
    limit: int | None = None,
) -> DataFrame:
    """Long baseline table: one row per (person, feature).

    People with too few sessions get one row with status ``insufficient_history`` and no
    feature.  All statistics of a person come from one exchange of wide session rows.
    """
    features = baseline_features(sessions, features)
    if user not in sessions.columns:
        sessions = sessions.withColumn(user, F.lit("default_user"))
    wide = sessions.select(F.col(user).alias("user_id"),
                           *[c.number(f).alias(f) for f in features])

    def body(g):
        plain = {"session_count": F.count(F.lit(1))}
        quantiles, mads = {}, {}
        for i, f in enumerate(features):
            plain |= {f"n{i}": F.count(f), f"avg{i}": F.avg(f), f"sd{i}": F.stddev_samp(f),
                      f"lo{i}": F.min(f), f"hi{i}": F.max(f)}
            quantiles |= {f"q1{i}": (f, 0.25), f"q2{i}": (f, 0.5), f"q3{i}": (f, 0.75)}
            mads[f"mad{i}"] = f
        return g.aggregate(g.rows, plain, quantiles, mads)

    stats = over_groups(wide, ["user_id"], (), body, limit)
    enough = F.col("session_count") >= min_sessions

    def entry(i: int, f: str) -> Column:
        n = F.col(f"n{i}")
        return F.when(enough & (n > 0), F.struct(
            F.lit(f).alias("feature"),
            F.col(f"avg{i}").alias("mean"),
            F.when(n > 1, F.col(f"sd{i}")).otherwise(0.0).alias("std"),
            F.col(f"q2{i}").alias("median"),
            F.col(f"mad{i}").alias("mad"),
            (F.col(f"q3{i}") - F.col(f"q1{i}")).alias("iqr"),
            F.col(f"lo{i}").alias("min"),
            F.col(f"hi{i}").alias("max"),
            n.alias("sample_count"),
        ))

    entries = F.filter(F.array(*[entry(i, f) for i, f in enumerate(features)]),
                       lambda x: x.isNotNull())
    return stats.select(
        "user_id",
        F.when(enough, "available").otherwise("insufficient_history").alias("baseline_status"),
        "session_count",
        F.lit(min_sessions).alias("min_required_sessions"),
        F.explode_outer(entries).alias("b"),
    ).select("user_id", "baseline_status", "session_count", "min_required_sessions", "b.*")


def profiles(baselines: DataFrame) -> DataFrame:
    """One row per person with all feature statistics in a map (one entry per feature)."""
    stats = F.struct(*[s for s in STATS if s in baselines.columns])
    entry = F.when(F.col("feature").isNotNull(), F.struct("feature", stats.alias("s")))
    return baselines.groupBy("user_id").agg(
        F.first("baseline_status").alias("baseline_status"),
        F.first("session_count").alias("session_count"),
        F.map_from_entries(F.collect_list(entry)).alias("_profile"),
    )


def join_profiles(
    sessions: DataFrame, baselines: DataFrame, how: str = "inner",
    split_above: int | None = None,
) -> DataFrame:
    """Wide session rows with the profile of their person: one join row per session.

    The profile side has one row per person, so adaptive execution may split the partition of a
    person with very many sessions.  ``split_above`` does it by plan instead, for stored
    baseline tables: profiles of people above that many sessions, at most sessions / split_above
    of them, are joined apart.  Spark broadcasts them where it has measured that they are small, and
    then their sessions are not shuffled at all.
    """
    known = profiles(baselines)
    if split_above is None:
        return sessions.join(known, "user_id", how)
    heavy = known.filter(F.col("session_count") > split_above)
    rest = known.filter(F.col("session_count") <= split_above)
    light = sessions.join(heavy, "user_id", "left_anti").join(rest, "user_id", how)
    return light.unionByName(sessions.join(heavy, "user_id"))


def _entries(features: Sequence[str]) -> Column:
    """Array of (feature, value, statistics) for the features a session and its profile share."""
    def entry(f: str) -> Column:
        known = F.try_element_at("_profile", F.lit(f))
        value = c.number(f)
        return F.when(value.isNotNull() & known.isNotNull(), F.struct(
            F.lit(f).alias("feature"), value.alias("value"), known.alias("s")))

    return F.filter(F.array(*[entry(f) for f in features]), lambda x: x.isNotNull())


def _long(joined: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return joined.select(*keep, F.explode(_entries(features)).alias("_e")).select(
        *keep, "_e.feature", "_e.value", "_e.s.*")


def baseline_outliers(
    sessions: DataFrame, baselines: DataFrame, features: Sequence[str] | None = None,
    keep: Sequence[str] = ("user_id", "session_id"), split_above: int | None = None,
) -> DataFrame:
    """Historical sessions far from the personal median, per feature."""
    features = baseline_features(sessions, features)
    joined = join_profiles(sessions.select(*keep, *features), baselines, "inner", split_above)
    cutoff = F.when(F.col("mad") > CUTOFF_FLOOR, OUTLIER_FACTOR * F.col("mad")).otherwise(
        OUTLIER_FACTOR * F.col("std"))
    return _long(joined, features, keep).withColumn("cutoff", cutoff).filter(
        (F.col("cutoff") > CUTOFF_FLOOR)
        & (F.abs(F.col("value") - F.col("median")) > F.col("cutoff"))
    ).select(*keep, "feature", "value", "median", "cutoff")


def session_deviation(
    sessions: DataFrame,
    baselines: DataFrame,
    tolerance: float = TOLERANCE,
    features: Sequence[str] | None = None,
    keep: Sequence[str] = ("user_id", "session_id"),
    split_above: int | None = None,
) -> DataFrame:
    """One row per (session, feature) with absolute, relative and standardised deviation."""
    features = baseline_features(sessions, features)
    joined = join_profiles(sessions.select(*keep, *features), baselines, "inner", split_above)
    long = _long(joined, features, keep).select(*keep, "feature", "value", *[
        F.col(s).alias(f"baseline_{s}") for s in ("mean", "std", "median", "mad")])
    return deviation_columns(long, tolerance)


def _z(value: Column, mean: Column, std: Column, median: Column, mad: Column) -> Column:
    robust = F.when(mad > NEAR_ZERO, (value - median) / (MAD_SCALE * mad)).otherwise(0.0)
    return F.when(std > NEAR_ZERO, (value - mean) / std).otherwise(robust)


def session_index(
    sessions: DataFrame, baselines: DataFrame, features: Sequence[str] | None = None,
    keep: Sequence[str] = ("user_id", "session_id"), split_above: int | None = None,
) -> DataFrame:
    """Deviation index of every session, NULL with a status where there is no baseline.

    The index is computed inside the joined row: no row per feature and no second shuffle.
    """
    features = baseline_features(sessions, features)
    joined = join_profiles(sessions.select(*keep, *features), baselines, "left", split_above)
    sizes = F.transform(_entries(features), lambda e: F.least(F.lit(4.0), F.abs(_z(
        e["value"], e["s"]["mean"], e["s"]["std"], e["s"]["median"], e["s"]["mad"]))))
    joined = joined.withColumn("_sizes", sizes)
    n = F.size("_sizes")
    total = F.aggregate("_sizes", F.lit(0.0), lambda a, x: a + x)
    status = F.coalesce("baseline_status", F.lit("unavailable"))
    return joined.select(
        *keep, status.alias("baseline_status"), "session_count",
        F.when(status == "available", F.when(n > 0, total / n * 25.0).otherwise(0.0))
        .alias("typing_deviation_index"),
        F.when((status == "available") & (n > 0), n.cast("long")).alias("evaluated_features"),
    )


def deviation_columns(df: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Deviation columns from value, baseline_mean, _std, _median and _mad."""
    value, mean, std = F.col("value"), F.col("baseline_mean"), F.col("baseline_std")
    z = _z(value, mean, std, F.col("baseline_median"), F.col("baseline_mad"))
    out = df.withColumns({
        "absolute_deviation": value - mean,
        "percentage_deviation": F.when(
            F.abs(mean) > NEAR_ZERO, (value - mean) / mean * 100.0).otherwise(0.0),
        "z_score": z,
        "has_zero_variance": ~(std > NEAR_ZERO),
    })
    direction = (F.when(F.col("z_score") > tolerance, "higher")
                 .when(F.col("z_score") < -tolerance, "lower").otherwise("within_baseline"))
    return out.withColumns({
        "direction": direction,
        "status": F.when(direction == "within_baseline", "within_expected_variance")
        .otherwise("deviated"),
    })


def deviation_index(
    deviations: DataFrame, keep: Sequence[str] = ("user_id", "session_id")
) -> DataFrame:
    """Typing deviation index 0-100 per session: mean of min(|z|, 4) times 25."""
    return deviations.groupBy(*keep).agg(
        (F.avg(F.least(F.abs("z_score"), F.lit(4.0))) * 25.0).alias("typing_deviation_index"),
        F.count(F.lit(1)).alias("evaluated_features"),
    )


def deviation_level(index: Column) -> Column:
    return (F.when(index.isNull(), "unavailable").when(index >= 60.0, "higher_deviation")
            .when(index >= 30.0, "moderate_deviation").otherwise("expected_variance"))


def top_deviations(
    deviations: DataFrame, k: int = 5, keep: Sequence[str] = ("user_id", "session_id")
) -> DataFrame:
    """The ``k`` largest deviations of each session with a short description.

    A session has at most one row per baseline feature, so the window stays tiny.
    """
    w = Window.partitionBy(*keep).orderBy(F.abs("z_score").desc(), "feature")
    z = F.col("z_score")
    text = F.concat(
        F.when(z > 0, "+").otherwise(""), F.format_string("%.1f", z), F.lit(" SD "),
        F.col("direction"), F.lit(" than baseline"))
    return deviations.withColumn("rank", F.row_number().over(w)).filter(
        F.col("rank") <= k).withColumn("descriptor", text)


def update_baselines(
    old_sessions: DataFrame, new_sessions: DataFrame, **options
) -> DataFrame:
    """Baselines over old and new sessions together; a newer row replaces the same session."""
    keys = ["user_id", "session_id"]
    kept = old_sessions.join(new_sessions.select(*keys), keys, "left_anti")
    return user_baselines(kept.unionByName(new_sessions, allowMissingColumns=True), **options)


def calibration_progress(
    sessions: DataFrame, required: int = MIN_SESSIONS, session_type: str = "session_type"
) -> DataFrame:
    """Completed, required and remaining calibration sessions per person."""
    done = F.count_if(F.col(session_type) == "CALIBRATION")
    out = sessions.groupBy("user_id").agg(done.alias("completed_sessions"))
    ready = F.col("completed_sessions") >= required
    return out.withColumns({
        "required_sessions": F.lit(required),
        "remaining_sessions": F.greatest(F.lit(0), F.lit(required) - F.col("completed_sessions")),
        "ready": ready,
        "status": F.when(ready, "BASELINE_READY").otherwise("BASELINE_NOT_READY"),
    })


def rolling_deviation(
    sessions: DataFrame,
    order: Sequence[str],
    features: Sequence[str] | None = None,
    min_sessions: int = MIN_SESSIONS,
    user: str = "user_id",
    limit: int | None = None,
) -> DataFrame:
    """Deviation of each session from the person's *earlier* sessions only."""
    features = baseline_features(sessions, features)
    wide = sessions.select(user, "session_id", *[n for n in order if n != "session_id"],
                           *[c.number(f).alias(f) for f in features])

    def body(g):
        rows = g.derive(g.rows, number="_earlier", stats={f: f for f in features})
        entries = F.array(*[
            F.struct(
                F.lit(f).alias("feature"), F.col(f).alias("value"),
                F.col(f"{f}_n").cast("long").alias("history"),
                F.col(f"{f}_mean").alias("baseline_mean"),
                F.col(f"{f}_std").alias("baseline_std"),
            ) for f in features
        ])
        long = rows.filter(F.col("_earlier") >= min_sessions).select(
            user, "session_id", F.explode(entries).alias("e")).select(user, "session_id", "e.*")
        return long.filter(F.col("value").isNotNull() & (F.col("history") >= 2))

    long = over_groups(wide, [user], order, body, limit)
    z = (F.col("value") - F.col("baseline_mean")) / F.col("baseline_std")
    return long.withColumn(
        "z_score", F.when(F.col("baseline_std") > NEAR_ZERO, z).otherwise(0.0))


def wide_baselines(baselines: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """One row per person with ``<feature>_<stat>`` columns, the tabular sink form."""
    features = list(features or names.BASELINE_FEATURES)
    aggs = [
        F.max(F.when(F.col("feature") == f, F.col(s))).alias(f"{f}_{s}")
        for f in features for s in ("mean", "std", "median", "mad")
    ]
    return baselines.groupBy(
        "user_id", "baseline_status", "session_count", "min_required_sessions").agg(*aggs)
