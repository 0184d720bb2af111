"""Large groups must give what small groups give."""

import pytest
from pyspark.sql import functions as F

from keytempo.operators import events, features, groups, pairing
from keytempo.plans.event_queries import canonical, with_markers
from keytempo.plans.key_events import down_up, key_events

from .conftest import rows


def skewed(spark, sf):
    """One session holds a third of all presses, and a tenth of its times are equal."""
    df = key_events(spark, sf)
    hot = F.col("event_id") % 3 == 0
    time = F.when(F.col("event_id") % 30 == 0, F.lit(28410000.0)).otherwise(F.col("press_time"))
    return df.withColumns({
        "user_id": F.when(hot, "hot").otherwise(F.col("user_id")),
        "session_id": F.when(hot, "one").otherwise(F.col("session_id")),
        "release_time": time + F.col("release_time") - F.col("press_time"),
        "press_time": time, "timestamp": time,
    })


CASES = {
    "features": lambda raw, df, n: features.session_features(df, limit=n),
    "variability": lambda raw, df, n: features.group_variability(
        df.withColumn("d", F.col("release_time") - F.col("press_time")), "d", limit=n),
    "timing": lambda raw, df, n: features.timing_features(df, limit=n),
    "flight": lambda raw, df, n: events.flight_times(df, limit=n),
    "telemetry": lambda raw, df, n: features.telemetry(raw, limit=n),
    "pairs": lambda raw, df, n: pairing.pair_live(raw, limit=n),
    "frame": lambda raw, df, n: events.event_features(raw, limit=n),
    "speed": lambda raw, df, n: events.rolling_wpm(raw, limit=n),
    "newest": lambda raw, df, n: events.keep_last(
        df, 5, order=("press_time", "event_id"), limit=n),
    "pauses": lambda raw, df, n: pairing.segment_by_pause(*with_markers(raw), limit=n),
    "active": lambda raw, df, n: pairing.active_duration(*with_markers(raw), limit=n),
}


def raw_rows(df):
    kinds = F.array(
        F.struct(F.lit("down").alias("event_type"), F.col("press_time").alias("timestamp_ms"),
                 (F.col("event_id") * 2).alias("raw_id")),
        F.struct(F.lit("up").alias("event_type"), F.col("release_time").alias("timestamp_ms"),
                 (F.col("event_id") * 2 + 1).alias("raw_id")))
    return df.select("user_id", "session_id", "key_token", F.explode(kinds).alias("r")).select(
        "user_id", "session_id", "key_token", "r.*",
        (F.col("key_token") == "k_error").alias("is_backspace"),
        F.lit(False).alias("is_enter"), F.lit(False).alias("is_space"))


@pytest.mark.parametrize("case", CASES)
def test_large_groups_equal_small_groups(spark, sf, case):
    df = skewed(spark, sf)
    raw = raw_rows(df)
    plan = CASES[case]
    small, large = plan(raw, df, 10**9), plan(raw, df, 20)
    assert rows(large) == rows(small)


def test_pairing_offline_large(spark, sf):
    df = canonical(spark, sf)
    assert rows(pairing.pair_canonical(df, limit=10)) == rows(pairing.pair_canonical(df))


def test_exact_quantiles_match_percentile(spark, sf):
    df = key_events(spark, sf).select(
        "state", (F.col("release_time") - F.col("press_time")).alias("d"))
    found = groups.exact_quantiles(
        df, ["state"], {"q1": ("d", 0.25), "q2": ("d", 0.5), "q9": ("d", 0.9)}, 7)
    wanted = df.groupBy("state").agg(*[
        F.percentile("d", p).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q9", 0.9))])
    assert rows(found) == rows(wanted)
    whole = groups.exact_quantiles(df, [], {"m": ("d", 0.5)}, 50)
    assert rows(whole) == rows(df.agg(F.median("d").alias("m")))


def test_small_groups_plan_has_one_exchange(spark, sf):
    df = features.session_features(key_events(spark, sf))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_segments_follow_the_order_and_split_equal_times(spark):
    time = F.when(F.col("id") % 2 == 0, 500.0).otherwise(F.col("id") * 1.0)
    df = spark.range(4000).select(F.lit("k").alias("k"), time.alias("t"), "id")
    out = groups.cut(df, ["k"], ["t", "id"], 100)
    sizes = [r["count"] for r in out.groupBy("_seg").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) > 30 and max(sizes) <= 300
    ordered = [r._seg for r in out.orderBy("t", "id").collect()]
    assert ordered == sorted(ordered)
