"""Baselines kept from value counts: equal to those over all sessions."""

import random
import statistics as plain

import pytest
from pyspark.sql import functions as F

from keytempo.operators import baselines, value_counts
from keytempo.streaming.incremental import IncrementalBaselines

from .conftest import rows

FEATURES = ("mean_dwell_time", "pause_rate")
SCHEMA = "user_id string, session_id string, mean_dwell_time double, pause_rate double"


def test_bands_follow_the_order(spark):
    rng = random.Random(1)
    values = sorted([0.0, -0.0, 1e-300, -1e-300, 5e-324, 1e308, -1e308, 2.0, -2.0] + [
        rng.choice([-1, 1]) * 10 ** rng.uniform(-15, 15) for _ in range(500)])
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(
        value_counts.band_of(F.col("v")).alias("b")).collect()]
    assert got == sorted(got) and len(set(got)) > 200


def test_statistics_of_counted_values(spark):
    rng, groups, data = random.Random(2), {}, []
    for g in range(5):
        for v in [rng.choice([0.0, -3.5, 7.25, rng.uniform(-10, 100)]) for _ in range((1, 2, 9, 40, 100)[g])]:
            n = rng.randint(1, 5)
            data.append((g, v, n))
            groups.setdefault(g, []).extend([v] * n)
    got = {r.g: r for r in value_counts.statistics(spark.createDataFrame(data, "g long, value double, n long"), ["g"]).collect()}
    for g, v in groups.items():
        v = sorted(v)

        def at(p, v=v):
            k = (len(v) - 1) * p
            return v[int(k)] + (v[min(int(k) + 1, len(v) - 1)] - v[int(k)]) * (k - int(k))

        med = plain.median(v)
        want = {"mean": plain.fmean(v), "median": med, "mad": plain.median(abs(x - med) for x in v), "iqr": at(.75) - at(.25),
                "min": v[0], "max": v[-1], "std": plain.stdev(v) if len(v) > 1 else 0.0}
        assert got[g].sample_count == len(v)
        for name, x in want.items():
            assert got[g][name] == pytest.approx(x, abs=1e-9), (g, name)


def some_sessions(rng, people, days):
    return [(f"p{p}", f"d{d}", rng.choice([None, 100.0, rng.uniform(50, 150)]), rng.choice([0.0, 0.25, rng.random()]))
            for p in people for d in days]


def test_batches_equal_one_table(spark, tmp_path):
    rng, known = random.Random(3), {}
    kept = IncrementalBaselines(spark, str(tmp_path / "b"), FEATURES, rows_per_bucket=20)
    batches = [some_sessions(rng, range(6), range(4)), some_sessions(rng, (1, 2), range(3, 7)), some_sessions(rng, (2, 9), range(2, 9))]
    for i, batch in enumerate(batches):
        odd = [(None, "d", 1.0, 1.0), ("p1", None, 1.0, 1.0)]
        frame = spark.createDataFrame(batch + odd, SCHEMA)
        kept.update(frame, i)
        known |= {r[:2]: r for r in batch}
        if i == 1:  # a batch that is sent again changes nothing
            kept.update(frame, i)
    want = baselines.user_baselines(spark.createDataFrame(list(known.values()), SCHEMA), features=FEATURES).filter("feature IS NOT NULL")
    names = ["user_id", "feature", "session_count", *baselines.STATS]
    assert rows(kept.baselines.current()[1].select(*names)) == rows(want.select(*names))


def test_a_batch_that_was_cut_short(spark, tmp_path):
    rng = random.Random(4)
    first, second = some_sessions(rng, range(3), range(6)), some_sessions(rng, (0, 1), range(4, 8))
    kept = IncrementalBaselines(spark, str(tmp_path / "b"), FEATURES)
    kept.update(spark.createDataFrame(first, SCHEMA), 0)
    merge, kept.sessions.merge = kept.sessions.merge, None  # lost before the sessions were stored
    with pytest.raises(TypeError):
        kept.update(spark.createDataFrame(second, SCHEMA), 1)
    kept.sessions.merge = merge
    kept.update(spark.createDataFrame(second, SCHEMA), 1)
    known = {r[:2]: r for r in [*first, *second]}
    want = baselines.user_baselines(spark.createDataFrame(list(known.values()), SCHEMA), features=FEATURES).filter("feature IS NOT NULL")
    names = ["user_id", "feature", "session_count", *baselines.STATS]
    assert rows(kept.baselines.current()[1].select(*names)) == rows(want.select(*names))


def test_an_update_opens_buckets_of_its_persons_only(spark, tmp_path):
    rng = random.Random(5)
    kept = IncrementalBaselines(spark, str(tmp_path / "b"), FEATURES, rows_per_bucket=10)
    kept.update(spark.createDataFrame(some_sessions(rng, range(30), range(5)), SCHEMA), 0)
    before = kept.values.directory()
    kept.update(spark.createDataFrame(some_sessions(rng, (7,), (5,)), SCHEMA), 1)
    after = kept.values.directory()
    again = [b for b, (v, _) in after.held.items() if v == 1]
    # The person's bucket, and two for each bucket that the table has grown by.
    assert len(before.held) > 10 and len(again) <= 1 + 2 * (after.buckets - before.buckets)
