"""Baselines, deviations and their edge cases."""

from keytempo.operators import baselines as bl
from keytempo.sources import tables

from .conftest import rows


def sessions(spark, values, user="u", feature="mean_dwell_time"):
    return spark.createDataFrame(
        [(user, f"s{i}", float(v) if v is not None else None) for i, v in enumerate(values)],
        f"user_id string, session_id string, {feature} double")


def test_statistics(spark):
    base = bl.user_baselines(sessions(spark, (50, 52, 48, 54, 46))).collect()[0]
    assert (base["mean"], base["median"], base["min"], base["max"]) == (50, 50, 46, 54)
    assert base["mad"] == 2 and base["iqr"] == 4 and base.sample_count == 5
    assert abs(base["std"] - 10 ** 0.5) < 1e-12


def test_too_few_sessions(spark):
    base = bl.user_baselines(sessions(spark, (50, 52, 48))).collect()
    assert len(base) == 1
    assert base[0].baseline_status == "insufficient_history" and base[0].feature is None


def test_deviation_and_index(spark):
    known = sessions(spark, (45, 45, 50, 55, 55))
    base = bl.user_baselines(known)
    std = base.collect()[0]["std"]
    dev = bl.session_deviation(sessions(spark, (50 + 2 * std,)), base).collect()[0]
    assert abs(dev.z_score - 2) < 1e-9 and dev.direction == "higher" and dev.status == "deviated"
    assert abs(dev.percentage_deviation - 4 * std) < 1e-9
    index = bl.session_index(sessions(spark, (50 + 2 * std,)), base).collect()[0]
    assert abs(index.typing_deviation_index - 50) < 1e-9


def test_zero_variance_and_zero_mean(spark):
    base = bl.user_baselines(sessions(spark, (0, 0, 0, 0, 0)))
    dev = bl.session_deviation(sessions(spark, (3,)), base).collect()[0]
    assert dev.z_score == 0 and dev.percentage_deviation == 0 and dev.has_zero_variance
    assert dev.direction == "within_baseline"


def test_unknown_person_has_no_index(spark):
    base = bl.user_baselines(sessions(spark, (1, 2, 3, 4, 5)))
    got = bl.session_index(sessions(spark, (3,), user="new"), base).collect()[0]
    assert got.baseline_status == "unavailable" and got.typing_deviation_index is None


def test_outliers(spark):
    known = sessions(spark, (50, 51, 49, 50, 90))
    out = bl.baseline_outliers(known, bl.user_baselines(known)).collect()
    assert [r.session_id for r in out] == ["s4"]


def test_heavy_people_give_the_same(spark):
    known = sessions(spark, range(40)).unionByName(sessions(spark, range(9), user="v"))
    plain, split = bl.user_baselines(known), bl.user_baselines(known, limit=10)
    assert rows(plain) == rows(split)
    assert rows(bl.session_deviation(known, plain)) == rows(
        bl.session_deviation(known, plain, split_above=10))
    assert rows(bl.session_index(known, plain)) == rows(
        bl.session_index(known, plain, split_above=10))
    order = ("session_nr", "session_id")
    numbered = known.selectExpr("*", "int(substring(session_id, 2)) AS session_nr")
    assert rows(bl.rolling_deviation(numbered, order, limit=10)) == rows(
        bl.rolling_deviation(numbered, order))


def test_rolling_uses_earlier_sessions_only(spark):
    numbered = sessions(spark, (10, 20, 30, 1000)).selectExpr(
        "*", "int(substring(session_id, 2)) AS session_nr")
    out = bl.rolling_deviation(numbered, ("session_nr",), min_sessions=3).collect()
    assert len(out) == 1 and out[0].baseline_mean == 20 and out[0].baseline_std == 10


def test_top_deviations_rank_by_size(spark):
    dev = spark.createDataFrame(
        [("u", "s", f, z, "higher") for f, z in (("a", 1.0), ("b", -3.0), ("c", 2.0))],
        "user_id string, session_id string, feature string, z_score double, direction string")
    got = bl.top_deviations(dev, 2).orderBy("rank").collect()
    assert [r.feature for r in got] == ["b", "c"]
    assert got[1].descriptor == "+2.0 SD higher than baseline"


def test_round_trip(spark, tmp_path):
    known = sessions(spark, range(6)).unionByName(sessions(spark, (1,), user="few"))
    base = bl.user_baselines(known)
    tables.save_baselines(base, str(tmp_path))
    back = tables.load_baselines(spark, str(tmp_path))
    assert rows(back) == rows(base.select(*back.columns))
    wide = spark.read.option("header", True).csv(f"{tmp_path}/user_baselines_csv")
    assert wide.filter("user_id = 'u'").collect()[0]["mean_dwell_time_mean"] == "2.5"


def test_updates_replace_sessions(spark):
    old, new = sessions(spark, (1, 2, 3, 4, 5)), sessions(spark, (11,))
    base = bl.update_baselines(old, new).collect()[0]
    assert base["max"] == 11 and base.sample_count == 5
