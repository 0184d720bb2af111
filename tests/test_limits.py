"""Large groups, odd splits, map columns, stream state: results don't depend on where limits fall."""

import duckdb
import pytest
from pyspark.sql import functions as F

from keytempo.operators import assessments, groups, scaling, splits
from keytempo.plans.catalogue import ORACLES, QUERIES
from keytempo.streaming import keys, sinks
from tests.conftest import SF, rows


def twin(name):
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


@pytest.mark.parametrize("name", ["user_baselines", "pause_segments", "window_aggregates", "scaled_robust"])
def test_large_group_path_equals_sql(spark, monkeypatch, name):
    monkeypatch.setattr(groups, "GROUP_ROWS", 12)
    df = QUERIES[name](spark, SF)
    names, want = twin(name)
    assert sorted(names) == sorted(df.columns)

    def plain(values, columns):
        by = dict(zip(columns, values, strict=True))
        return tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in (by[c] for c in sorted(columns)))

    assert sorted(plain(tuple(r), df.columns) for r in df.collect()) == sorted(plain(r, names) for r in want)


def test_a_group_far_above_the_limit_is_cut_in_rounds(spark):
    """One key with 1,500 times the limit and few distinct times."""
    df = spark.range(3000).select(
        F.lit("k").alias("k"), (F.col("id") % 1300).cast("double").alias("t"), F.col("id").alias("i"))
    pieces = groups.cut(df, ["k"], ["t", "i"], 2)
    found = pieces.groupBy("_seg").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("t", "i")).alias("lo"), F.max(F.struct("t", "i")).alias("hi")).collect()
    assert max(r.n for r in found) <= 2 and sum(r.n for r in found) == 3000
    found.sort(key=lambda r: r["_seg"])
    assert all(a.hi < b.lo for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("kind", ["fraction", "long", "text"])
def test_sequential_split_of_any_id(spark, kind):
    ids = {"fraction": F.col("id") / 1000.0, "long": F.col("id") + (1 << 60), "text": F.format_string("r%05d", "id")}[kind]
    got = splits.sequential_split(spark.range(1000).select("id", ids.alias("key")).repartition(7), "key", 0.15, 0.15)
    assert rows(got.groupBy("split").agg(F.min("id").alias("a"), F.max("id").alias("b"))) == [
        (0, 699, "train"), (700, 849, "val"), (850, 999, "test")]


def test_rows_without_a_group_stay(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "user_id string, i int")
    got = {r.i: r.split for r in splits.grouped_split(df).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4] == "unassigned"
    assert splits.grouped_split3(df).count() == 4


def test_many_labels(spark):
    df = spark.range(12_000).select(F.format_string("c%05d", "id").alias("label"))
    got = scaling.label_mapping(df, "label").orderBy("label_id").collect()
    assert [r.label_id for r in got] == list(range(12_000)) and [r.label for r in got] == sorted(r.label for r in got)


def test_map_columns_merge_and_ties(spark):
    schema = "user_id string, last_updated int, features map<string,double>"
    base = spark.createDataFrame([("a", 1, {"x": 1.0}), ("b", 1, {"x": 2.0})], schema)
    new = spark.createDataFrame([("a", 3, {"x": 9.0}), ("a", 2, {"x": 8.0}), ("c", 1, None)], schema)
    got = {r.user_id: r.features for r in assessments.merge_by_key(base, new, ["user_id"], "last_updated").collect()}
    assert got == {"a": {"x": 9.0}, "b": {"x": 2.0}, "c": None}
    assert {r.user_id: r.features for r in assessments.latest_profile(new).collect()} == {"a": {"x": 9.0}, "c": None}


def test_keyed_table_rewrites_touched_buckets_only(spark, tmp_path):
    table = sinks.KeyedTable(spark, str(tmp_path / "t"), "k long, v long", buckets=8)
    schema = "k long, v long"
    table.merge(spark.range(100).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v")), 0, ["k"], "v")
    table.merge(spark.createDataFrame([(5, 7)], schema), 1, ["k"], "v")
    table.merge(spark.createDataFrame([(5, 99)], schema), 1, ["k"], "v")  # a repeated batch is skipped
    assert len(list((tmp_path / "t" / "version=0").glob("bucket=*"))) == 8
    assert len(list((tmp_path / "t" / "version=1").glob("bucket=*"))) == 1
    done, now = table.current()
    assert done == 1 and {r.k: r.v for r in now.collect()} == {**{i: 1 for i in range(100)}, 5: 7}
    assert table.vacuum() == 1 and table.current()[1].count() == 100


def test_idle_sessions_leave_no_state(spark, tmp_path):
    """A later session moves the watermark past the idle gap of the first; only the later one keeps state."""
    schema = ("user_id string, session_id string, event_type string, timestamp_ms double, key_token string, "
              "is_backspace boolean, is_enter boolean, is_space boolean, raw_id long")

    def part(name, values):
        spark.createDataFrame(values, schema).coalesce(1).write.json(str(tmp_path / "in" / name))

    def row(session, kind, at, i):
        return ("u", session, kind, float(at), "k_a", False, False, False, i)

    stream = keys.read_event_stream(spark, str(tmp_path / "in" / "*"), schema, "json", 1)
    pairs = keys.pair_stream(keys.with_event_time(stream, delay="1 second"), idle_ms=5_000.0)

    def run():
        q = keys.write_stream(pairs, str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
        sinks.run_to_end(q)
        return max((s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"][-1:]), default=0), [
            p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]

    part("1", [row("first", "down", 1000, 1), row("first", "up", 1100, 2), row("first", "down", 1200, 3)])
    run()
    part("2", [row("clock", "tick", 60_000, 4)])
    run()
    part("3", [row("clock", "tick", 120_000, 5)])
    _, totals = run()
    assert totals and totals[-1] == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_erasure_rewrites_and_vacuum_deletes(spark, tmp_path):
    table = sinks.KeyedTable(spark, str(tmp_path / "t"), "k long, who string", buckets=2)
    rows_in = spark.range(40).select(F.col("id").alias("k"), F.concat(F.lit("p"), (F.col("id") % 5).cast("string")).alias("who"))
    table.merge(rows_in, 0, ["k"], "k")
    people = spark.createDataFrame([("p1",), ("nobody",)], "who string")
    assert table.erase(1, ["who"], people) == 2 and table.erase(1, ["who"], people) == 0
    assert {r.who for r in table.current()[1].collect()} == {"p0", "p2", "p3", "p4"}
    assert table.vacuum() == 2
    assert spark.read.parquet(str(tmp_path / "t" / "version=*" / "bucket=*")).filter("who = 'p1'").count() == 0
    everyone = spark.createDataFrame([(f"p{i}",) for i in range(5)], "who string")
    assert table.erase(2, ["who"], everyone) == 2 and table.current()[1].count() == 0
