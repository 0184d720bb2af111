"""The growing keyed table."""

import random

import pytest
from pyspark.sql import functions as F

from keytempo.streaming.keyed import KeyedTable, address, address_of

SCHEMA = "k long, v long"


@pytest.mark.parametrize(("before", "after"), [(1, 2), (3, 4), (4, 5), (5, 6), (1, 7), (6, 40), (64, 65)])
def test_growing_moves_rows_out_of_split_buckets_only(spark, before, after):
    h = F.xxhash64("id")
    got = spark.range(3000).select(address(h, before).alias("old"), address(h, after).alias("new")).distinct().collect()
    assert {r.new for r in got} == set(range(after)) or after > 20
    split = {address_of(b, before) for b in range(before, after)}
    for r in got:
        assert r.old == address_of(r.new, before)
        assert r.new == r.old or (r.old in split and r.new >= before)


def merge(spark, table, rows, batch):
    table.merge(spark.createDataFrame(rows, SCHEMA), batch, ["k"], "v")


def test_many_batches(spark, tmp_path):
    table, rng, want = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, rows_per_bucket=40), random.Random(1), {}
    for batch in range(12):
        rows = [(rng.randrange(80 * (batch + 1)), batch * 1000 + i) for i in range(60)]
        merge(spark, table, rows, batch)
        for k, v in rows:
            want[k] = max(v, want.get(k, -1))
        d = table.directory()
        assert d.batch == batch and d.rows == len(want)
        assert len(list((tmp_path / "t" / "directory").glob("batch=*"))) <= 2  # publishing reads as much as ever
    assert {r.k: r.v for r in table.current()[1].collect()} == want
    assert d.buckets >= len(want) // 40 and max(n for _, n in d.held.values()) <= 4 * 40
    table.vacuum()
    assert sum(1 for _ in (tmp_path / "t").glob("version=*/bucket=*")) == len(d.held)
    assert {r.k: r.v for r in table.current()[1].collect()} == want


def test_a_point_read_opens_one_bucket(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, rows_per_bucket=10)
    merge(spark, table, [(i, i) for i in range(100)], 0)
    found = table.lookup(spark.createDataFrame([(42,)], "k long"))
    assert [tuple(r) for r in found.collect()] == [(42, 42)]
    assert len({f.split("/")[-2] for f in found.inputFiles()}) == 1
    assert table.lookup(spark.createDataFrame([(7777,)], "k long")).count() == 0
    assert KeyedTable(spark, str(tmp_path / "none"), SCHEMA).lookup(spark.createDataFrame([(1,)], "k long")).count() == 0


def test_erasing_keys_touches_their_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, rows_per_bucket=10)
    merge(spark, table, [(i, i) for i in range(100)], 0)
    assert table.erase(1, ["k"], spark.createDataFrame([(5,), (999,)], "k long")) in (1, 2)
    assert table.current()[1].count() == 99
    rewritten = [b for b, (v, _) in table.directory().held.items() if v == 1]
    assert len(rewritten) <= 2


def test_half_published_batches_are_run_again(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA)
    merge(spark, table, [(1, 1)], 0)
    merge(spark, table, [(2, 2)], 1)
    (tmp_path / "t" / "directory" / "batch=1" / "_SUCCESS").unlink()  # the writer was lost before the end
    assert table.directory().batch == 0 and table.current()[1].count() == 1
    merge(spark, table, [(2, 2)], 1)
    assert table.directory().batch == 1 and table.current()[1].count() == 2


def test_other_keys_are_refused(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA)
    merge(spark, table, [(1, 1)], 0)
    with pytest.raises(ValueError, match="keyed by"):
        table.merge(spark.createDataFrame([(1, 1)], SCHEMA), 1, ["v"], "k")


def test_empty_batches_and_tables(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA)
    merge(spark, table, [], 0)
    assert table.directory().batch == 0 and table.current()[1].count() == 0
    merge(spark, table, [(None, 1), (None, 2), (3, None)], 1)
    assert table.erase(2, ["k"], spark.createDataFrame([(3,)], "k long")) == 1
    left = table.current()[1].collect()
    assert left and {r.k for r in left} == {None}
