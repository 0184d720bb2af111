"""Live sessions: state that grows with what is new only, and results equal to the batch operators."""

import collections
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keytempo.operators import events, features, windows
from keytempo.streaming import keys, live

from .conftest import rows
from .test_streaming import feed, run, small, stream  # noqa: F401


class Map(dict):
    """A state map that counts what is written and read."""

    def __init__(self, log, name):
        super().__init__()
        self.log, self.label = log, name

    def _size(self, value):
        return sum(len(v) if isinstance(v, list) else 1 for v in value)

    def updateValue(self, key, value):  # noqa: N802
        self.log[self.label, "written"] += self._size(value)
        self[key] = value

    def getValue(self, key):  # noqa: N802
        self.log[self.label, "read"] += self._size(self[key])
        return self[key]

    def containsKey(self, key):  # noqa: N802
        return key in self

    def removeKey(self, key):  # noqa: N802
        self.pop(key, None)

    def iterator(self):
        return iter(list(self.items()))


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Items(list):
    def get(self):
        return iter(list(self))

    def put(self, values):
        self[:] = values


class Handle:
    """State of one key in memory, with timers."""

    def __init__(self):
        self.log, self.timers, self.states = collections.Counter(), set(), {}

    def getMapState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, Map(self.log, name))

    def getValueState(self, name, _):  # noqa: N802
        return self.states.setdefault(name, Value())

    def getListState(self, name, _):  # noqa: N802
        return self.states.setdefault(name, Items())

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class At:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


KEY = ("u", "s")


def typed(n, seed=1):
    """Raw rows of n presses."""
    rng, out, at = random.Random(seed), [], 0.0
    for i in range(n):
        at += rng.uniform(20, 900)
        hold = round(rng.uniform(0, 200), 1)
        out += [("down", at, f"k{i}", i % 9 == 0, False, i % 5 == 0, 2 * i), ("up", at + hold, f"k{i}", i % 9 == 0, False, i % 5 == 0, 2 * i + 1)]
    return sorted(out, key=lambda r: r[1])


def drive(make, batches, delay, handle=None):
    """Run a processor over batches; the watermark follows ``delay`` behind.  A new processor per batch: nothing may live
    outside of state."""
    handle, out, watermark = handle or Handle(), [], 0.0
    columns = ["event_type", "timestamp_ms", "key_token", "is_backspace", "is_enter", "is_space", "raw_id"]
    for batch in [*batches, []]:
        p = make()
        p.init(handle)
        if batch:
            out += list(p.handleInputRows(KEY, iter([pd.DataFrame(batch, columns=columns)]), At(watermark)))
            watermark = max(watermark, max(r[1] for r in batch) - delay)
        else:
            watermark = 1e12
        for t in sorted(handle.timers):
            if t <= watermark:
                info = At(t)
                out += list(p.handleExpiredTimer(KEY, At(watermark), info))
    out = [df for df in out if len(df)]
    return (pd.concat(out) if out else pd.DataFrame()), handle


@pytest.mark.parametrize("size", [1, 7, 100])
def test_a_waiting_row_is_written_and_read_once(size):
    data = typed(600)
    pairs, handle = drive(keys.PairKeys, [data[i:i + size] for i in range(0, len(data), size)], delay=30_000)
    assert len(pairs) == 600 and pairs.sequence_index.tolist() == list(range(600))
    assert handle.log["calendar", "written"] == handle.log["calendar", "read"] == len(data)
    assert not any(s.exists() if isinstance(s, Value) else len(s) for s in handle.states.values()) and not handle.timers


def test_value_counts():
    rng = random.Random(2)
    handle = Handle()
    counts, seen = live.ValueCounts(handle, "x"), []
    for _ in range(60):
        new = [rng.choice([0.0, 1.5, round(rng.expovariate(1 / 150), 1), rng.uniform(0, 4000)]) for _ in range(rng.randint(1, 40))]
        counts.add(new)
        seen += new
        n = len(seen)
        assert counts.median(n) == pytest.approx(statistics.median(seen), abs=1e-12)
        ranks = [0, n // 4, n - 1]
        assert counts.at(ranks) == [sorted(seen)[k] for k in ranks]
    before = handle.log["x_values", "written"]
    counts.add([1.5])
    assert handle.log["x_values", "written"] - before <= 2 * len(handle.states["x_values"][counts_bucket(1.5)][0])


def counts_bucket(value):
    return (int(np.float64(value).view(np.int64)) >> live.ValueCounts.SHIFT,)


def test_running_telemetry():
    data = typed(300, 3)
    final, _ = drive(live.LiveTelemetry, [data], delay=0)
    running, _ = drive(lambda: live.LiveTelemetry(live=True), [data[i:i + 20] for i in range(0, len(data), 20)], delay=2_000)
    assert len(final) == 1 and len(running) > 10 and running.event_count.is_monotonic_increasing
    for c in final.columns[2:]:
        assert running[c].iloc[-1] == pytest.approx(final[c].iloc[0], rel=1e-9), c
    pairs, _ = drive(keys.PairKeys, [data], delay=0)
    flights = [f for f in pairs.flight_time if f == f]
    assert final.std_flight_ms.iloc[0] == pytest.approx(statistics.pstdev(flights))
    assert final.median_flight_ms.iloc[0] == pytest.approx(statistics.median(flights))


@pytest.mark.parametrize(("length", "stride"), [(1, 1), (4, 9), (30, 10), (12, 12)])
def test_windows_do_not_depend_on_batches(length, stride):
    data = typed(100, 4)
    whole, _ = drive(lambda: live.LiveWindows(length, stride), [data], delay=0)
    cut, handle = drive(lambda: live.LiveWindows(length, stride), [data[i:i + 3] for i in range(0, len(data), 3)], delay=1_000)
    assert whole.to_dict("records") == cut.to_dict("records")
    assert whole.start_index.tolist() == list(range(0, 100 - length + 1, stride))
    assert not handle.states["recent"]


def test_ring_evicts_with_one_write():
    data = typed(200, 5)
    kept, handle = drive(lambda: live.KeepLast(7), [data[i:i + 4] for i in range(0, len(data), 4)], delay=0)
    assert kept.sequence_index.tolist() == list(range(193, 200))
    fields = len(keys.PAIR_SCHEMA.split(", ")) - 2
    assert handle.log["ring", "written"] <= 200 * fields and handle.log["ring", "read"] == 0


def both_halves(spark, small, tmp_path, name, make):  # noqa: F811
    """The stream stops after the first files and goes on from its checkpoint."""
    source, seen = f"{tmp_path}/all", f"{tmp_path}/in"
    feed(spark, small, source, files=4, shuffle_ms=300)
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    path = spark._jvm.org.apache.hadoop.fs.Path
    for part in (("000", "001"), ("002", "003", "999")):
        for p in part:
            fs.mkdirs(path(seen))
            fs.rename(path(f"{source}/part{p}"), path(f"{seen}/part{p}"))
        run(make(keys.with_event_time(stream(spark, seen), delay="2 seconds")), tmp_path, name)
    return spark.read.parquet(f"{tmp_path}/{name}")


def test_telemetry_equals_batch_after_a_restart(spark, small, tmp_path):  # noqa: F811
    got = both_halves(spark, small, tmp_path, "tel", live.telemetry_stream)
    want = features.telemetry(small)
    assert rows(got.select(*want.columns)) == rows(want)


def test_windows_equal_batch_after_a_restart(spark, small, tmp_path):  # noqa: F811
    got = both_halves(spark, small, tmp_path, "win", lambda df: live.window_stream(df, 6, 2))
    want = windows.live_windows(small, windows.Windows(length=6, stride=2)).select(
        "user_id", "session_id", "window_index", "values")
    values = F.transform("values", lambda v: F.transform(v, lambda x: F.round(x.cast("double"), 3)))
    assert rows(got.select("user_id", "session_id", F.col("window_index").cast("int"), values.alias("values"))) == rows(
        want.withColumn("window_index", F.col("window_index").cast("int")).withColumn("values", values).select(
            "user_id", "session_id", "window_index", "values"))


def test_newest_equal_batch_after_a_restart(spark, small, tmp_path):  # noqa: F811
    got = both_halves(spark, small, tmp_path, "new", lambda df: live.newest_stream(df, 5))
    want = events.event_features(small, newest=5)
    both = ["user_id", "session_id", "sequence_index", "dwell_time", "flight_time"]
    assert rows(got.select(*both)) == rows(want.select(*both))
