"""What a live session shows while it runs and when it is over: telemetry, windows and its newest events.

All of it follows the pairs of one session inside the operator that makes them, so a stream is shuffled once by session.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from keytempo.operators import features
from keytempo.operators.baselines import NEAR_ZERO, session_index
from keytempo.operators.events import (
    BUFFER_EVENTS,
    CHARS_PER_WORD,
    FRAME_EVENTS,
    LIVE_PAUSE_MS,
    MAX_WPM,
    MIN_SPAN_MS,
)
from keytempo.streaming.keys import IDLE_MS, KEYS, PAIR_SCHEMA, SLOT_MS, PairKeys, by_session
from keytempo.streaming.states import SessionStates

TELEMETRY_SCHEMA = (
    "user_id string, session_id string, event_count long, mean_dwell_ms double, median_dwell_ms double, "
    "mean_flight_ms double, median_flight_ms double, std_flight_ms double, pause_count long, pause_rate double, "
    "estimated_wpm double, backspace_count long, correction_count long, error_rate double, duration_seconds double, "
    "std_dwell_ms double, mean_pause_ms double, valid_dwell_count long, valid_flight_count long"
)
WINDOW_SCHEMA = (
    "user_id string, session_id string, window_index long, start_index long, end_index long, start_time double, "
    "end_time double, values array<array<float>>"
)


class ValueCounts:
    """Exact order statistics of non-negative doubles in keyed state.

    Equal values are counted.  A bucket holds the values that share their exponent and six bits of their mantissa, so it
    spans 1.6 % of its value: one row keeps the rows per bucket, a map the sorted values and counts of each bucket.
    Adding rewrites the buckets of the new values only; a rank is found from the bucket sizes and one bucket.  The last
    values, and all of a short session, lie in one row, which goes to the buckets when it holds ``ROW`` values.
    """

    SHIFT = 46
    ROW = 256

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.sizes = handle.getValueState(f"{name}_sizes", "bucket array<bigint>, n array<bigint>")
        self.buckets = handle.getMapState(f"{name}_values", "bucket long", "v array<double>, n array<bigint>")
        self.last = handle.getValueState(f"{name}_last", "v array<double>, n array<bigint>, filed boolean")

    def _row(self) -> tuple[dict[float, int], bool]:
        """The values and counts outside of the buckets, and whether there are buckets."""
        kept = self.last.get()
        return (dict(zip(kept[0], kept[1], strict=True)), kept[2]) if kept is not None else ({}, False)

    def _keep(self, row: dict[float, int], filed: bool) -> None:
        order = sorted(row)
        self.last.update((order, [row[v] for v in order], filed))

    def add(self, values: Sequence[float]) -> None:
        row, filed = self._row()
        for v in values:
            v = float(v) + 0.0
            row[v] = row.get(v, 0) + 1
        if len(row) > self.ROW:
            self._file(row)
            row, filed = {}, True
        self._keep(row, filed)

    def _sizes(self) -> dict[int, int]:
        kept = self.sizes.get()
        return dict(zip(*kept, strict=True)) if kept is not None else {}

    def _file(self, row: dict[float, int]) -> None:
        found, counts = np.array(list(row), np.float64), np.array(list(row.values()), np.int64)
        bucket, sizes = found.view(np.int64) >> self.SHIFT, self._sizes()
        for b in np.unique(bucket).tolist():
            mine = bucket == b
            merged = dict(zip(found[mine].tolist(), counts[mine].tolist(), strict=True))
            if b in sizes:
                for v, n in zip(*self.buckets.getValue((b,)), strict=True):
                    merged[v] = merged.get(v, 0) + n
            order = sorted(merged)
            sizes[b] = sizes.get(b, 0) + int(counts[mine].sum())
            self.buckets.updateValue((b,), (order, [merged[v] for v in order]))
        self.sizes.update((list(sizes), list(sizes.values())))

    def at(self, ranks: Sequence[int]) -> list[float]:
        """The values at these ranks, counted from 0."""
        row, filed = self._row()
        if not filed:
            order = sorted(row)
            ends = np.cumsum([row[v] for v in order])
            return [order[np.searchsorted(ends, rank, "right")] for rank in ranks]
        if row:
            self._file(row)
            self._keep({}, True)
        sizes = sorted(self._sizes().items())
        out = []
        for rank in ranks:
            for b, n in sizes:
                if rank < n:
                    break
                rank -= n
            for v, n in zip(*self.buckets.getValue((b,)), strict=True):
                if rank < n:
                    break
                rank -= n
            out.append(v)
        return out

    def median(self, n: int) -> float:
        if not n:
            return 0.0
        low, high = self.at([(n - 1) // 2, n // 2])
        return low + (high - low) / 2

    def clear(self) -> None:
        if self._row()[1]:
            self.sizes.clear()
            self.buckets.clear()
        self.last.clear()


class LiveTelemetry(PairKeys):
    """Telemetry of a session: when it is over, and with ``live`` also after each step of the watermark.

    State besides that of pairing: value counts of dwells and flights for exact medians, and one row of counts, sums and
    moments.  It grows with the different values of a session, not with its rows.
    """

    FIELDS = ("events", "dwells", "dwell_mean", "dwell_m2", "flights", "flight_mean", "flight_m2", "pauses", "pause_sum",
              "backspaces", "corrections", "start", "end")

    def __init__(self, idle_ms: float = IDLE_MS, pause_ms: float = LIVE_PAUSE_MS, live: bool = False, slot_ms: float = SLOT_MS):
        super().__init__(idle_ms, slot_ms)
        self.pause_ms, self.live = pause_ms, live
        if live:
            self.whole = None  # each step of a session gives a row

    def open(self, handle: StatefulProcessorHandle | SessionStates) -> None:
        super().open(handle)
        self.dwells, self.flights = ValueCounts(handle, "dwell"), ValueCounts(handle, "flight")
        whole = ("events", "dwells", "flights", "pauses", "backspaces", "corrections")
        self.sums = handle.getValueState(
            "sums", ", ".join(f"{f} {'long' if f in whole else 'double'}" for f in self.FIELDS))

    def take(self, key, pairs: list[dict]) -> list[dict]:
        if not pairs:
            return []
        s = dict(zip(self.FIELDS, self.sums.get(), strict=True)) if self.sums.exists() else dict.fromkeys(self.FIELDS, 0) | {
            "start": pairs[0]["press_time"]}
        dwells = [p["dwell_time"] for p in pairs if p["dwell_time"] > 0]
        flights = [p["flight_time"] for p in pairs if p["flight_time"] is not None]
        for name, counts, values in (("dwell", self.dwells, dwells), ("flight", self.flights, flights)):
            if values:
                counts.add(values)
                self._merge_moments(s, name, values)
        pauses = [x for x in flights if x > self.pause_ms]
        s["events"] += len(pairs)
        s["pauses"] += len(pauses)
        s["pause_sum"] += math.fsum(pauses)
        s["backspaces"] += sum(p["is_backspace"] for p in pairs)
        s["corrections"] += sum(p["is_correction"] for p in pairs)
        s["end"] = pairs[-1]["release_time"]
        s |= {f: float(s[f]) for f in ("dwell_mean", "dwell_m2", "flight_mean", "flight_m2", "pause_sum")}
        self.sums.update(tuple(s[f] for f in self.FIELDS))
        return [self._row(key, s)] if self.live else []

    @staticmethod
    def _merge_moments(s: dict, name: str, values: list[float]) -> None:
        """Put values into the count, mean and sum of squares of a state row."""
        before, n, mean = s[f"{name}s"], len(values), math.fsum(values) / len(values)
        total, step = before + n, mean - s[f"{name}_mean"]
        s[f"{name}_m2"] += math.fsum((x - mean) ** 2 for x in values) + step * step * before * n / total
        s[f"{name}_mean"] += step * n / total
        s[f"{name}s"] = total

    def close_session(self, key) -> list[dict]:
        if not self.sums.exists():
            return []
        out = [] if self.live else [self._row(key, dict(zip(self.FIELDS, self.sums.get(), strict=True)))]
        for state in (self.sums, self.dwells, self.flights):
            state.clear()
        return out

    def _row(self, key, s: dict) -> dict:
        return dict(zip(KEYS, key, strict=True)) | self._telemetry(
            s, self.dwells.median(s["dwells"]), self.flights.median(s["flights"]))

    def whole(self, pairs: pd.DataFrame) -> pd.DataFrame:
        first = np.flatnonzero(pairs["sequence_index"] == 0)
        of = np.repeat(np.arange(len(first)), np.diff(first, append=len(pairs)))

        def total(values, rows=slice(None)) -> np.ndarray:
            return np.bincount(of[rows], values, len(first))

        def counted(rows) -> np.ndarray:
            return np.bincount(of[rows], minlength=len(first))

        s, medians = {"events": counted(slice(None))}, []
        for name in ("dwell", "flight"):
            values = pairs[f"{name}_time"].to_numpy()
            rows = np.flatnonzero(values > 0 if name == "dwell" else ~np.isnan(values))
            values, n = values[rows], counted(rows)
            mean = total(values, rows) / np.maximum(n, 1)
            s |= {f"{name}s": n, f"{name}_mean": mean, f"{name}_m2": total((values - mean[of[rows]]) ** 2, rows)}
            ordered = np.append(values[np.lexsort((values, of[rows]))], 0.0)
            start = np.cumsum(n) - n
            low, high = ordered[start + np.maximum(n - 1, 0) // 2], ordered[start + n // 2]
            medians.append(np.where(n > 0, low + (high - low) / 2, 0.0))
        flight = pairs["flight_time"].to_numpy()
        paused = np.flatnonzero(flight > self.pause_ms)
        s |= {"pauses": counted(paused), "pause_sum": total(flight[paused], paused),
              "start": pairs["press_time"].to_numpy()[first],
              "end": pairs["release_time"].to_numpy()[first + s["events"] - 1]}
        for name in ("backspace", "correction"):
            s[f"{name}s"] = counted(np.flatnonzero(pairs[f"is_{name}"].eq(True)))
        return pd.DataFrame({k: pairs[k].to_numpy()[first] for k in KEYS} | self._telemetry(s, *medians))

    @staticmethod
    def _telemetry(s: dict, dwell_median, flight_median) -> dict:
        """The columns after the keys, from numbers of one session or arrays of many."""
        seconds = np.maximum(0.1, (s["end"] - s["start"]) / 1000.0)
        dwells, flights = np.maximum(s["dwells"], 1), np.maximum(s["flights"], 1)
        return {
            "event_count": s["events"],
            "mean_dwell_ms": s["dwell_mean"], "median_dwell_ms": dwell_median,
            "mean_flight_ms": s["flight_mean"], "median_flight_ms": flight_median,
            "std_flight_ms": np.sqrt(s["flight_m2"] / flights),
            "pause_count": s["pauses"], "pause_rate": s["pauses"] / flights,
            "estimated_wpm": np.minimum(s["events"] / CHARS_PER_WORD / np.maximum(seconds / 60.0, 0.001), MAX_WPM),
            "backspace_count": s["backspaces"], "correction_count": s["corrections"],
            "error_rate": (s["backspaces"] + s["corrections"]) / s["events"], "duration_seconds": seconds,
            "std_dwell_ms": np.sqrt(s["dwell_m2"] / dwells),
            "mean_pause_ms": s["pause_sum"] / np.maximum(s["pauses"], 1),
            "valid_dwell_count": s["dwells"], "valid_flight_count": s["flights"],
        }


class LiveWindows(PairKeys):
    """Windows of ``length`` pairs every ``stride`` pairs, given out as soon as they are full.

    The vectors are dwell, flight, pause, speed, backspace and error, missing values 0.  State besides that of pairing: the
    vectors that later windows need and the presses that the speed looks back to, so batches and restarts leave no gap.
    """

    whole = None

    def __init__(self, length: int = 30, stride: int = 10, idle_ms: float = IDLE_MS, pause_ms: float = LIVE_PAUSE_MS,
                 slot_ms: float = SLOT_MS):
        super().__init__(idle_ms, slot_ms)
        if length < 1 or stride < 1:
            raise ValueError("length and stride must be positive")
        self.length, self.stride, self.pause_ms = length, stride, pause_ms

    def open(self, handle: StatefulProcessorHandle | SessionStates) -> None:
        super().open(handle)
        self.recent = handle.getListState("recent", "press double, release double, v array<double>")

    def take(self, key, pairs: list[dict]) -> list[dict]:
        if not pairs:
            return []
        rows = [tuple(r) for r in self.recent.get()]
        first = pairs[0]["sequence_index"] - len(rows)
        found = []
        for p in pairs:
            back = rows[-(FRAME_EVENTS - 1):]
            events = len(back) + 1
            since = back[0][0] if back else p["press_time"]
            minutes = max(max(MIN_SPAN_MS, p["release_time"] - since) / 60000.0, 0.001)
            speed = min(max(events / CHARS_PER_WORD / minutes, 0.0), MAX_WPM) if events > 1 else 0.0
            flight = p["flight_time"] or 0.0
            rows.append((p["press_time"], p["release_time"], [
                p["dwell_time"], flight, flight if flight > self.pause_ms else 0.0, speed,
                float(p["is_backspace"]), float(p["is_backspace"] or p["is_correction"])]))
            end = p["sequence_index"] + 1
            start = end - self.length
            if start >= 0 and start % self.stride == 0:
                window = rows[start - first:end - first]
                found.append({
                    "user_id": key[0], "session_id": key[1], "window_index": start // self.stride, "start_index": start,
                    "end_index": end, "start_time": window[0][0], "end_time": window[-1][1], "values": [w[2] for w in window]})
        self.recent.put(rows[-max(self.length - 1, FRAME_EVENTS - 1):])
        return found

    def close_session(self, key) -> list[dict]:
        self.recent.clear()
        return []


class KeepLast(PairKeys):
    """The newest ``n`` pairs of a session, given out when it is over.

    A ring of n places in a map: a pair takes the place of the one n before it, so an eviction is one write.
    """

    def __init__(self, n: int = BUFFER_EVENTS, idle_ms: float = IDLE_MS, slot_ms: float = SLOT_MS):
        super().__init__(idle_ms, slot_ms)
        if n < 1:
            raise ValueError("n must be positive")
        self.n = n

    def open(self, handle: StatefulProcessorHandle | SessionStates) -> None:
        super().open(handle)
        self.fields = [f.split()[0] for f in PAIR_SCHEMA.split(", ")][len(KEYS):]
        self.ring = handle.getMapState("ring", "place int", ", ".join(PAIR_SCHEMA.split(", ")[len(KEYS):]))

    def take(self, key, pairs: list[dict]) -> list[dict]:
        for p in pairs[-self.n:]:
            self.ring.updateValue((p["sequence_index"] % self.n,), tuple(p[f] for f in self.fields))
        return []

    def close_session(self, key) -> list[dict]:
        rows = sorted(tuple(v) for _, v in self.ring.iterator())
        self.ring.clear()
        return [dict(zip(KEYS, key, strict=True)) | dict(zip(self.fields, r, strict=True)) for r in rows]

    def whole(self, pairs: pd.DataFrame) -> pd.DataFrame:
        index = pairs["sequence_index"].to_numpy()
        count = np.diff(np.flatnonzero(index == 0), append=len(pairs))
        return pairs[index >= np.repeat(count, count) - self.n]


def telemetry_stream(events: DataFrame, idle_ms: float = IDLE_MS, pause_ms: float = LIVE_PAUSE_MS, live: bool = False) -> DataFrame:
    """One telemetry row per session once it has been idle for ``idle_ms``; the values are those of the batch operator.

    ``events`` has gone through ``with_event_time``.  With ``live`` (output mode update) a running session gives its
    telemetry so far whenever the watermark has moved past new pairs.
    """
    return by_session(events, LiveTelemetry(idle_ms, pause_ms, live), TELEMETRY_SCHEMA, "update" if live else "append")


def with_live_strain(telemetry: DataFrame) -> DataFrame:
    """Add the strain score and its category to telemetry rows; works on streams and tables."""
    timing = telemetry.withColumns({
        "keystroke_count": F.col("event_count"), "std_flight_time_ms": F.col("std_flight_ms"),
        "mean_hold_time_ms": F.col("mean_dwell_ms")})
    return features.strain_score(timing).drop("keystroke_count", "std_flight_time_ms", "mean_hold_time_ms")


def live_features(telemetry: DataFrame) -> DataFrame:
    """The nine features that baselines compare, from telemetry rows.  Flight features of a session without flights are NULL."""
    def cv(name: str, n: str) -> Column:
        count, mean = F.col(n), F.col(f"mean_{name}_ms")
        sample = F.col(f"std_{name}_ms") * F.sqrt(count / (count - 1))
        return F.when((count > 1) & (F.abs(mean) > NEAR_ZERO), sample / mean).otherwise(0.0)

    flown = F.col("valid_flight_count") > 0
    return telemetry.select(
        *KEYS, F.col("estimated_wpm").alias("mean_typing_speed_wpm"), F.col("mean_dwell_ms").alias("mean_dwell_time"),
        F.when(flown, F.col("mean_flight_ms")).alias("mean_flight_time"),
        (F.col("backspace_count") / F.col("event_count")).alias("backspace_rate"),
        F.when(flown, F.col("pause_rate")).alias("pause_rate"),
        F.when(flown, F.col("mean_pause_ms")).alias("mean_pause_duration"),
        F.when(flown, cv("flight", "valid_flight_count")).alias("cv_flight_time"),
        cv("dwell", "valid_dwell_count").alias("cv_dwell_time"), "error_rate")


def deviation_sink(baselines: Callable[[], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """Compare the telemetry of closed sessions with the baselines on all features; one folder per batch.

    ``baselines`` is called per batch; a batch that is run again overwrites its folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        session_index(live_features(batch), baselines()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def window_stream(events: DataFrame, length: int = 30, stride: int = 10, idle_ms: float = IDLE_MS) -> DataFrame:
    """Windows of running sessions; equal to the batch windows over the same pairs."""
    return by_session(events, LiveWindows(length, stride, idle_ms), WINDOW_SCHEMA)


def newest_stream(events: DataFrame, n: int = BUFFER_EVENTS, idle_ms: float = IDLE_MS) -> DataFrame:
    """The newest ``n`` pairs of each session that is over."""
    return by_session(events, KeepLast(n, idle_ms), PAIR_SCHEMA)
