"""Key event streams: sanitise, drop repeats, pair keys and sum up sessions.

The contract on order: rows are held back until the watermark has passed them and are then
handled in (time, raw_id) order, so the stream gives what the batch operators give.  Rows later
than the watermark delay are dropped by the engine and counted in its progress reports.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from keytempo.operators.adapt import with_payload_checks
from keytempo.operators.pairing import CORRECTION_GAP_MS, MAX_DWELL_MS
from keytempo.streaming.states import SessionStates

EVENT_TIME = "event_time"
KEYS = ("user_id", "session_id")
DELAY = "30 seconds"
#: A session without rows for this long is over: its state is removed, later rows start it anew at index 0.
IDLE_MS = 3_600_000.0
#: Event time of a calendar slot of waiting rows.
SLOT_MS = 1000.0
#: Slots of the widest calendar entry.
WIDEST = 16
#: Due rows that are paired in one step.
ROWS_AT_ONCE = 1024
#: Due rows of a group of sessions that are paired in one step.
GROUP_ROWS_AT_ONCE = 1 << 16
#: Groups that the sessions of a stream are dealt to by a hash; fixed for the life of a stream's state.
GROUPS = 512
#: Files that a batch takes at most, so that its rows stay bounded.
FILES_PER_BATCH = 16

PAIR_SCHEMA = (
    "user_id string, session_id string, sequence_index long, press_time double, "
    "release_time double, dwell_time double, flight_time double, key_token string, "
    "is_backspace boolean, is_enter boolean, is_space boolean, is_correction boolean"
)
_ROW = ("event_type:string,timestamp_ms:double,key_token:string,is_backspace:boolean,"
        "is_enter:boolean,is_space:boolean,raw_id:bigint")
_ROW_NAMES = [f.split(":")[0] for f in _ROW.split(",")]
_SESSION = "released double, next_index long, last_backspace double, paused boolean, seen double"
_KEY_SCHEMA = ", ".join(f"{k} string" for k in KEYS)
_ARROW = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "bigint": pa.int64()}
_FILED = pa.schema([(k, pa.string()) for k in KEYS] + [(n, _ARROW[t]) for n, t in (f.split(":") for f in _ROW.split(","))])
_ARROW["long"] = pa.int64()
#: Event types that the processors tell apart, and the flags of a row; ``_coded`` packs them into one number.
_KINDS = ("down", "up", "pause", "resume", "tick", "other")
_FLAGS = ("is_backspace", "is_enter", "is_space")
_SESSIONS = pa.schema([(n, _ARROW[t]) for n, t in (f.split() for f in f"{_KEY_SCHEMA}, waiting long, {_SESSION}".split(", "))])


def read_event_stream(
    spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json",
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """A stream of event files (JSON lines, CSV or Parquet) that appear in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Append a stream to Parquet with exactly-once file output."""
    writer = df.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def with_event_time(df: DataFrame, time_ms: str = "timestamp_ms", delay: str = DELAY) -> DataFrame:
    """Add the event time column and its watermark."""
    micros = F.round(F.col(time_ms) * 1000.0).cast("long")
    return df.withColumn(EVENT_TIME, F.timestamp_micros(micros)).withWatermark(EVENT_TIME, delay)


def sanitize_stream(raw: DataFrame, payload: str = "payload", keep: Sequence[str] = KEYS):
    """Clean events of a payload stream; the rules are those of the batch operator."""
    checked = with_payload_checks(raw, payload)
    return checked.filter(F.col("_reason").isNull()).select(*keep, "_event.*")


def dedup_stream(df: DataFrame) -> DataFrame:
    """Drop repeated event ids, then repeated (type, time, key), inside the watermark delay.

    Events without an id are compared by their signature in both steps.
    """
    signature = F.concat_ws("|", "event_type", F.col("timestamp_ms").cast("string"), "key_token")
    marked = df.withColumns({
        "_signature": signature,
        "_id": F.coalesce(F.concat(F.lit("i"), "event_id"), F.concat(F.lit("s"), signature)),
    })
    return (
        marked.dropDuplicatesWithinWatermark([*KEYS, "_id"])
        .dropDuplicatesWithinWatermark([*KEYS, "_signature"])
        .drop("_id", "_signature")
    )


class Presses:
    """The keys that are down, in a map of the state; only keys that are still down after the rows at hand are written."""

    def __init__(self, state, empty: bool):
        # Press times since the state was read, None for a key that has gone up.
        self.state, self.empty, self.changed = state, empty, {}

    def down(self, token: str, time: float) -> None:
        self.changed[token] = time

    def up(self, token: str) -> float | None:
        """The press time of a key, which is up from now on."""
        if token not in self.changed and not self.empty and self.state.containsKey((token,)):
            self.changed[token] = self.state.getValue((token,))[0]
        press = self.changed.get(token)
        if press is not None:
            self.changed[token] = None
        return press

    def clear(self) -> None:
        if not self.empty:
            self.state.clear()
        self.changed, self.empty = {}, True

    def save(self) -> None:
        for token, press in self.changed.items():
            if press is not None:
                self.state.updateValue((token,), (press,))
            elif not self.empty:
                self.state.removeKey((token,))


class Calendar(StatefulProcessor):
    """Rows that wait for the watermark, filed under their time slot.

    A batch files its rows, and all slots that the watermark has passed are taken out together, so every row is written
    once and read once however many batches its watermark delay spans.  Rows far ahead of the watermark, as when a stored
    stream is caught up, are filed in entries of several slots.
    """

    ROWS: str

    def __init__(self, idle_ms: float, slot_ms: float):
        self.idle_ms, self.slot_ms = idle_ms, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calendar = handle.getMapState("calendar", "slot long, width int, part int", self.ROWS)
        self.waiting = handle.getValueState(
            "waiting", "slots array<bigint>, widths array<int>, parts array<int>")

    def close(self) -> None:
        pass

    def _width(self, lead_ms):
        """Slots of an entry for rows that lie ``lead_ms`` ahead of the watermark: a power of two, one where they wait shortly."""
        return 2 ** np.log2(np.clip(lead_ms / (WIDEST * self.slot_ms), 1, WIDEST)).astype(int)

    def _end(self, entry: tuple[int, int]) -> float:
        return sum(entry) * self.slot_ms

    def _due(self, parts: dict, watermark: float) -> list[tuple[int, int]]:
        """The entries that the watermark has passed and that no row of a later entry may precede, in order."""
        limit = watermark
        while True:
            held = [e for e in parts if self._end(e) > limit]
            start = min((e[0] * self.slot_ms for e in held), default=limit)
            if start >= limit:
                return sorted(e for e in parts if self._end(e) <= limit)
            limit = start

    def _parts(self) -> dict[tuple[int, int], int]:
        kept = self.waiting.get()
        return {(s, w): n for s, w, n in zip(*kept, strict=True)} if kept is not None else {}

    def _keep(self, parts: dict[tuple[int, int], int]) -> None:
        self.waiting.update(([s for s, _ in parts], [w for _, w in parts], list(parts.values())))

    def _wake(self, time_ms: float) -> None:
        self.handle.registerTimer(int(time_ms) + 1)


class PairKeys(Calendar):
    """Pairs the keys of one session.

    State: rows the watermark has not passed, the press time of every key that is down, and the
    last release, next index, last backspace press, pause flag and last time of the session.
    A session has a timer at the end of its first calendar entry only; a firing sets the next one.
    Every access to state is a round trip, so a firing reads and writes the session once, and a
    session that begins and ends in it is never written.  Once the session has been idle for
    ``idle_ms`` all state is removed.

    Subclasses declare further state (``open``), take the pairs of a session in order (``take``) and
    may add rows when it is over (``close_session``).  ``SessionGroups`` calls these for many sessions.
    Sessions that begin and end in one step of it need no state and go to ``whole`` together, which gives what ``take``
    and ``close_session`` would; where it is None they go one by one.
    """

    ROWS = f"rows array<struct<{_ROW}>>"

    def __init__(self, idle_ms: float = IDLE_MS, slot_ms: float = SLOT_MS):
        super().__init__(idle_ms, slot_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.session = handle.getValueState("session", _SESSION)
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle | SessionStates) -> None:
        """The state of a session besides its waiting rows and the row that ``_pair`` returns."""
        self.pending = handle.getMapState("pending", "key_token string", "press double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = []
        for pdf in rows:
            # Clock rows only move the watermark.
            for kind, time, token, *flags, raw_id in zip(*[pdf[n].tolist() for n in _ROW_NAMES], strict=True):
                if kind != "tick":
                    arrived.append((kind, float(time), token, *map(_flag, flags), int(raw_id)))
        if arrived:
            parts = self._parts()
            ends = [self._end(e) for e in parts]
            slots: dict[tuple[int, int], list[tuple]] = {}
            width = int(self._width(min(r[1] for r in arrived) - timerValues.getCurrentWatermarkInMs()))
            for row in arrived:
                slot = int(row[1] // self.slot_ms)
                slots.setdefault((slot - slot % width, width), []).append(row)
            first = min(map(self._end, slots))
            if not ends or first < min(ends):
                self._wake(first)
            for entry, filed in slots.items():
                part = parts.get(entry, 0)
                self.calendar.updateValue((*entry, part), (filed,))
                parts[entry] = part + 1
            self._keep(parts)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        parts, session = self._parts(), self.session.get()
        stored = session is not None
        presses = Presses(self.pending, empty=not stored)
        due = self._due(parts, watermark)
        rows, end = [], None
        for entry in due:
            # Entries of different widths may overlap; rows are paired up to where none does.
            if len(rows) >= ROWS_AT_ONCE and entry[0] >= end:
                pairs, session = self._pair(key, rows, session, presses)
                yield from _frame(self.take(key, pairs))
                rows = []
            for part in range(parts.pop(entry)):
                rows += self.calendar.getValue((*entry, part))[0]
                self.calendar.removeKey((*entry, part))
            end = max(end or 0, sum(entry))
        if rows:
            pairs, session = self._pair(key, rows, session, presses)
            yield from _frame(self.take(key, pairs))
        if not parts and session is not None and session[4] + self.idle_ms < watermark:
            yield from _frame(self.close_session(key))
            presses.clear()
            self.waiting.clear()
            if stored:
                self.session.clear()
            return
        if due:
            presses.save()
            self.session.update(session)
            self._keep(parts)
        if parts:
            self._wake(min(e for e in map(self._end, parts) if e > watermark))
        elif due:
            self._wake(session[4] + self.idle_ms)

    def take(self, key, pairs: list[dict]) -> list[dict]:
        """The rows that come out with the next pairs of a session, which come in order."""
        return pairs

    def close_session(self, key) -> list[dict]:
        """The last rows of a session that is over; its state goes when this returns."""
        return []

    def whole(self, pairs: pd.DataFrame) -> pd.DataFrame:
        """The rows of sessions that are over, from all their pairs, session by session in order."""
        return pairs

    def _pair(self, key, rows, session, presses: Presses) -> tuple[list[dict], tuple]:
        """The pairs that rows complete, and the session after them."""
        released, index, backspace, paused, _ = session or (None, 0, None, False, None)
        rows = sorted(rows, key=lambda r: (r[1], r[6]))
        found = []
        for kind, time, token, is_backspace, is_enter, is_space, _ in rows:
            if kind == "pause":
                presses.clear()
                released, backspace, paused = None, None, True
            elif kind == "resume":
                paused = False  # the pause has already reset everything
            elif paused:
                continue
            elif kind == "down":
                presses.down(token, time)
            elif kind == "up":
                press = presses.up(token)
                if press is None or not 0.0 <= time - press <= MAX_DWELL_MS:
                    continue
                burst = False
                if is_backspace:
                    burst = backspace is not None and press - backspace < CORRECTION_GAP_MS
                    backspace = press
                found.append({
                    "user_id": key[0], "session_id": key[1], "sequence_index": index,
                    "press_time": press, "release_time": time, "dwell_time": time - press,
                    "flight_time": None if released is None else max(0.0, press - released),
                    "key_token": token, "is_backspace": is_backspace, "is_enter": is_enter,
                    "is_space": is_space, "is_correction": burst,
                })
                released, index = time, index + 1
        return found, (released, index, backspace, paused, rows[-1][1])


class SessionGroups(Calendar):
    """Runs the processor of one session for all sessions of a group, as if each had a key of its own.

    A call of the engine and an access to state cost far more than the rows of a short session, so the calendar, its timer
    and the rows of the running sessions belong to the group: a batch writes a few entries per group, a firing reads them
    and passes on the due rows session by session.  Further state of a session goes through ``SessionStates``.
    """

    ROWS = "rows binary"

    def __init__(self, each: PairKeys):
        super().__init__(each.idle_ms, each.slot_ms)
        self.each = each

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # The number of waiting rows and the row of every session; the row is null until its first rows are due.
        self.sessions = handle.getValueState("sessions", "found binary")
        self.states = SessionStates(handle, _KEY_SCHEMA)
        self.each.open(self.states)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, parts = timerValues.getCurrentWatermarkInMs(), None
        for pdf in rows:
            table = _filed(pdf)
            if not len(table):
                continue
            if parts is None:
                parts, sessions = self._parts(), self._sessions()
                ends = [self._end(e) for e in parts]
            time = table["timestamp_ms"].to_pandas()
            slot, width = (time // self.slot_ms).astype("int64").to_numpy(), self._width(time - watermark).to_numpy()
            slot = slot - slot % width
            order = np.lexsort((width, slot))
            table, slot, width = table.take(order), slot[order], width[order]
            cuts = np.flatnonzero(_starts(slot, width)).tolist()
            for start, end in zip(cuts, [*cuts[1:], len(slot)], strict=True):
                entry = (int(slot[start]), int(width[start]))
                part = parts.get(entry, 0)
                self.calendar.updateValue((*entry, part), (_packed(table.slice(start, end - start)),))
                parts[entry] = part + 1
            for *session, n in _unpacked(table.group_by(list(KEYS)).aggregate([([], "count_all")]).select([*KEYS, "count_all"])):
                sessions.setdefault(tuple(session), [0, None])[0] += n
        if parts is not None:
            first = min(map(self._end, parts))
            if not ends or first < min(ends):
                self._wake(first)
            self._keep(parts)
            self._keep_sessions(sessions)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        parts, sessions = self._parts(), self._sessions()
        self.states.held = {s for s, (_, session) in sessions.items() if session is not None}
        due = self._due(parts, watermark)
        running: dict[tuple, Presses] = {}
        rows, end = [], None
        for entry in due:
            if sum(map(len, rows)) >= GROUP_ROWS_AT_ONCE and entry[0] >= end:
                yield from self._step(pa.concat_tables(rows), sessions, running, watermark)
                rows = []
            for part in range(parts.pop(entry)):
                rows.append(pa.ipc.open_stream(self.calendar.getValue((*entry, part))[0]).read_all())
                self.calendar.removeKey((*entry, part))
            end = max(end or 0, sum(entry))
        if rows:
            yield from self._step(pa.concat_tables(rows), sessions, running, watermark)
        over = [s for s, (waiting, session) in sessions.items() if not waiting and session[4] + self.idle_ms < watermark]
        yield from _frame([row for s in over for row in self._close(s, sessions, running)])
        for s, presses in running.items():
            self.states.turn(s)
            presses.save()
        if due or over:
            self.states.save()
            if sessions:
                self._keep(parts)
                self._keep_sessions(sessions)
            else:
                self.waiting.clear()
                self.sessions.clear()
        wakes = [e for e in map(self._end, parts) if e > watermark] + [
            session[4] + self.idle_ms for waiting, session in sessions.values() if not waiting]
        if wakes:
            self._wake(min(wakes))

    def _step(self, rows: pa.Table, sessions: dict, running: dict, watermark: float) -> Iterator[pd.DataFrame]:
        """What comes out with the pairs that rows complete, and the last rows of sessions that begin and end in them."""
        if self.each.whole is not None:
            code, first = _codes(rows, KEYS)
            last, waiting = np.full(len(first), -np.inf), np.bincount(code)
            np.maximum.at(last, code, rows["timestamp_ms"].to_numpy())
            over = np.zeros(len(first), bool)
            for k, s in enumerate(_unpacked(rows.select(KEYS).take(first))):
                over[k] = sessions[s] == [waiting[k], None] and last[k] + self.idle_ms < watermark
                if over[k]:
                    del sessions[s]
            if over.any():
                mine = over[code]
                pairs = _pairs(rows.filter(mine), code[mine])
                if len(pairs):
                    yield self.each.whole(pairs)
                rows = rows.filter(~mine)
        yield from _frame(self._one_by_one(_unpacked(rows), sessions, running))

    def _one_by_one(self, rows: list[tuple], sessions: dict, running: dict) -> list[dict]:
        mine: dict[tuple, list[tuple]] = {}
        for row in rows:
            mine.setdefault(row[:len(KEYS)], []).append(row[len(KEYS):])
        out = []
        for s, due in mine.items():
            self.states.turn(s)
            waiting, session = sessions[s]
            if s not in running:
                running[s] = self._presses(s)
            pairs, session = self.each._pair(s, due, session, running[s])
            out += self.each.take(s, pairs)
            sessions[s] = [waiting - len(due), session]
        return out

    def _presses(self, session: tuple) -> Presses:
        return Presses(self.each.pending, empty=session not in self.states.held)

    def _close(self, session: tuple, sessions: dict, running: dict) -> list[dict]:
        self.states.turn(session)
        out = self.each.close_session(session)
        (running.pop(session, None) or self._presses(session)).clear()
        del sessions[session]
        return out

    def _sessions(self) -> dict[tuple, list]:
        kept = self.sessions.get()
        n = len(KEYS)
        found = _unpacked(pa.ipc.open_stream(kept[0]).read_all()) if kept is not None else []
        return {r[:n]: [r[n], r[n + 1:] if r[-1] is not None else None] for r in found}

    def _keep_sessions(self, sessions: dict[tuple, list]) -> None:
        none = (None,) * len(_SESSION.split(", "))
        columns = zip(*[(*s, waiting, *(session or none)) for s, (waiting, session) in sessions.items()], strict=True)
        self.sessions.update((_packed(pa.table([pa.array(c, f.type) for c, f in zip(columns, _SESSIONS, strict=True)], _SESSIONS)),))


def _coded(events: DataFrame) -> Column:
    """Type and flags of an event as one number: the engine hands rows over one by one, and every column costs time there."""
    kind = F.lit(len(_KINDS) - 1)
    for k, name in enumerate(_KINDS[:-1]):
        kind = F.when(F.col("event_type") == name, k).otherwise(kind)
    for n in _FLAGS:
        kind = kind * 3 + F.when(F.col(n).isNull(), 0).when(F.col(n), 2).otherwise(1)
    return kind


def _filed(pdf: pd.DataFrame) -> pa.Table:
    """Arrived rows without clock rows, as they are filed; type and flags may be in one column ``code``."""
    if "code" in pdf:
        code, columns = pdf["code"].to_numpy(), {}
        for n in reversed(_FLAGS):
            code, flag = np.divmod(code, 3)
            columns[n] = pa.array(flag == 2, mask=flag == 0)
        columns["event_type"] = pa.DictionaryArray.from_arrays(code.astype("int32"), list(_KINDS)).cast(pa.string())
    else:
        columns = {n: pa.array(pdf[n], _FILED.field(n).type, from_pandas=True) for n in ("event_type", *_FLAGS)}
    columns["raw_id"] = pa.array(pdf["raw_id"].astype("int64"))
    table = pa.table([columns[f.name] if f.name in columns else pa.array(pdf[f.name], f.type, from_pandas=True) for f in _FILED], _FILED)
    ticks = _true(pc.equal(table["event_type"], "tick"))
    return table.filter(~ticks) if ticks.any() else table


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(table: pa.Table) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


def _codes(table: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 for the values of some columns in each row, null being a value, and the first row of each number."""
    code = np.zeros(len(table), np.int64)
    for n in names:
        values = table[n].combine_chunks().dictionary_encode("encode")
        code = code * len(values.dictionary) + values.indices.to_numpy()
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _pairs(rows: pa.Table, session: np.ndarray) -> pd.DataFrame:
    """``PairKeys._pair`` for all rows of many sessions, which are given as numbers; the pairs come session by session in order."""
    time, raw_id = rows["timestamp_ms"].to_numpy(), rows["raw_id"].to_numpy()
    order = np.lexsort((raw_id, time, session))
    time, session, token = time[order], session[order], _codes(rows, ["key_token"])[0][order]
    down, up, pause, resume = (_true(pc.equal(rows["event_type"], k))[order] for k in ("down", "up", "pause", "resume"))
    at = np.arange(len(time))
    # A pause begins a new part of its session, whose rows count from the next resume on.
    part = np.cumsum(_starts(session) | pause)
    turn = np.maximum.accumulate(np.where(pause | resume | _starts(session), at, 0))
    held = np.flatnonzero((down | up) & ~pause[turn])
    held = held[np.lexsort((token[held], part[held]))]
    # A release closes the row of its key before it if that is a press.
    before, here = held[:-1], held[1:]
    linked = ~_starts(part[held], token[held])[1:] & down[before] & up[here]
    press = np.full(len(time), np.nan)
    press[here[linked]] = time[before[linked]]
    dwell = time - press
    found = np.flatnonzero((dwell >= 0.0) & (dwell <= MAX_DWELL_MS))
    time, press, dwell, session, part = time[found], press[found], dwell[found], session[found], part[found]
    at, new = np.arange(len(found)), _starts(part)
    flight = np.full(len(found), np.nan)
    flight[1:] = np.where(new[1:], np.nan, np.maximum(0.0, press[1:] - time[:-1]))
    mine = rows.take(order[found])
    burst = np.zeros(len(found), bool)
    back = np.flatnonzero(_true(mine["is_backspace"]))
    burst[back[1:]] = ~_starts(part[back])[1:] & (np.diff(press[back]) < CORRECTION_GAP_MS)
    return pd.DataFrame({
        **{k: mine[k].to_pandas() for k in KEYS},
        "sequence_index": at - np.maximum.accumulate(np.where(_starts(session), at, 0)),
        "press_time": press, "release_time": time, "dwell_time": dwell, "flight_time": flight,
        **{k: mine[k].to_pandas() for k in ("key_token", "is_backspace", "is_enter", "is_space")}, "is_correction": burst,
    })


def _true(flags: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(flags, False).to_numpy()


def _frame(rows: list[dict]) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame(rows)


def _flag(value) -> bool:
    return bool(value) if value is not None and value == value else False


def real_rows(events: DataFrame) -> DataFrame:
    """Without clock rows.  Naming the event time keeps the filter above the watermark."""
    return events.filter(~F.col("event_type").eqNullSafe("tick") | F.col(EVENT_TIME).isNull())


def by_session(events: DataFrame, each: PairKeys, schema: str, mode: str = "append", groups: int = GROUPS) -> DataFrame:
    """Run a processor of one session over a stream; sessions are dealt to groups by a hash."""
    rows = [n for n in _ROW_NAMES if n not in ("event_type", *_FLAGS)]
    return real_rows(events).select(*KEYS, *rows, _coded(events).alias("code"), EVENT_TIME).withColumn(
        "_group", F.pmod(F.xxhash64(*KEYS), F.lit(groups)).cast("int"),
    ).groupBy("_group").transformWithStateInPandas(
        statefulProcessor=SessionGroups(each), outputStructType=schema, outputMode=mode, timeMode="EventTime")


def pair_stream(events: DataFrame, idle_ms: float = IDLE_MS) -> DataFrame:
    """Accepted pairs of a stream that has gone through ``with_event_time``.

    Rows need the raw event columns and ``raw_id``; ``pause`` and ``resume`` rows control the
    session, ``tick`` rows only move time on.
    """
    return by_session(events, PairKeys(idle_ms), PAIR_SCHEMA)


def session_windows(
    pairs: DataFrame, gap: str = "30 seconds", pause_ms: float = 500.0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Live telemetry per session window; a window closes after ``gap`` without events.

    ``pairs`` has an event time with watermark; the start is the press of the first release.  Sums and counts are combined before the shuffle.
    """
    flight = F.col("flight_time")
    return pairs.groupBy(*keys, F.session_window(EVENT_TIME, gap).alias("_w")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.avg(F.when(F.col("dwell_time") > 0, F.col("dwell_time"))).alias("mean_dwell_ms"),
        F.avg(flight).alias("mean_flight_ms"),
        F.count_if(flight > pause_ms).alias("pause_count"),
        F.count_if(F.col("is_backspace")).alias("backspace_count"),
        F.count_if(F.col("is_correction")).alias("correction_count"),
        F.min_by("press_time", F.struct("release_time", "sequence_index")).alias("start_time"),
        F.max("release_time").alias("end_time"),
        F.count_if(F.col("dwell_time") > 0).alias("valid_dwell_count"),
        F.count_if(flight >= 0).alias("valid_flight_count"),
    ).drop("_w")


def event_rates(events: DataFrame, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Events per tumbling or sliding window of event time and event type."""
    window = F.window(EVENT_TIME, width, slide) if slide else F.window(EVENT_TIME, width)
    return events.groupBy(window.alias("_w"), "event_type").agg(
        F.count(F.lit(1)).alias("events")).select(
            F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
            "event_type", "events")
