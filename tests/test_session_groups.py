"""Sessions of one group share calls and accesses to state; each gives what it gives with a key of its own."""

import collections
import random

import pandas as pd
import pytest

from keytempo.streaming import keys, live

from .test_live import At, Handle, drive, typed

COLUMNS = ["event_type", "timestamp_ms", "key_token", "is_backspace", "is_enter", "is_space", "raw_id"]


class Store(dict):
    """A state map of the group that counts round trips; a missing key reads as None."""

    def __init__(self, trips):
        super().__init__()
        self.trips = trips

    def getValue(self, key):  # noqa: N802
        self.trips["read"] += 1
        return self.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.trips["written"] += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.trips["removed"] += 1
        self.pop(key, None)


class GroupHandle(Handle):
    def __init__(self):
        super().__init__()
        self.trips = collections.Counter()

    def getMapState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, Store(self.trips))


def sessions_of(n, presses):
    """Raw rows by session: keys that stay down, a session without ids, and one that pauses."""
    out = {}
    for i in range(n):
        rows = typed(presses, seed=i)
        rows.append(("down", rows[-1][1] + 1.0, "k_held", False, False, False, 1 << 20))
        if i == 1:
            rows[len(rows) // 2] = ("pause", *rows[len(rows) // 2][1:])
        out[(None if i == 0 else f"u{i}", f"s{i}")] = rows
    return out


def drive_group(make, batches, delay):
    """Like ``drive``, for rows of (session, row); a new processor per batch: nothing may live outside of state."""
    handle, out, watermark = GroupHandle(), [], 0.0
    for batch in [*batches, []]:
        p = keys.SessionGroups(make())
        p.init(handle)
        if batch:
            pdf = pd.DataFrame([(*s, *r) for s, r in batch], columns=[*keys.KEYS, *COLUMNS])
            halves = iter([pdf[:len(pdf) // 2], pdf[len(pdf) // 2:]])
            out += list(p.handleInputRows((7,), halves, At(watermark)))
            watermark = max(watermark, max(r[1] for _, r in batch) - delay)
        else:
            watermark = 1e12
        for t in sorted(handle.timers):
            if t <= watermark:
                out += list(p.handleExpiredTimer((7,), At(watermark), At(t)))
    return pd.concat(out), handle


def by_session(frame):
    """The rows of each session, without its key."""
    def plain(x):
        return None if x is None or x != x else round(x, 6) if isinstance(x, float) else x

    return {k: [{n: plain(x) for n, x in r.items() if n not in keys.KEYS} for r in g.to_dict("records")]
            for k, g in frame.groupby(["user_id", "session_id"], dropna=False)}


MAKES = [keys.PairKeys, live.LiveTelemetry, lambda: live.LiveWindows(5, 2), lambda: live.KeepLast(7), lambda: keys.PairKeys(2_000.0),
         lambda: live.LiveTelemetry(2_000.0)]


@pytest.mark.parametrize("make", MAKES)
@pytest.mark.parametrize("size", [9, 10_000])
def test_sessions_of_a_group_do_not_mix(make, size, monkeypatch):
    monkeypatch.setattr(keys, "GROUP_ROWS_AT_ONCE", 50)
    found = sessions_of(5, 60)
    arrived = sorted(((s, r) for s, rows in found.items() for r in rows), key=lambda x: x[1][1])
    batches = [arrived[i:i + size] for i in range(0, len(arrived), size)]
    got, handle = drive_group(make, batches, delay=3_000)
    got = by_session(got)
    assert not any(len(s) if isinstance(s, Store) else s.exists() for s in handle.states.values()) and not handle.timers
    for s, rows in found.items():
        alone, watermark, mine = Alone(make), 0.0, []
        for batch in batches:
            mine += alone.batch([r for t, r in batch if t == s], watermark)
            watermark = max(watermark, max(r[1] for _, r in batch) - 3_000)
            mine += alone.fire(watermark)
        mine += alone.fire(1e12)
        key = next(k for k in got if k[1] == s[1])
        assert got[key] == by_session(pd.concat(mine))["u", "s"]


class Alone:
    """One session with a key of its own, fed like the group."""

    def __init__(self, make):
        self.make, self.handle = make, Handle()

    def _processor(self):
        p = self.make()
        p.init(self.handle)
        return p

    def batch(self, rows, watermark):
        if not rows:
            return []
        return list(self._processor().handleInputRows(("u", "s"), iter([pd.DataFrame(rows, columns=COLUMNS)]), At(watermark)))

    def fire(self, watermark):
        out = []
        while due := sorted(t for t in self.handle.timers if t <= watermark):
            out += list(self._processor().handleExpiredTimer(("u", "s"), At(watermark), At(due[0])))
        return out


@pytest.mark.parametrize("make", [keys.PairKeys, live.LiveTelemetry, lambda: live.LiveWindows(5, 2), live.KeepLast])
def test_round_trips_do_not_grow_with_short_sessions(make):
    trips = []
    for n in (5, 50):
        rows = [(*s, *r) for s, found in sessions_of(n, 12).items() for r in found]
        random.Random(3).shuffle(rows)
        handle = GroupHandle()
        p = keys.SessionGroups(make())
        p.init(handle)
        list(p.handleInputRows((7,), iter([pd.DataFrame(rows, columns=[*keys.KEYS, *COLUMNS])]), At(-1e9)))
        out = pd.concat(p.handleExpiredTimer((7,), At(1e12), At(1)))
        trips.append(sum(handle.trips.values()))
        assert out.session_id.nunique() == n and not handle.states["sessions"].exists()
    assert trips[0] == trips[1] <= 6  # an entry is written, read and removed


def test_state_goes_with_its_session():
    """A session that ends takes its entries along; one that goes on keeps them."""
    a, b = typed(40, 1), [(k, t + 500_000, *x) for k, t, *x in typed(40, 2)]
    rows = [(("a", "s"), r) for r in a] + [(("b", "s"), r) for r in b]
    handle = GroupHandle()
    p = keys.SessionGroups(live.KeepLast(5, 1_000.0))
    p.init(handle)
    pdf = pd.DataFrame([(*s, *r) for s, r in rows], columns=[*keys.KEYS, *COLUMNS])
    list(p.handleInputRows((7,), iter([pdf]), At(0.0)))
    assert list(p.handleExpiredTimer((7,), At(a[-1][1]), At(1))) == [] and {k[0] for k in handle.states["ring"]} == {"a"}
    out = list(p.handleExpiredTimer((7,), At(300_000.0), At(1)))
    assert pd.concat(out).sequence_index.tolist() == list(range(35, 40)) and not handle.states["ring"]
    out = list(p.handleExpiredTimer((7,), At(1e9), At(1)))
    assert pd.concat(out).user_id.tolist() == ["b"] * 5 and not handle.states["sessions"].exists()
    whole, _ = drive(lambda: live.KeepLast(5), [b], delay=0)
    assert pd.concat(out).release_time.tolist() == whole.release_time.tolist()


def odd_sessions(seed):
    """Raw rows of sessions with equal times, repeated presses and releases, keys without a name, flags without a value and pauses."""
    rng = random.Random(seed)
    out = {}
    for i in range(rng.randint(1, 12)):
        rows, t = [], rng.uniform(0, 5_000)
        for n in range(rng.randint(1, 60)):
            t += rng.choice([0.0, 10.0, 90.0, 700.0, 4_500.0])
            kind = rng.choices(["down", "up", "pause", "resume", "other"], [10, 10, 1, 1, 1])[0]
            flag = rng.choice([True, True, False])
            rows.append((kind, t, rng.choice(["a", "b", None]), flag, rng.choice([True, False, None]), False, n if rng.random() < 0.9 else 0))
        out[(rng.choice([None, f"u{i}"]), f"s{i}")] = rows
    return out


@pytest.mark.parametrize("make", MAKES)
@pytest.mark.parametrize("seed", range(8))
def test_whole_sessions_give_what_they_give_one_by_one(make, seed, monkeypatch):
    found = odd_sessions(seed)
    rows = [(s, r) for s, mine in found.items() for r in mine]
    random.Random(seed).shuffle(rows)
    alone = {}
    for s in found:
        one = Alone(make)
        # Rows with the same time and id stay in their order, as they arrive.
        out = one.batch([r for t, r in rows if t == s], 0.0) + one.fire(1e12)
        alone[s] = by_session(pd.concat(out))["u", "s"] if out else []
    if make().whole is not None:
        monkeypatch.setattr(make().__class__, "_pair", None)
        monkeypatch.setattr(make().__class__, "take", None)
    handle = GroupHandle()
    p = keys.SessionGroups(make())
    p.init(handle)
    pdf = pd.DataFrame([(*s, *r) for s, r in rows], columns=[*keys.KEYS, *COLUMNS])
    list(p.handleInputRows((7,), iter([pdf[:len(pdf) // 2], pdf[len(pdf) // 2:]]), At(0.0)))
    out = list(p.handleExpiredTimer((7,), At(1e12), At(1)))
    got = {k[1]: v for k, v in by_session(pd.concat(out)).items()} if out else {}
    for (_, s), mine in alone.items():
        for r in mine:  # a key of its own reads a missing flag as False
            r.update({n: bool(r[n]) for n in r if n in ("is_enter", "is_space")})
        for r in got.get(s, []):
            r.update({n: bool(r[n]) for n in r if n in ("is_enter", "is_space")})
        assert got.get(s, []) == mine
    assert not handle.states["sessions"].exists() and not handle.states["calendar"]


def test_a_session_that_goes_on_is_not_taken_whole():
    """A session that ends and one with later rows share a firing."""
    ended, going = typed(30, 1), typed(30, 2)
    watermark = max(r[1] for r in ended + going) + 1_500.0
    going[-1] = ("up", watermark - 500.0, *going[-1][2:])
    later = [(k, t + watermark, *x) for k, t, *x in typed(30, 3)]
    handle, out, alone, mine = GroupHandle(), [], Alone(lambda: live.LiveTelemetry(1_000.0, slot_ms=10.0)), []
    for batch, time in (([("a", ended), ("b", going)], watermark), ([("b", later)], 1e12)):
        p = keys.SessionGroups(live.LiveTelemetry(1_000.0, slot_ms=10.0))
        p.init(handle)
        pdf = pd.DataFrame([(s, s, *r) for s, rows in batch for r in rows], columns=[*keys.KEYS, *COLUMNS])
        list(p.handleInputRows((7,), iter([pdf]), At(0.0)))
        out.append(pd.concat(p.handleExpiredTimer((7,), At(time), At(1))))
        mine += alone.batch(batch[-1][1], 0.0) + alone.fire(time)
    assert out[0].user_id.tolist() == ["a"] and out[1].user_id.tolist() == ["b"]
    assert list(by_session(out[1]).values()) == list(by_session(pd.concat(mine)).values())
