"""A session is read and written once per step of the watermark, however many slots its rows lie in."""

import pandas as pd
import pytest

from keytempo.streaming import keys, live

from .test_live import KEY, At, Handle, drive, typed


class Counting(Handle):
    def __init__(self):
        super().__init__()
        self.set = 0

    def registerTimer(self, at):  # noqa: N802
        self.set += 1
        super().registerTimer(at)


@pytest.mark.parametrize("make", [keys.PairKeys, live.LiveTelemetry, live.LiveWindows, live.KeepLast])
def test_a_whole_session_sets_one_timer(make):
    _, handle = drive(make, [typed(60)], delay=0, handle=Counting())
    assert handle.set <= 2 and not handle.timers


def test_values_of_a_short_session_lie_in_one_row():
    handle = Handle()
    counts = live.ValueCounts(handle, "x")
    for v in range(100):
        counts.add([float(v), 0.5])
    assert not handle.log and counts.median(200) == 0.5 and counts.at([0, 199]) == [0.0, 99.0]
    counts.clear()
    assert not handle.states["x_last"].exists()


def test_entries_of_all_widths_keep_the_order():
    """Rows far ahead of the watermark are filed coarsely, later ones finely inside of the same span."""
    data = typed(120, 7)
    ahead, near = data[::2], data[1::2]
    whole, _ = drive(keys.PairKeys, [data], delay=0)
    handle, out = Handle(), []
    p = keys.PairKeys()
    p.init(handle)
    frame = pd.DataFrame
    columns = ["event_type", "timestamp_ms", "key_token", "is_backspace", "is_enter", "is_space", "raw_id"]
    list(p.handleInputRows(KEY, iter([frame(ahead, columns=columns)]), At(-1e9)))
    assert max(w for _, w in p._parts()) == keys.WIDEST
    list(p.handleInputRows(KEY, iter([frame(near, columns=columns)]), At(-100.0)))
    assert min(w for _, w in p._parts()) == 1
    for watermark in [*range(500, 200_000, 3_500), 1e12]:
        for t in sorted(handle.timers):
            if t <= watermark:
                out += [r for df in p.handleExpiredTimer(KEY, At(watermark), At(t)) for r in df.to_dict("records")]
    assert [r["release_time"] for r in out] == whole.release_time.tolist()
    assert [r["sequence_index"] for r in out] == list(range(120)) and not handle.timers
