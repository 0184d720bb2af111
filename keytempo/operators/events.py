"""Per-event timing columns: dwell, flight, pauses, rolling speed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytempo import names
from keytempo.functions import columns as c
from keytempo.operators.groups import over_groups
from keytempo.operators.pairing import KEYS, MAX_DWELL_MS, ORDER, key_rows, live_pairs

LIVE_PAUSE_MS = 500.0
FRAME_EVENTS = 11
MIN_SPAN_MS = 100.0
MAX_WPM = 250.0
CHARS_PER_WORD = 5.0
BUFFER_EVENTS = 1000

EVENT_COLUMNS = (
    *KEYS, "sequence_index", "press_time", "release_time", "dwell_time", "flight_time",
    "pause_duration", "typing_speed", "backspace", "error_flag",
)


def dwell(df: DataFrame) -> Column | None:
    """Hold time: a given column, else release - press, else nothing."""
    given = c.first_present(df.columns, names.DWELL_COLUMNS)
    if given:
        return c.number(given)
    if {"press_time", "release_time"} <= set(df.columns):
        return c.number("release_time") - c.number("press_time")
    return None


def given_flight(df: DataFrame) -> Column | None:
    given = c.first_present(df.columns, names.FLIGHT_COLUMNS)
    return c.number(given) if given else None


def with_flight(g, rows: DataFrame, name: str = "flight_time") -> DataFrame:
    """Body: press minus the previous release in the session, at least 0, NULL on the first."""
    rows = g.derive(rows, shift={"_released": ("release_time", 1)})
    flight = c.number("press_time") - c.number("_released")
    return rows.withColumn(name, c.non_negative(flight)).drop("_released")


def flight_times(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("press_time", "event_id"),
    limit: int | None = None,
) -> DataFrame:
    """Add ``flight_time``; a given flight or inter-key column is used as it is."""
    given = given_flight(df)
    if given is not None:
        return df.withColumn("flight_time", given)
    return over_groups(df, keys, order, lambda g: with_flight(g, g.rows).drop("_seg"), limit)


def speed_column(back: int = FRAME_EVENTS - 1) -> Column:
    """Words per minute over the current and ``back`` earlier pairs."""
    events = F.least(F.col("sequence_index") + 1, F.lit(back + 1))
    span = F.greatest(F.lit(MIN_SPAN_MS), F.col("release_time") - F.col("_since"))
    minutes = F.greatest(span / 60000.0, F.lit(0.001))
    wpm = c.clip(events / CHARS_PER_WORD / minutes, 0.0, MAX_WPM)
    return F.when(events > 1, wpm).otherwise(F.lit(0.0))


def feature_columns(pairs: DataFrame, pause_ms: float = LIVE_PAUSE_MS) -> DataFrame:
    """The event feature frame from accepted pairs."""
    flight = F.col("flight_time")
    return pairs.withColumns({
        "typing_speed": speed_column(),
        "pause_duration": F.when(flight > pause_ms, flight).otherwise(F.lit(0.0)),
        "backspace": F.col("is_backspace").cast("double"),
        "error_flag": (F.col("is_backspace") | F.col("is_correction")).cast("double"),
    })


def event_features(
    raw: DataFrame,
    pause_ms: float = LIVE_PAUSE_MS,
    max_dwell_ms: float = MAX_DWELL_MS,
    newest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Raw key events to the 11-column feature frame, one row per accepted pair.

    ``newest`` keeps only the last events of each session, after all features are computed.
    """

    def body(g):
        rows = feature_columns(live_pairs(g, g.rows, max_dwell_ms), pause_ms)
        if newest is not None:
            rows = newest_rows(g, rows, newest)
        return rows.select(*EVENT_COLUMNS)

    return over_groups(key_rows(raw), KEYS, ORDER, body, limit, colocate=True)


def rolling_wpm(raw: DataFrame, back: int = FRAME_EVENTS - 1, limit: int | None = None):
    """Rolling speed per accepted pair."""

    def body(g):
        rows = live_pairs(g, g.rows, speed_back=back)
        return rows.select(*KEYS, "sequence_index", speed_column(back).alias("typing_speed"))

    return over_groups(key_rows(raw), KEYS, ORDER, body, limit, colocate=True)


def newest_rows(g, rows: DataFrame, n: int) -> DataFrame:
    """Body: the last ``n`` rows of each group."""
    rows = g.derive(rows, number="_at", rows="_rows")
    return rows.filter(F.col("_at") >= F.col("_rows") - n).drop("_at", "_rows")


def keep_last(
    df: DataFrame,
    n: int = BUFFER_EVENTS,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("sequence_index",),
    limit: int | None = None,
) -> DataFrame:
    """The newest ``n`` events of each session of an event table that already has flights."""
    return over_groups(
        df, keys, order, lambda g: newest_rows(g, g.rows, n).drop("_seg"), limit)
