"""Pairing of key down and key up events, de-duplication and pause segments.

Raw events have ``user_id, session_id, event_type, timestamp_ms, key_token`` and a unique,
increasing ``raw_id`` that settles ties in time.  A key up belongs to the row just before it
among the rows of the same key if that row is a key down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytempo.functions import columns as c
from keytempo.operators.groups import over_groups

KEYS = ("user_id", "session_id")
ORDER = ("timestamp_ms", "raw_id")
MAX_DWELL_MS = 4000.0
CORRECTION_GAP_MS = 400.0
FLAGS = ("is_backspace", "is_enter", "is_space")


def pair_canonical(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Offline pairing of canonical rows: every key down with its release, NULL if none.

    Data without both kinds of event keeps every row, with press = time and no release.
    """
    keys = ("participant_id", "session_id")
    down, up = F.col("event_type").contains("down"), F.col("event_type").contains("up")
    both = events.agg(
        (F.coalesce(F.bool_or(down), F.lit(False)) & F.coalesce(F.bool_or(up), F.lit(False)))
        .alias("both")
    ).scalar()
    order = ["timestamp", *(["event_id"] if "event_id" in events.columns else []), "event_type"]
    tagged = events.withColumn("_kind", F.when(down, "down").when(up, "up").otherwise("other"))

    def body(g):
        rows = g.rows.withColumn("_both", both).filter(~F.col("_both") | (F.col("_kind") != "other"))
        rows = g.derive(
            rows, within=("key_identifier",),
            shift={"_next": ("_kind", -1), "_next_time": ("timestamp", -1)},
        )
        return (
            rows.filter(~F.col("_both") | (F.col("_kind") == "down"))
            .withColumns({
                "press_time": F.col("timestamp"),
                "release_time": F.when(
                    F.col("_both") & (F.col("_next") == "up"), F.col("_next_time")),
            })
            .drop("_kind", "_next", "_next_time", "_both", "_seg")
        )

    return over_groups(tagged, keys, order, body, limit, colocate=True)


def live_pairs(
    g, rows: DataFrame, max_dwell_ms=MAX_DWELL_MS, within: Sequence[str] = (), speed_back: int = 10
):
    """Body: accepted pairs in release order with flight, correction flag and index.

    ``within`` adds boundaries that reset pending keys, flight and corrections (pauses); the
    index runs through the whole session.  ``_since`` is the press of the oldest of the
    ``speed_back`` earlier pairs.
    """
    paired = g.derive(
        rows, within=("key_token", *within),
        shift={"_before": ("event_type", 1), "_down": ("timestamp_ms", 1)},
    )
    dwell = F.col("timestamp_ms") - F.col("_down")
    pairs = paired.filter(
        (F.col("event_type") == "up") & (F.col("_before") == "down")
        & (dwell >= 0) & (dwell <= max_dwell_ms)
    ).withColumn("dwell_time", dwell)
    backspace_press = F.when(F.col("is_backspace"), F.col("_down"))
    neighbours = {"_released": ("timestamp_ms", 1)}
    if within:
        pairs = g.derive(
            pairs, within=within, shift=neighbours, last={"_last_backspace": backspace_press})
        pairs = g.derive(pairs, number="sequence_index")
    else:
        pairs = g.derive(
            pairs, number="sequence_index", last={"_last_backspace": backspace_press},
            shift={**neighbours, "_far": ("_down", speed_back)}, first={"_oldest": "_down"},
        ).withColumn("_since", F.coalesce("_far", "_oldest")).drop("_far", "_oldest")
    burst = F.col("is_backspace") & (
        F.col("_down") - F.col("_last_backspace") < CORRECTION_GAP_MS
    )
    return pairs.withColumns({
        "press_time": F.col("_down"),
        "release_time": F.col("timestamp_ms"),
        "flight_time": c.non_negative(F.col("_down") - F.col("_released")),
        "is_correction": F.coalesce(burst, F.lit(False)),
    }).drop("_before", "_down", "_released", "_last_backspace")


PAIR_COLUMNS = (
    *KEYS, "sequence_index", "press_time", "release_time", "dwell_time", "flight_time",
    "key_token", *FLAGS, "is_correction",
)


def pair_live(raw: DataFrame, max_dwell_ms: float = MAX_DWELL_MS, limit: int | None = None):
    """Live pairing: only pairs with 0 <= dwell <= max; a rejected pair uses up both rows."""

    def body(g):
        return live_pairs(g, g.rows, max_dwell_ms).select(*PAIR_COLUMNS)

    return over_groups(key_rows(raw), KEYS, ORDER, body, limit, colocate=True)


def key_rows(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("event_type").isin("down", "up"))


def correction_bursts(raw: DataFrame, limit: int | None = None) -> DataFrame:
    """Accepted backspace pairs that follow another backspace press within the gap."""
    return pair_live(raw, limit=limit).filter("is_correction")


def dedup_events(raw: DataFrame) -> DataFrame:
    """First delivery of each event id, then of each (type, time, key); ids may be missing.

    Both steps are aggregates with partial results before the shuffle, so many copies of one
    event cost little.
    """
    payload = [n for n in raw.columns if n not in (*KEYS, "event_id")]
    first = F.min_by(F.struct(*payload), "raw_id").alias("_row")  # values of any type, also maps
    columns = list(raw.columns)
    with_id = (
        raw.filter(F.col("event_id").isNotNull())
        .groupBy(*KEYS, "event_id").agg(first).select(*KEYS, "event_id", "_row.*")
        .select(*columns)
    )
    unseen = with_id.unionByName(raw.filter(F.col("event_id").isNull()))
    signature = [*KEYS, "event_type", "timestamp_ms", "key_token"]
    rest = [n for n in columns if n not in signature]
    return (
        unseen.groupBy(*signature)
        .agg(F.min_by(F.struct(*rest), "raw_id").alias("_row"))
        .select(*signature, "_row.*").select(*columns)
    )


def segment_by_pause(
    raw: DataFrame,
    markers: DataFrame,
    max_dwell_ms: float = MAX_DWELL_MS,
    limit: int | None = None,
) -> DataFrame:
    """Live pairing with pauses: rows while paused are ignored and no pair spans a pause.

    ``markers`` has the session keys, ``timestamp_ms``, ``raw_id`` and ``marker``, which is
    ``pause`` or ``resume``.
    """
    events = key_rows(raw).withColumn("marker", F.lit(None).cast("string"))
    stream = events.unionByName(
        markers.select(*KEYS, "timestamp_ms", "raw_id", "marker"), allowMissingColumns=True
    )

    def body(g):
        is_pause = F.coalesce(F.col("marker") == "pause", F.lit(False)).cast("long")
        rows = g.derive(g.rows, sums={"segment": is_pause}, last={"_state": F.col("marker")})
        active = rows.filter(
            F.col("marker").isNull() & (F.coalesce("_state", F.lit("resume")) == "resume")
        ).drop("_state", "marker")
        return live_pairs(g, active, max_dwell_ms, within=("segment",)).select(
            *PAIR_COLUMNS, "segment"
        )

    return over_groups(stream, KEYS, ORDER, body, limit, colocate=True)


def active_duration(raw: DataFrame, markers: DataFrame, limit: int | None = None) -> DataFrame:
    """Session span in seconds without the paused stretches."""
    stream = raw.select(*KEYS, "timestamp_ms", "raw_id", F.lit(None).cast("string").alias("marker"))
    stream = stream.unionByName(markers.select(*KEYS, "timestamp_ms", "raw_id", "marker"))

    def body(g):
        rows = g.derive(
            g.rows, last={"_state": F.col("marker")},
            shift={"_time_before": ("timestamp_ms", 1)})
        step = F.col("timestamp_ms") - F.col("_time_before")
        paused = F.coalesce(F.col("_state"), F.lit("resume")) == "pause"
        return g.aggregate(rows, {
            "span_sec": (F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000.0,
            "paused_sec": F.coalesce(F.sum(F.when(paused, step)), F.lit(0.0)) / 1000.0,
        })

    spans = over_groups(stream, KEYS, ORDER, body, limit)
    return spans.withColumn("active_sec", F.col("span_sec") - F.col("paused_sec"))
