"""Session features: one row per (person, session)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytempo import names
from keytempo.functions import columns as c
from keytempo.operators import events as ev
from keytempo.operators.groups import over_groups
from keytempo.operators.pairing import KEYS, MAX_DWELL_MS, ORDER, key_rows, live_pairs

PAUSE_MS = 2000.0
LONG_PAUSE_MS = 4000.0
BASIC_PAUSE_MS = 500.0
NEAR_ZERO = 1e-5
MIN_SPEED_EVENTS = 5
MIN_MINUTES = 0.001


def _zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def _backspace_total(df: DataFrame) -> Column:
    flag = c.first_present(df.columns, names.BACKSPACE_COLUMNS)
    if flag:
        as_number = F.col(flag).cast("int") if dict(df.dtypes)[flag] == "boolean" \
            else c.number(flag)
        return _zero(F.sum(as_number).cast("double"))
    if "key" in df.columns:
        named = F.lower(F.trim(F.col("key").cast("string"))).isin(*names.BACKSPACE_LABELS)
        return F.count_if(named).cast("double")
    return F.lit(0.0)


def _variability(name: str, col: str) -> tuple[dict[str, Column], dict[str, str]]:
    """Plain aggregates and MADs; groups with fewer than two values become 0 later."""
    return (
        {f"_n_{name}": F.count(col), f"_avg_{name}": F.avg(col), f"_sd_{name}": F.stddev_samp(col)},
        {f"_mad_{name}": col},
    )


def _variability_result(name: str) -> dict[str, Column]:
    n, mean = F.col(f"_n_{name}"), F.col(f"_avg_{name}")
    sd, mad = F.col(f"_sd_{name}"), F.col(f"_mad_{name}")
    seen = n > 0
    return {
        f"std_{name}": F.when(seen, F.when(n > 1, sd).otherwise(0.0)),
        f"cv_{name}": F.when(
            seen, F.when((n > 1) & (F.abs(mean) > NEAR_ZERO), sd / mean).otherwise(0.0)),
        f"mad_{name}": F.when(seen, F.when(n > 1, mad).otherwise(0.0)),
    }


def session_features(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("press_time", "event_id"),
    time_col: str = "timestamp",
    label: str | None = "state",
    pause_ms: float = PAUSE_MS,
    limit: int | None = None,
) -> DataFrame:
    """The session feature table.

    Which features exist follows from the columns of ``df``; a feature whose inputs are there
    but empty in one session is NULL in that session.  Without the person column the table is
    built per session, without both the whole input is one session.  Every statistic of a
    session comes from one exchange on the session keys.
    """
    keys, df = _session_keys(df, keys)
    return over_groups(
        df, keys, order, lambda g: features_body(g, g.rows, time_col, label, pause_ms), limit
    )


def _session_keys(df: DataFrame, keys: Sequence[str]) -> tuple[list[str], DataFrame]:
    user, session = keys
    if session not in df.columns:
        return list(keys), df.withColumns({
            user: F.lit("default_user"), session: F.lit("default_session")})
    if user not in df.columns:
        df = df.withColumn(user, F.lit("unknown_user"))
    return list(keys), df


def features_body(
    g, rows: DataFrame, time_col: str, label: str | None, pause_ms: float
) -> DataFrame:
    """Body: all features of ``rows`` per group of ``g``."""
    dwell, flight = ev.dwell(rows), ev.given_flight(rows)
    has_dwell = dwell is not None
    has_flight = flight is not None or {"press_time", "release_time"} <= set(rows.columns)
    source = rows.columns
    if flight is not None:
        rows = rows.withColumn("_flight", flight)
    elif has_flight:
        rows = ev.with_flight(g, rows, "_flight")
    if has_dwell:
        rows = rows.withColumn("_dwell", dwell)

    plain: dict[str, Column] = {"keystroke_count": F.count(F.lit(1))}
    quantiles: dict[str, tuple[str, float]] = {}
    mads: dict[str, str] = {}
    out: dict[str, Column] = {"keystroke_count": F.col("keystroke_count")}

    if time_col in source:
        t = c.number(time_col)
        plain["session_duration_sec"] = F.when(
            F.count(t) >= 2, (F.max(t) - F.min(t)) / 1000.0).otherwise(0.0)
    else:
        plain["session_duration_sec"] = F.lit(0.0)
    out["session_duration_sec"] = F.col("session_duration_sec")

    for name, present in (("dwell_time", has_dwell), ("flight_time", has_flight)):
        if not present:
            continue
        col = "_dwell" if name == "dwell_time" else "_flight"
        more, spread = _variability(name, col)
        plain |= more
        mads |= spread
        plain |= {f"min_{name}": F.min(col), f"max_{name}": F.max(col)}
        quantiles[f"median_{name}"] = (col, 0.5)
        if name == "dwell_time":
            quantiles |= {"p25_dwell_time": (col, 0.25), "p75_dwell_time": (col, 0.75)}
        out[f"mean_{name}"] = F.col(f"_avg_{name}")
        for stat in ("median", "min", "max") + (("p25", "p75") if col == "_dwell" else ()):
            out[f"{stat}_{name}"] = F.col(f"{stat}_{name}")
        out |= _variability_result(name)

    if has_flight:
        rows = rows.withColumn("_pause", F.when(F.col("_flight") >= pause_ms, F.col("_flight")))
        plain |= {
            "_pauses": F.count("_pause"), "_pause_mean": F.avg("_pause"),
            "_pause_max": F.max("_pause"),
            "_long": F.count_if(F.col("_flight") >= LONG_PAUSE_MS),
        }
        quantiles["_pause_median"] = ("_pause", 0.5)
        n = F.col("_n_flight_time")
        seen = n > 0
        out |= {
            "pause_rate": F.when(seen, F.col("_pauses") / n),
            "mean_pause_duration": F.when(seen, _zero(F.col("_pause_mean"))),
            "median_pause_duration": F.when(seen, _zero(F.col("_pause_median"))),
            "max_pause_duration": F.when(seen, _zero(F.col("_pause_max"))),
            "long_pause_count": F.when(seen, F.col("_long").cast("double")),
            "long_pause_ratio": F.when(seen, F.col("_long") / n),
        }

    rows = _typing_speed(rows, source, has_dwell, has_flight, plain, quantiles, out)

    plain["total_backspaces"] = _backspace_total(rows)
    count = F.col("keystroke_count")
    out["total_backspaces"] = F.col("total_backspaces")
    out["backspace_rate"] = c.ratio(F.col("total_backspaces"), count)
    out["backspace_proportion"] = out["backspace_rate"]

    error = c.first_present(source, names.ERROR_COLUMNS)
    if error:
        plain["total_errors"] = _zero(F.sum(c.number(error)))
        out["total_errors"] = F.col("total_errors")
        out["error_rate"] = c.ratio(F.col("total_errors"), count)

    word = c.first_present(source, names.WORD_COLUMNS)
    if word:
        rows = rows.withColumn("_word", c.number(word))
        plain |= {"_words": F.count("_word"), "_word_mean": F.avg("_word"),
                  "_word_sd": F.stddev_samp("_word")}
        quantiles["_word_median"] = ("_word", 0.5)
        enough = F.col("_words") >= 2
        out |= {
            "mean_word_completion_time": F.when(enough, F.col("_word_mean")),
            "median_word_completion_time": F.when(enough, F.col("_word_median")),
            "word_completion_variability": F.when(enough, F.col("_word_sd")),
        }

    if label and label in source:
        plain["target_label"] = F.min_by(label, F.struct(*g.order))
        out["target_label"] = F.col("target_label")

    table = g.aggregate(rows, plain, quantiles, mads)
    return table.select(*g.keys, *[expr.alias(name) for name, expr in out.items()])


def _typing_speed(rows, source, has_dwell, has_flight, plain, quantiles, out) -> DataFrame:
    """Given speed values where a session has any, else events over summed intervals."""
    parts = [F.sum(col) for col, there in (("_dwell", has_dwell), ("_flight", has_flight)) if there]
    elapsed = F.lit(0.0)
    for part in parts:
        elapsed = elapsed + _zero(part)
    plain["_minutes"] = elapsed / 60000.0
    count = F.col("keystroke_count")
    wpm = F.when(
        (count >= MIN_SPEED_EVENTS) & (F.col("_minutes") > MIN_MINUTES),
        F.least(count / 5.0 / F.col("_minutes"), F.lit(ev.MAX_WPM)),
    ).otherwise(0.0)
    empirical = {"mean": wpm, "median": wpm, "std": F.lit(0.0), "min": wpm, "max": wpm}
    if "typing_speed" in source:
        rows = rows.withColumn("_speed", c.number("typing_speed"))
        plain |= {
            "_speeds": F.count("_speed"), "_speed_mean": F.avg("_speed"),
            "_speed_std": F.stddev_samp("_speed"), "_speed_min": F.min("_speed"),
            "_speed_max": F.max("_speed"),
        }
        quantiles["_speed_median"] = ("_speed", 0.5)
        for stat, fallback in empirical.items():
            given = F.col(f"_speed_{stat}")
            if stat == "std":
                given = F.when(F.col("_speeds") > 1, given).otherwise(0.0)
            out[f"{stat}_typing_speed_wpm"] = F.when(F.col("_speeds") > 0, given)\
                .otherwise(fallback)
    else:
        out |= {f"{stat}_typing_speed_wpm": expr for stat, expr in empirical.items()}
    return rows


def publish(features: DataFrame) -> DataFrame:
    """Session features with the published number of digits."""
    return c.rounded(features, names.FEATURE_DIGITS)


def group_variability(
    df: DataFrame, col: str, keys: Sequence[str] = KEYS, limit: int | None = None
) -> DataFrame:
    """Standard deviation, coefficient of variation and MAD of one column per group."""
    plain, mads = _variability(col, col)

    def body(g):
        table = g.aggregate(g.rows.filter(F.col(col).isNotNull()), plain, mads=mads)
        return table.select(*keys, *[e.alias(n) for n, e in _variability_result(col).items()])

    return over_groups(df, keys, (), body, limit)


def timing_features(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("press_time", "event_id"),
    pause_ms: float = BASIC_PAUSE_MS,
    limit: int | None = None,
) -> DataFrame:
    """Basic timing of press/release rows: population spread, pauses strictly above the limit."""

    def body(g):
        rows = ev.with_flight(g, g.rows, "_flight").withColumn(
            "_hold", F.col("release_time") - F.col("press_time"))
        enough = F.count(F.lit(1)) >= 2
        measures = {
            "mean_hold_time_ms": F.avg("_hold"), "std_hold_time_ms": F.stddev_pop("_hold"),
            "mean_flight_time_ms": F.avg("_flight"), "std_flight_time_ms": F.stddev_pop("_flight"),
            "pause_rate": F.count_if(F.col("_flight") > pause_ms)
            / F.greatest(F.count("_flight"), F.lit(1)),
        }
        plain = {n: F.when(enough, e).otherwise(0.0) for n, e in measures.items()}
        plain["keystroke_count"] = F.count(F.lit(1)).cast("double")
        return g.aggregate(rows, plain)

    return over_groups(df, keys, order, body, limit)


def telemetry_body(
    g, pairs: DataFrame, pause_ms: float = ev.LIVE_PAUSE_MS, extra: dict | None = None
) -> DataFrame:
    """Body: live summary of accepted pairs, with ``extra`` aggregates."""
    rows = pairs.withColumns({
        "_dwell": F.when(F.col("dwell_time") > 0, F.col("dwell_time")),
        "_flight": F.when(F.col("flight_time") >= 0, F.col("flight_time")),
    })
    at = F.struct(*g.order)
    more = dict(extra or {})
    table = g.aggregate(
        rows,
        {
            **more,
            "event_count": F.count(F.lit(1)),
            "_dwell_mean": F.avg("_dwell"),
            "_flight_mean": F.avg("_flight"),
            "_flights": F.count("_flight"),
            "pause_count": F.count_if(F.col("_flight") > pause_ms),
            "backspace_count": F.count_if(F.col("is_backspace")),
            "correction_count": F.count_if(F.col("is_correction")),
            "_start": F.min_by("press_time", at),
            "_end": F.max_by("release_time", at),
        },
        {"_dwell_median": ("_dwell", 0.5), "_flight_median": ("_flight", 0.5)},
    )
    count = F.col("event_count")
    seconds = F.greatest(F.lit(0.1), (F.col("_end") - F.col("_start")) / 1000.0)
    wpm = c.clip(count / 5.0 / F.greatest(seconds / 60.0, F.lit(0.001)), 0.0, ev.MAX_WPM)
    return table.select(
        *g.keys,
        "event_count",
        _zero(F.col("_dwell_mean")).alias("mean_dwell_ms"),
        _zero(F.col("_dwell_median")).alias("median_dwell_ms"),
        _zero(F.col("_flight_mean")).alias("mean_flight_ms"),
        _zero(F.col("_flight_median")).alias("median_flight_ms"),
        "pause_count",
        c.ratio(F.col("pause_count"), F.col("_flights")).alias("pause_rate"),
        wpm.alias("estimated_wpm"),
        "backspace_count",
        "correction_count",
        c.ratio(F.col("backspace_count") + F.col("correction_count"), count).alias("error_rate"),
        seconds.alias("duration_seconds"),
        *more,
    )


def telemetry(
    raw: DataFrame,
    pause_ms: float = ev.LIVE_PAUSE_MS,
    max_dwell_ms: float = MAX_DWELL_MS,
    limit: int | None = None,
) -> DataFrame:
    """Raw key events to one live summary row per session."""
    return over_groups(
        key_rows(raw), KEYS, ORDER,
        lambda g: telemetry_body(g, live_pairs(g, g.rows, max_dwell_ms), pause_ms),
        limit, colocate=True,
    )


def strain_score(timing: DataFrame) -> DataFrame:
    """Heuristic score 0-100 from basic timing features, with bands at 35 and 70."""
    enough = F.col("keystroke_count") >= 5
    score = 100.0 * (
        0.45 * F.least(F.col("pause_rate") / 0.4, F.lit(1.0))
        + 0.35 * F.least(F.col("std_flight_time_ms") / 300.0, F.lit(1.0))
        + 0.20 * c.clip((F.col("mean_hold_time_ms") - 80.0) / 150.0, 0.0, 1.0)
    )
    score = F.when(enough, F.round(score, 1)).otherwise(0.0)
    category = (
        F.when(~enough, names.STRAIN_CATEGORIES["unknown"])
        .when(score < 35, names.STRAIN_CATEGORIES["low"])
        .when(score < 70, names.STRAIN_CATEGORIES["moderate"])
        .otherwise(names.STRAIN_CATEGORIES["high"])
    )
    return timing.withColumns({
        "strain_score": score,
        "strain_category": category,
        "confidence": F.when(enough, 0.75).otherwise(0.0),
        "is_medical_diagnosis": F.lit(False),
    })
