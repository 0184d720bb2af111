"""Named SQL parts the oracle queries are put together from."""

from __future__ import annotations

PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, *needs: str, sql: str) -> None:
    PARTS[name] = (needs, sql)


def with_parts(*wanted: str, body: str) -> str:
    """``WITH`` all wanted parts and what they need, followed by ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        needs, _ = PARTS[name]
        for need in needs:
            visit(need)
        if name not in order:
            order.append(name)

    for name in wanted:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n][1]})" for n in order) + "\n" + body


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


part("ev", sql="""
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id,
  strftime(date_trunc('week', ts), '%Y-%m-%d') AS session_id,
  epoch_us(ts) / 6.0e7 AS "timestamp", 'k_' || event_type AS key_token,
  epoch_us(ts) / 6.0e7 AS press_time, epoch_us(ts) / 6.0e7 + value AS release_time,
  CAST(event_type = 'error' AS INTEGER) AS backspace,
  CAST(event_type = 'error' AS INTEGER) AS error_flag,
  CASE WHEN user_id % 2 = 1 THEN 'stressed' ELSE 'neutral' END AS state
FROM events""")

part("fl", "ev", sql="""
SELECT *, release_time - press_time AS dwell,
  CASE WHEN before IS NOT NULL THEN greatest(0.0, press_time - before) END AS flight
FROM (SELECT *, lag(release_time) OVER (PARTITION BY user_id, session_id
                                        ORDER BY press_time, event_id) AS before FROM ev)""")

part("centre", "fl", sql="""
SELECT *, median(dwell) OVER (PARTITION BY user_id, session_id) AS dwell_centre,
  median(flight) OVER (PARTITION BY user_id, session_id) AS flight_centre FROM fl""")

part("sf", "centre", sql="""
SELECT user_id, session_id, count(*) AS keystroke_count,
  CASE WHEN count(*) >= 2 THEN (max("timestamp") - min("timestamp")) / 1000.0 ELSE 0 END
    AS session_duration_sec,
  avg(dwell) AS mean_dwell_time, quantile_cont(dwell, 0.5) AS median_dwell_time,
  min(dwell) AS min_dwell_time, max(dwell) AS max_dwell_time,
  quantile_cont(dwell, 0.25) AS p25_dwell_time, quantile_cont(dwell, 0.75) AS p75_dwell_time,
  CASE WHEN count(*) > 1 THEN stddev_samp(dwell) ELSE 0 END AS std_dwell_time,
  CASE WHEN count(*) > 1 AND abs(avg(dwell)) > 1e-5 THEN stddev_samp(dwell) / avg(dwell) ELSE 0 END
    AS cv_dwell_time,
  CASE WHEN count(*) > 1 THEN median(abs(dwell - dwell_centre)) ELSE 0 END AS mad_dwell_time,
  avg(flight) AS mean_flight_time, quantile_cont(flight, 0.5) AS median_flight_time,
  min(flight) AS min_flight_time, max(flight) AS max_flight_time,
  CASE WHEN count(flight) > 1 THEN stddev_samp(flight) WHEN count(flight) = 1 THEN 0 END
    AS std_flight_time,
  CASE WHEN count(flight) > 1 AND abs(avg(flight)) > 1e-5 THEN stddev_samp(flight) / avg(flight)
       WHEN count(flight) >= 1 THEN 0 END AS cv_flight_time,
  CASE WHEN count(flight) > 1 THEN median(abs(flight - flight_centre))
       WHEN count(flight) = 1 THEN 0 END AS mad_flight_time,
  CASE WHEN count(flight) > 0 THEN count(*) FILTER (flight >= 2000) / count(flight) END
    AS pause_rate,
  CASE WHEN count(flight) > 0 THEN coalesce(avg(flight) FILTER (flight >= 2000), 0) END
    AS mean_pause_duration,
  CASE WHEN count(flight) > 0 THEN coalesce(median(flight) FILTER (flight >= 2000), 0) END
    AS median_pause_duration,
  CASE WHEN count(flight) > 0 THEN coalesce(max(flight) FILTER (flight >= 2000), 0) END
    AS max_pause_duration,
  CASE WHEN count(flight) > 0 THEN CAST(count(*) FILTER (flight >= 4000) AS DOUBLE) END
    AS long_pause_count,
  CASE WHEN count(flight) > 0 THEN count(*) FILTER (flight >= 4000) / count(flight) END
    AS long_pause_ratio,
  CASE WHEN count(*) >= 5 AND (sum(dwell) + coalesce(sum(flight), 0)) / 60000.0 > 0.001
       THEN least(count(*) / 5.0 / ((sum(dwell) + coalesce(sum(flight), 0)) / 60000.0), 250.0)
       ELSE 0 END AS mean_typing_speed_wpm,
  CAST(sum(backspace) AS DOUBLE) AS total_backspaces,
  sum(backspace) / count(*) AS backspace_rate,
  CAST(sum(error_flag) AS DOUBLE) AS total_errors,
  sum(error_flag) / count(*) AS error_rate,
  arg_min(state, struct_pack(p := press_time, e := event_id)) AS target_label
FROM centre GROUP BY user_id, session_id""")

part("raw", "ev", sql="""
SELECT user_id, session_id, state, key_token, kind AS event_type,
  CASE WHEN kind = 'down' THEN press_time ELSE release_time END AS timestamp_ms,
  key_token = 'k_error' AS is_backspace, key_token = 'k_click' AS is_enter,
  key_token = 'k_view' AS is_space,
  event_id * 2 + CASE WHEN kind = 'up' THEN 1 ELSE 0 END AS raw_id
FROM ev, (VALUES ('down'), ('up')) AS kinds(kind)""")

part("matched", "raw", sql="""
SELECT *, lag(event_type) OVER k AS before, lag(timestamp_ms) OVER k AS down
FROM raw WINDOW k AS (PARTITION BY user_id, session_id, key_token
                      ORDER BY timestamp_ms, raw_id)""")

part("accepted", "matched", sql="""
SELECT *, timestamp_ms - down AS dwell_time FROM matched
WHERE event_type = 'up' AND before = 'down'
  AND timestamp_ms - down >= 0 AND timestamp_ms - down <= 4000""")

part("pairs", "accepted", sql="""
SELECT user_id, session_id, state, raw_id, key_token, is_backspace, is_enter, is_space,
  row_number() OVER s - 1 AS sequence_index, down AS press_time, timestamp_ms AS release_time,
  dwell_time,
  CASE WHEN lag(timestamp_ms) OVER s IS NOT NULL
       THEN greatest(0.0, down - lag(timestamp_ms) OVER s) END AS flight_time,
  coalesce(is_backspace AND down - last_value(CASE WHEN is_backspace THEN down END IGNORE NULLS)
    OVER (PARTITION BY user_id, session_id ORDER BY timestamp_ms, raw_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 400, false) AS is_correction
FROM accepted WINDOW s AS (PARTITION BY user_id, session_id ORDER BY timestamp_ms, raw_id)""")

part("features", "pairs", sql="""
SELECT user_id, session_id, sequence_index, press_time, release_time, dwell_time, flight_time,
  CASE WHEN flight_time > 500 THEN flight_time ELSE 0.0 END AS pause_duration,
  CASE WHEN n > 1 THEN least(greatest(
    n / 5.0 / greatest(greatest(100.0, release_time - first_press) / 60000.0, 0.001), 0.0), 250.0)
    ELSE 0.0 END AS typing_speed,
  CAST(is_backspace AS DOUBLE) AS backspace,
  CAST(is_backspace OR is_correction AS DOUBLE) AS error_flag, state
FROM (SELECT *, count(*) OVER f AS n, first_value(press_time) OVER f AS first_press FROM pairs
      WINDOW f AS (PARTITION BY user_id, session_id ORDER BY release_time, raw_id
                   ROWS BETWEEN 10 PRECEDING AND CURRENT ROW))""")

part("tel", "pairs", sql="""
SELECT user_id, session_id, count(*) AS event_count,
  coalesce(avg(dwell_time) FILTER (dwell_time > 0), 0) AS mean_dwell_ms,
  coalesce(median(dwell_time) FILTER (dwell_time > 0), 0) AS median_dwell_ms,
  coalesce(avg(flight_time), 0) AS mean_flight_ms,
  coalesce(median(flight_time), 0) AS median_flight_ms,
  count(*) FILTER (flight_time > 500) AS pause_count,
  count(*) FILTER (flight_time > 500) / greatest(count(flight_time), 1) AS pause_rate,
  least(count(*) / 5.0 / greatest(greatest(0.1,
    (arg_max(release_time, sequence_index) - arg_min(press_time, sequence_index)) / 1000.0)
    / 60.0, 0.001), 250.0) AS estimated_wpm,
  count(*) FILTER (is_backspace) AS backspace_count,
  count(*) FILTER (is_correction) AS correction_count,
  (count(*) FILTER (is_backspace) + count(*) FILTER (is_correction)) / count(*) AS error_rate,
  greatest(0.1, (arg_max(release_time, sequence_index) - arg_min(press_time, sequence_index))
    / 1000.0) AS duration_seconds
FROM pairs GROUP BY user_id, session_id""")
