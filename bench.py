"""Headline query times.  Prints one JSON line.

BENCH_SF_DIR   folder with the tables        (default /root/testdata/sf0.1)
BENCH_CPUS     threads of the local session  (default 8)
BENCH_RUNS     timed runs per query, median  (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from keytempo.plans.catalogue import QUERIES
from keytempo.session import build_session

HEADLINE = (
    "session_features", "session_telemetry", "paired_events", "paired_live",
    "event_feature_frame", "pause_segments", "dedup_raw_events", "clean_report", "clean_events",
    "quality_score", "validation_report", "session_gate", "user_baselines", "session_deviation",
    "deviation_index", "rolling_deviation", "sliding_windows", "window_aggregates",
    "grouped_split3", "scaled_standard", "scaled_robust", "encoded_labels",
    "classification_metrics", "prediction_uncertainty", "pseudonymized_ids", "sanitized_events",
    "duplicates", "upsert_sessions", "assessments",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "keytempo-bench", f"local[{cpus}]", spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in wanted:
        once(name)  # warm-up, not counted
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus), "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
