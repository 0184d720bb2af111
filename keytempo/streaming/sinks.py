"""``foreachBatch`` sinks: gate and deviation of closed sessions, and a keyed table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo.operators import baselines as bl
from keytempo.operators.adapt import with_payload_checks
from keytempo.operators.validation import GateLimits, with_gate
from keytempo.schemas import BASELINE_STATS
from keytempo.streaming.keyed import KeyedTable
from keytempo.streaming.keys import KEYS

METRICS = {"mean_dwell_ms": "mean_dwell_time", "mean_flight_ms": "mean_flight_time"}


def gate_sessions(closed: DataFrame, limits: GateLimits = GateLimits()) -> DataFrame:
    """Quality gate on session window rows."""
    measured = closed.withColumns({
        "total_paired_events": F.col("event_count"),
        "duration_seconds": F.when(F.col("event_count") >= 2, F.greatest(
            F.lit(0.0), (F.col("end_time") - F.col("start_time")) / 1000.0)).otherwise(0.0),
        "non_finite_count": F.lit(0), "negative_timing_count": F.lit(0),
    })
    return with_gate(measured, limits).drop("non_finite_count", "negative_timing_count")


def deviation_of_closed(closed: DataFrame, baselines: DataFrame) -> DataFrame:
    """Deviation index of session window rows against stored baselines."""
    features = closed.select(
        "user_id", "session_id", *[F.col(c).alias(f) for c, f in METRICS.items()])
    index = bl.session_index(features, baselines, features=list(METRICS.values()))
    return index.select("user_id", "session_id", F.when(
        F.col("evaluated_features") > 0, F.col("typing_deviation_index"))
        .alias("typing_deviation_index"))


def sanitize_sink(path: str, payload: str = "payload", keep: Sequence[str] = KEYS) -> Callable[[DataFrame, int], None]:
    """Write the clean events of a batch and its rejects with their reasons in one pass and one commit.

    A batch has one folder, cut into ``kind=clean`` and ``kind=rejected``; a batch that is run again overwrites it, so both
    outputs hold every row once.  Rejected rows carry the ``keep`` columns and the reason, never the payload.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        checked = with_payload_checks(batch, payload)
        good = F.col("_reason").isNull()
        fields = [f.name for f in checked.schema["_event"].dataType.fields]
        rows = checked.select(
            *keep, *[F.when(good, F.col("_event")[f]).alias(f) for f in fields if f not in keep], F.col("_reason").alias("reason"),
            F.when(good, "clean").otherwise("rejected").alias("kind"))
        rows.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch_id}")

    return write


def sanitized_output(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(clean events, rejects) of all batches that ``sanitize_sink`` has finished."""
    rows = spark.read.parquet(path).drop("batch")
    clean = rows.filter("kind = 'clean'").drop("kind", "reason")
    return clean, rows.filter("kind = 'rejected'").drop("kind")


def score_sink(
    baselines: Callable[[], DataFrame], path: str, limits: GateLimits = GateLimits()
) -> Callable[[DataFrame, int], None]:
    """Gate closed sessions, compare them with the baselines and write one folder per batch.

    ``baselines`` is called per batch, so a refreshed table is picked up.  A batch that is run
    again overwrites its own folder.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        gated = gate_sessions(batch, limits)
        index = deviation_of_closed(batch, baselines())
        out = gated.join(index, ["user_id", "session_id"], "left")
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def upsert_sink(
    table: KeyedTable, keys: Sequence[str], order: str | Sequence[str], update_cols: Sequence[str] | None = None
) -> Callable[[DataFrame, int], None]:
    """Merge each batch of a stream into a keyed table."""
    return lambda batch, batch_id: table.merge(batch, batch_id, keys, order, update_cols)


def baseline_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BASELINE_STATS).parquet(path)


def run_to_end(query) -> None:
    """Wait for an ``availableNow`` query, however long it takes; its failure is raised here."""
    query.awaitTermination()
