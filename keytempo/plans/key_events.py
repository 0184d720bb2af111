"""The generic ``events`` table read as key events.

One minute of table time plays one millisecond, the value is the hold time, a session is a
person's week, error events are backspaces, and odd user numbers form the second condition.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo.functions.columns import rounded
from keytempo.operators.groups import shared_folder


# Times are the same double in every engine and are never rounded.
TIMES = ("timestamp", "timestamp_ms", "press_time", "release_time", "start_time", "end_time")


def stable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round computed doubles so that the order of additions cannot show."""
    return rounded(df, {
        n: digits for n, t in df.dtypes if t in ("double", "float") and n not in TIMES
    })


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per key press with press and release time."""
    ts = F.col("ts").cast("timestamp")
    press = F.unix_micros(ts) / 6.0e7
    is_error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("user_id"),
        F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd").alias("session_id"),
        press.alias("timestamp"),
        F.concat(F.lit("k_"), F.col("event_type")).alias("key_token"),
        press.alias("press_time"),
        (press + F.col("value")).alias("release_time"),
        is_error.cast("int").alias("backspace"),
        is_error.cast("int").alias("error_flag"),
        F.when(F.col("user_id") % 2 == 1, "stressed").otherwise("neutral").alias("state"),
    )


def down_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key press as a key down row and a key up row."""
    kinds = F.array(
        F.struct(F.lit("down").alias("event_type"), F.col("press_time").alias("timestamp_ms"),
                 (F.col("event_id") * 2).alias("raw_id")),
        F.struct(F.lit("up").alias("event_type"), F.col("release_time").alias("timestamp_ms"),
                 (F.col("event_id") * 2 + 1).alias("raw_id")),
    )
    rows = key_events(spark, sf_dir).select(
        "user_id", "session_id", "state", "key_token", F.explode(kinds).alias("r")
    )
    return rows.select(
        "user_id", "session_id", "state", "r.event_type", "r.timestamp_ms", "key_token",
        (F.col("key_token") == "k_error").alias("is_backspace"),
        (F.col("key_token") == "k_click").alias("is_enter"),
        (F.col("key_token") == "k_view").alias("is_space"),
        F.concat(F.lit("e"), F.col("r.raw_id").cast("string")).alias("event_id"),
        "r.raw_id",
    )


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/keytempo-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """A step that several later ones read: written to the shared folder once, and read back."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
