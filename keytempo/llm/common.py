"""Helpers shared by the text operators: tables, stored steps, numbering, words as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of bytes other than space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Text handled at once by a task's numpy code.
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Only a one-process session may use its own temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="keytempo-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back, so that a lost executor repeats only what follows."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hex_number(text: Column, digits: int) -> Column:
    """The first hexadecimal digits (15 at most) of a text as a long."""
    return F.conv(F.substring(text, 1, digits), 16, 10).cast("long")


def numbered(df: DataFrame, group: list[str], order: list[str], into: str, digits: int = 3) -> DataFrame:
    """Number the rows of each group from 0, in a fixed order, however large a group is.

    Rows are dealt to 16**digits buckets by a hash of the order columns and sorted there; bucket totals give the offsets,
    one row per group and bucket.  Rows equal in all order columns take their numbers in any order.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in order])
    rows = df.withColumn("_b", hex_number(F.md5(text.cast("binary")), digits))
    totals = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_b").alias("_o"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if not group:
        offsets = F.broadcast(offsets)  # 16**digits rows at most
    inside = Window.partitionBy(*group, "_b").orderBy(*order)
    rows = rows.withColumn("_r", F.row_number().over(inside))
    on = [rows[c] == offsets[f"_g_{c}"] for c in group] + [rows["_b"] == offsets["_o"]]
    return (rows.join(offsets, on, "inner").withColumn(into, F.col("_before") + F.col("_r") - 1)
            .drop("_b", "_r", "_o", "_before", *[f"_g_{c}" for c in group]))


# numpy side ---------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int, lower: bool = False) -> np.ndarray:
    """A random 64-bit value per byte; with ``lower``, A-Z share the values of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    if lower:
        values[65:91] = values[97:123]
    return values


BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i, with a leading 0."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] that does not depend on the place."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def text_slices(ids: pa.Array, texts: pa.Array, most: int = SLICE_BYTES):
    """(ids, bytes, offsets) of consecutive documents, about ``most`` bytes at once; null texts are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    ids = ids.to_numpy(zero_copy_only=False)
    at = 0
    while at < len(ids):
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), len(ids), at + 4096)
        yield ids[at:end], data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word and the first word of each document (one more entry than documents)."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = SPACES[data]
    first = ~gap[:-1]
    first[1:] &= gap[:-2]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = ~gap[heads]
    last = ~gap[:-1]
    last[:-1] &= gap[1:-1]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = ~gap[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def concat_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] numbers), then the same for the next."""
    total = int(count.sum())
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(start - (np.cumsum(count) - count), count)
