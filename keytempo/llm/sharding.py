"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Row numbers 0..n-1 are written in mixed radix (left, right) over a grid of a x b >= n places with a about b.  Each round
adds a keyed hash of one half to the other half, so every round is a bijection.  Places past the end are walked on until
they fall inside (cycle walking).  With the permuted place p of a row, shard = p mod shards and slot = p div shards: shard
sizes differ by one at most, slots have no gaps, and both can be computed from the row number alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo.llm.common import hex_number, numbered, table

ROUNDS = 6


def _turn(df: DataFrame, place: str, n: int, seed: str, only_outside: bool) -> DataFrame:
    """Replace ``place`` by its image; with ``only_outside`` only where it is n or more."""
    a = max(1, math.isqrt(n - 1) + 1)
    b = -(-n // a)
    df = df.withColumn("_l", F.expr(f"{place} div {b}")).withColumn("_r", F.col(place) % b)
    for k in range(ROUNDS):
        own, other, size = ("_l", "_r", a) if k % 2 == 0 else ("_r", "_l", b)
        noise = hex_number(F.md5(F.concat(F.lit(f"{seed}:{k}:"), F.col(other).cast("string")).cast("binary")), 12)
        df = df.withColumn(own, (F.col(own) + noise) % size)
    image = F.col("_l") * b + F.col("_r")
    if only_outside:
        image = F.when(F.col(place) < n, F.col(place)).otherwise(image)
    return df.withColumn(place, image).drop("_l", "_r")


def walks_needed(spark: SparkSession, n: int, seed: str) -> int:
    """The longest walk of any row.  A row that lands outside is at one of the fewer than a + b outside places, so
    walking those places until none is left outside gives the exact number; it is one or two but for tiny n."""
    a = max(1, math.isqrt(n - 1) + 1)
    size = a * -(-n // a)
    places, walks = spark.range(n, size).select(F.col("id").alias("p")), 0
    while not places.isEmpty():
        places = _turn(places, "p", n, seed, False).where(F.col("p") >= n)
        walks += 1
    return walks


def feistel_shuffle(rows: DataFrame, number: str, n: int, shards: int, seed: str = "keytempo") -> DataFrame:
    """Add ``place``, ``shard`` and ``slot`` for rows with unique numbers 0..n-1."""
    if shards < 1:
        raise ValueError("shards must be positive")
    out = rows.withColumn("place", F.col(number))
    if n:
        out = _turn(out, "place", n, seed, False)
        for _ in range(walks_needed(rows.sparkSession, n, seed)):
            out = _turn(out, "place", n, seed, True)
    return out.withColumns({"shard": (F.col("place") % shards).cast("int"), "slot": F.expr(f"place div {shards}")})


def shard_documents(docs: DataFrame, shards: int = 40, seed: str = "keytempo") -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with size, checksum, row number, place, shard and slot.

    size is the UTF-8 length plus 16; a null text counts 0 bytes and has a null checksum.  Rows are numbered by a hash of
    (doc_id, checksum, size), so the shuffle depends on the rows only, not on files or partitions.  Repeated rows are kept,
    each with a place of its own; a null doc_id is a value like any other.  An empty table gives an empty result.  Other
    columns are ignored.  No text is shuffled.
    """
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    rows = numbered(rows, [], ["doc_id", "text_crc32", "size"], "row_number")
    return feistel_shuffle(rows, "row_number", docs.count(), shards, seed)


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number", "place")
