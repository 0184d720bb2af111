"""Variable-capacity best-fit packing of documents into training sequences.

Only the histogram of piece lengths (one row per length, so no more rows than the largest capacity) is planned centrally.
The plan places whole intervals of equal pieces into whole intervals of equal bins: longest pieces first, each into the
open bins with the least room that still fits, and otherwise into new bins of the size whose expected cost per token is
least.  The plan is made for every usable subset of the permitted sizes; the one whose bins, downsized to their contents,
cost least is taken.  Pieces are numbered within their length on Spark and look up their interval, so the work on rows is a
count, a numbering and a join.
"""

from __future__ import annotations

import bisect
import re
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo.llm.common import WORD, numbered, table

SIZES = (512, 1024, 2048, 4096)
#: Fixed cost of a sequence, in tokens.
OVERHEAD = 32


def cost(size: int) -> int:
    return size + OVERHEAD


def fill(histogram: dict[int, int], sizes: tuple[int, ...]) -> tuple[list[tuple], list[tuple]]:
    """Best-fit decreasing over intervals.

    Returns placements (length, first rank, count, first bin, offset) and bins (first bin, count, filled, opened size).
    """
    placed: list[tuple] = []
    room: dict[int, list[tuple]] = {}  # room left -> [(first bin, count, size)]
    rooms: list[int] = []
    bins, below = 0, sum(length * n for length, n in histogram.items())

    def put(left: int, interval: tuple) -> None:
        if left not in room:
            bisect.insort(rooms, left)
            room[left] = []
        room[left].append(interval)

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, count, size = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(at)
            else:
                # What is still to be packed says how full a new bin will be.
                fits = [s for s in sizes if s >= length]
                size = min(fits, key=lambda s: (cost(s) / min(s, max(length, below)), s))
                first, count, left = bins, -(-todo // (size // length)), size
                bins += count
            each = left // length
            if todo < count:  # one piece each for some of these bins
                put(left, (first + todo, count - todo, size))
                count = each = None
                placed.append((length, rank, todo, first, size - left))
                put(left - length, (first, todo, size))
                below -= todo * length
                break
            layers = min(each, todo // count)
            for k in range(layers):
                placed.append((length, rank, count, first, size - left + k * length))
                rank += count
            todo -= layers * count
            below -= layers * count * length
            put(left - layers * length, (first, count, size))
    filled = [(first, count, size - left, size) for left in room for first, count, size in room[left]]
    return placed, sorted(filled)


def downsized(content: int, sizes: tuple[int, ...]) -> int:
    return next(s for s in sizes if s >= content)


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES) -> list[tuple]:
    """Intervals (length, first rank, count, first bin, offset, capacity, content), each inside one run of equal bins."""
    sizes, best = tuple(sorted(sizes)), None
    if not histogram:
        return []
    for k in range(1, len(sizes) + 1):
        for some in combinations(sizes, k):
            if some[-1] < max(histogram):
                continue
            placed, bins = fill(histogram, some)
            total = sum(count * cost(downsized(content, sizes)) for _, count, content, _ in bins)
            if best is None or total < best[0]:
                best = total, placed, bins
    _, placed, bins = best
    firsts = [b[0] for b in bins]
    out = []
    for length, rank, count, first, offset in placed:
        while count:
            run = bins[bisect.bisect_right(firsts, first) - 1]
            part = min(count, run[0] + run[1] - first)
            out.append((length, rank, part, first, offset, downsized(run[2], sizes), run[2]))
            rank, first, count = rank + part, first + part, count - part
    return out


def cut_text(text: str, most: int) -> list[str]:
    """The pieces of a text of ``most`` words each, and a rest; together they are the text."""
    ends = [m.end() for n, m in enumerate(re.finditer(WORD, text), 1) if n % most == 0]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, with_text: bool = False) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences of the permitted sizes.

    A document takes its words plus one end mark.  One longer than the largest size is cut into pieces of that size and a
    rest.  A row per piece: doc_id, piece, first_word, length, bin_id, bin_offset, bin_capacity, bin_content.  A null text
    takes no room: one row of length 0 with null bin columns.  A text without words takes its end mark.  Repeated rows and
    repeated doc_ids are packed each by itself.  An empty table gives an empty result.  A very long text becomes many
    pieces.  Other columns of ``docs``, whatever their names, are not read.  ``with_text`` adds ``text``, the part of the
    text that a piece stands for, with the space between words as it was: the pieces of a document make up its text.

    The plan is broadcast: its size depends on the sizes and lengths, never on the number of rows.
    """
    spark, most = docs.sparkSession, max(sizes)
    total = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD)) + 1).cast("long")
    counted = docs.select("doc_id", total.alias("_total"), *(["text"] if with_text else []))
    if with_text:
        long = F.col("_total") > most  # only these texts leave the JVM

        @F.pandas_udf("array<string>")
        def cut(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else cut_text(t, most))

        texts = F.when(long, cut(F.when(long, F.col("text")))).otherwise(F.array("text"))
        each = counted.select("doc_id", "_total", F.posexplode(texts).alias("piece", "text"))
    else:
        each = counted.select("doc_id", "_total", F.explode(F.sequence(
            F.lit(0).cast("long"), F.expr(f"greatest(_total - 1, 0) div {most}"))).alias("piece"))
    shown = ["text"] if with_text else []
    pieces = (each.withColumn("piece", F.col("piece").cast("long"))
              .select("doc_id", "piece", (F.col("piece") * most).alias("first_word"),
                      F.least(F.lit(most), F.col("_total") - F.col("piece") * most).cast("int").alias("length"), *shown))
    histogram = {r[0]: r[1] for r in pieces.drop("text").where("length > 0").groupBy("length").count().collect()}
    intervals = spark.createDataFrame(
        plan(histogram, sizes),
        "p_length int, p_rank long, p_count long, p_bin long, bin_offset int, bin_capacity int, bin_content int")
    rows = numbered(pieces, ["length"], ["doc_id", "piece"], "_rank", digits=2)
    found = rows.join(F.broadcast(intervals), (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_rank"))
                      & (F.col("_rank") < F.col("p_rank") + F.col("p_count")), "left")
    return found.select("doc_id", "piece", "first_word", "length",
                        (F.col("p_bin") + F.col("_rank") - F.col("p_rank")).alias("bin_id"),
                        "bin_offset", "bin_capacity", "bin_content", *shown)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
