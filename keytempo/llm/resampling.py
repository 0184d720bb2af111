"""Importance resampling towards a target set, drawn by a distributed radix sort.

Weights: word n-grams are hashed to buckets by CRC-32; an array with the log ratio of every bucket's share in the target and
in the corpus scores a document in one gather.  CRC-32 is linear, so the checksum of a phrase follows from those of its
words by table lookups on whole arrays, and no phrase is ever written out.

Draw: with Gumbel noise added to the weights, the highest scores are a sample without replacement.  All eligible rows are
sorted by (score descending, doc_id ascending) by least-significant-digit radix passes.  A pass counts digits per part
of the current order, prefix sums over (digit, part) give each count its global offset, and a row's destination is the
offset plus its place among equal digits of its part: a stable counting sort.  Parts are cut by position, so they are equally
large whatever the keys; after the last pass a row's position is its rank.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keytempo.llm import common
from keytempo.llm.common import stored, table

BUCKETS, LONGEST = 10_000, 3
#: Bits of a digit, and rows of a part.
DIGIT, PART = 16, 1 << 20

# Words are runs of digits, letters and bytes above 0x7F; A-Z are lower-cased.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


# checksums -------------------------------------------------------------------------------------------------------


def crc_table() -> np.ndarray:
    """The register after one byte, for the reflected polynomial 0xEDB88320."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1).astype(np.uint32)
    return state


_BYTE = crc_table()


def _linear(images: np.ndarray) -> np.ndarray:
    """Tables by byte of the linear map with these images of the 32 unit vectors."""
    out = np.zeros((4, 256), np.uint32)
    for k in range(32):
        values = np.arange(256)
        out[k // 8][(values >> (k % 8)) & 1 == 1] ^= images[k]
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def _zero_tables() -> np.ndarray:
    """[k, d]: the map that appends d * 64**k zero bytes to a checksum's text."""
    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = _linear(_BYTE[units & 255] ^ (units >> 8))
    out = np.zeros((6, 64, 4, 256), np.uint32)
    for k in range(6):
        images = units
        for d in range(64):
            out[k, d] = _linear(images)
            images = _apply(step, images)
        step = _linear(images)
    return out


_ZEROS = _zero_tables()


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The checksums moved past that many bytes: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    for k in range(len(_ZEROS)):
        digit = (zeros >> (6 * k)) & 63
        if k and not digit.any():
            if not (zeros >> (6 * k)).any():
                break
            continue
        t = _ZEROS[k]
        crc = t[digit, 0, crc & 255] ^ t[digit, 1, (crc >> 8) & 255] ^ t[digit, 2, (crc >> 16) & 255] ^ t[digit, 3, crc >> 24]
    return crc


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every data[start:end], byte by byte for all words at once; long words one by one."""
    length = end - start
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(-length, kind="stable")
    long = int(np.searchsorted(-length[order], -64, "left"))
    for i in order[:long]:
        out[i] = zlib.crc32(data[start[i]:end[i]])
    order = order[long:]
    if len(order):
        state, first, size = np.full(len(order), 0xFFFFFFFF, np.uint32), start[order], length[order]
        alive = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")
        for j, n in enumerate(alive.tolist()):
            now = state[:n]
            state[:n] = _BYTE[(now ^ data[first[:n] + j]) & 255] ^ (now >> 8)
        out[order] = ~state
    return out


_SPACE = np.uint32(zlib.crc32(b" "))


# features ----------------------------------------------------------------------------------------------------------


class Words(NamedTuple):
    doc: np.ndarray
    crc: np.ndarray
    length: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of some documents (bytes and offsets), by document."""
    data = _LOWER[data]
    edge = np.ones(len(data) + 1, bool)
    edge[:-1] = _GAP[data]
    word = ~edge[:-1]
    heads = np.zeros(len(data) + 1, bool)
    heads[offsets] = True
    first = word & (heads[:-1] | np.concatenate(([True], edge[:-2])))
    last = word & (heads[1:] | edge[1:])
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    return Words(doc, checksums(data, start, end), end - start)


def features_of(words: Words, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of all runs of 1 to LONGEST words that end after the first ``known`` words."""
    docs, buckets = [], []
    run = words.crc
    for n in range(1, LONGEST + 1):
        if n > 1:
            run = shifted(_apply(_ZEROS[0, 1], run[:-1]) ^ _SPACE, words.length[n - 1:]) ^ words.crc[n - 1:]
        ends = words.doc[n - 1:]
        keep = words.doc[:len(ends)] == ends
        keep[:max(known - n + 1, 0)] = False
        docs.append(ends[keep])
        buckets.append(run[keep] % np.uint32(BUCKETS))
        if not len(ends):
            break
    return np.concatenate(docs), np.concatenate(buckets).astype(np.int64)


def _parts(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A document in stretches of about ``most`` bytes, cut where no word is."""
    at = 0
    while at < len(data):
        end = at + most
        while end < len(data):
            gaps = np.flatnonzero(_GAP[_LOWER[data[end:end + most]]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += most
        yield data[at:min(end, len(data))]
        at = end


def scanned(batches, most: int = common.SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, row, words of the row or 0, bucket) in slices: per slice, arrays of documents' word counts and of features.

    A long document is taken in stretches; its last words are carried, so runs across a cut are found.
    """
    for batch in batches:
        for rows, data, offsets in common.text_slices(pa.array(np.arange(batch.num_rows)), batch.column("text"), most):
            if len(rows) > 1 or len(data) <= most:
                words = words_of(data, offsets)
                doc, bucket = features_of(words)
                yield batch, rows, np.bincount(words.doc, minlength=len(rows)), np.stack((doc, bucket))
                continue
            carried = Words(*(np.zeros(0, t) for t in (np.int64, np.uint32, np.int64)))
            for stretch in _parts(data, most):
                new = words_of(stretch, np.array([0, len(stretch)]))
                joined = Words(*(np.concatenate(pair) for pair in zip(carried, new, strict=True)))
                doc, bucket = features_of(joined, len(carried.doc))
                yield batch, rows, np.array([len(new.doc)]), np.stack((doc, bucket))
                carried = Words(*(a[-(LONGEST - 1):] for a in joined))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features per bucket over the whole table (text); BUCKETS rows reach the driver."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, _, _, (_, bucket) in scanned(batches):
            total += np.bincount(bucket, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) of each bucket."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all)))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 times a Gumbel variable) that depends on the seed and the id only."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row of ``docs`` (doc_id, text)."""
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches):
        def finish(batch, words, found, weight):
            ids = batch.column("doc_id")
            score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            return pa.RecordBatch.from_arrays([ids, *map(pa.array, (words, found, weight, score))], names=names)

        last = None
        for batch, rows, words, (doc, bucket) in scanned(batches):
            if batch is not last:
                if last is not None:
                    yield finish(last, *sums)
                last, sums = batch, [np.zeros(batch.num_rows, np.int64) for _ in range(3)]
            sums[0][rows] += words
            sums[1][rows] += np.bincount(doc, minlength=len(rows))
            np.add.at(sums[2], rows[doc], gain[bucket])
        if last is not None:
            yield finish(last, *sums)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


# radix sort ----------------------------------------------------------------------------------------------------------


def digits_of(rows: DataFrame, keys: list[tuple[str, bool]]) -> list[Column]:
    """Digits of the composite key from the least significant one.  ``keys``: (long column, descending) from the most
    significant one; nulls come first.  Digits that are equal in all rows are left out."""
    asked = [f(c) for c, _ in keys for f in (F.min, F.max, lambda x: F.count(F.lit(1)) - F.count(x))]
    seen = rows.agg(*[a.alias(f"v{i}") for i, a in enumerate(asked)]).first()
    out: list[Column] = []
    for i, (c, descending) in reversed(list(enumerate(keys))):
        low, high, nulls = seen[3 * i:3 * i + 3]
        if low is not None:
            if high - low < 1 << 63:
                place, bits = (F.lit(high) - F.col(c)) if descending else (F.col(c) - F.lit(low)), (high - low).bit_length()
            else:  # the sign bit turned over gives the order of unsigned numbers
                place, bits = F.col(c).bitwiseXOR(F.lit((1 << 63) - 1 if descending else -(1 << 63))), 64
            place = F.coalesce(place, F.lit(0))
            out += [F.shiftrightunsigned(place, k).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int") for k in range(0, bits, DIGIT)]
        if nulls and low is not None:
            out.append(F.col(c).isNotNull().cast("int"))
    return out


def radix_sorted(rows: DataFrame, keys: list[tuple[str, bool]], into: str, part: int = PART) -> DataFrame:
    """Adds ``into``: the place of each row, from 0, in the order of the keys; rows equal in all keys keep their order.

    One pass per digit.  A pass reads its rows twice: once for the counts, once to place them.  Counts have a row per digit
    value and part, at most as many as rows; sums over them run per digit value (a row per part) and over the 2**DIGIT values.
    """
    rows = stored(rows.withColumn("_pos", F.monotonically_increasing_id()), "radix-start")
    digits = digits_of(rows, keys)
    # Even without a digit one pass turns the first positions into places without gaps.
    for k, digit in enumerate(digits or [F.lit(0)]):
        here = rows.withColumn("_part", F.expr(f"_pos div {part}")).withColumn("_digit", digit)
        counts = here.groupBy("_digit", "_part").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)  # 2**DIGIT rows at most
        values = counts.groupBy(F.col("_digit").alias("_v")).agg(F.sum("_n").alias("_all")).select(
            "_v", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_less"))
        inside = Window.partitionBy("_digit").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
        offsets = (counts.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
                   .join(F.broadcast(values), F.col("_digit") == F.col("_v"))
                   .select(F.col("_digit").alias("_d"), F.col("_part").alias("_p"), (F.col("_less") + F.col("_before")).alias("_offset")))
        place = F.row_number().over(Window.partitionBy("_part", "_digit").orderBy("_pos"))
        rows = stored(here.withColumn("_place", place)
                      .join(offsets, (F.col("_part") == F.col("_p")) & (F.col("_digit") == F.col("_d")))
                      .withColumn("_pos", F.col("_offset") + F.col("_place") - 1)
                      .drop("_part", "_digit", "_place", "_d", "_p", "_offset"), f"radix-pass{k}")
    return rows.withColumnRenamed("_pos", into)


# resampling ------------------------------------------------------------------------------------------------------------


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text).

    The features of ``target`` (text) are the distribution to come near to.  Of the rows with ``least_words`` words or more,
    ``percent`` of 100 (rounded down) are drawn: the highest scores, ties to the smaller doc_id; rank counts them from 1 and is
    null elsewhere.  Null and empty texts have no words, no features and weight 0; a null doc_id is smaller than any number and
    takes the noise of an empty id; rows equal in score and doc_id keep the order in which they were read, each with a rank of
    its own.  Empty tables give an empty result, an empty target a flat distribution.  Other columns are ignored.  Long texts
    are scanned in stretches of a few MB.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = stored(scored(docs, gain, seed), "resample-scored")
    eligible = rows.where(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    ranked = radix_sorted(eligible, [("score", True), ("doc_id", False)], "_place")
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1).cast("long")
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).drop("_place").unionByName(rest)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")
