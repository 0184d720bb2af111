"""Exact repeats of 50 words by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of ``BLOCK`` = 25 words; each run of 50 words holds a whole block.
All blocks form the index, and every rolling window of 25 words of every text probes it.  A hit shared by two texts is
extended: every run of 50 words around it is hashed (96 bits), the smallest document holding that run is found, and runs that
a smaller document holds are united into maximal repeats, which are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo.llm import common, repeats
from keytempo.llm.common import WORD, stored, table

RUN, BLOCK = 50, 25
_VALUES = common.byte_values(21)
EMPTY = hashlib.sha256(b"").hexdigest()


def windows(words: np.ndarray, first: np.ndarray, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and first word of every window of ``width`` words, in documents of at least ``least`` words."""
    count = np.diff(first)
    many = np.where(count >= max(width, least), count - width + 1, 0)
    return np.repeat(np.arange(len(count)), many), common.concat_ranges(first[:-1], many)


def hashed_words(data: np.ndarray, offsets: np.ndarray):
    start, end, first = common.find_words(data, offsets)
    return common.spans(common.sums(_VALUES[data]), start, end), first, start, end


def probes(data: np.ndarray, offsets: np.ndarray, run: int = RUN, block: int = BLOCK):
    """Every rolling window of a slice of texts; those that are reference blocks are marked."""
    words, first, _, _ = hashed_words(data, offsets)
    doc, at = windows(words, first, block, run)
    key = common.spans(common.sums(words), at, at + block)
    return doc, key, (at - first[doc]) % block == 0


def runs_around(words: np.ndarray, hit: np.ndarray, run: int, block: int) -> np.ndarray:
    """Starts of the runs of ``run`` words of one text that hold a hit block."""
    size = len(words)
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, np.maximum(hit - (run - block), 0), 1)
    np.add.at(change, np.minimum(hit + 1, size), -1)
    starts = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    return starts[starts + run <= size]


def smallest(key: np.ndarray, did: np.ndarray) -> np.ndarray:
    """For each row, whether a row with the same key has a smaller did; key has two columns."""
    order = np.lexsort((did, key[:, 1], key[:, 0]))
    k, d = key[order], did[order]
    begin = np.ones(len(k), bool)
    begin[1:] = (k[1:] != k[:-1]).any(1)
    least = d[np.flatnonzero(begin)][np.cumsum(begin) - 1]
    out = np.zeros(len(k), bool)
    out[order] = d > least
    return out


def run_rows(texts: DataFrame, buckets: int, places: int, run: int, block: int) -> DataFrame:
    """The runs around hits, per bucket of their hash.  Runs that this task saw in a smaller document are settled here."""
    def offer(batches):
        parts: list = []

        def flush():
            key, did, tag, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            lost = smallest(key, did)
            out = [(buckets + shard, rows, None) for shard, rows in
                   repeats.sharded(np.stack([tag[lost], did[lost], at[lost]], 1), buckets)]
            key, did, tag, at = key[~lost], did[~lost], tag[~lost], at[~lost]
            bucket = (key[:, 0] % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((at, tag, did, bucket))
            for g in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(g):
                    lengths = np.flatnonzero(np.concatenate([[True], (did[g][1:] != did[g][:-1]) | (tag[g][1:] != tag[g][:-1])]))
                    head = np.stack([did[g][lengths], tag[g][lengths], np.diff(np.append(lengths, len(g)))], 1)
                    out.append((int(bucket[g[0]]),
                                key[g][:, 0].tobytes() + (key[g][:, 1].astype(np.uint32)).tobytes(),
                                head.astype(np.int64).tobytes() + at[g].astype(np.int64).tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (pa.int32(), pa.binary(), pa.binary()))],
                names=["bucket", "keys", "starts"])

        held = 0
        for batch in batches:
            for did, tag, text, hits in zip(*(batch.column(c) for c in ("did", "tag", "text", "places")), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                words, first, _, _ = hashed_words(data, np.array([0, len(data)]))
                _, at = windows(words, first, block, run)
                key = common.spans(common.sums(words), at, at + block)
                known = np.unique(np.frombuffer(hits.as_buffer(), np.uint64))
                starts = runs_around(words, np.flatnonzero(np.isin(repeats.place(key, places), known)), run, block)
                if len(starts):
                    one = common.spans(common.sums(words), starts, starts + run)
                    two = common.spans(common.sums(common.mix(words)), starts, starts + run) >> np.uint64(32)
                    n = len(starts)
                    parts.append((np.stack([one, two], 1), np.full(n, did.as_py()), np.full(n, tag.as_py()), starts))
                    held += n
                if held >= 1_000_000:
                    yield flush()
                    held = 0
        if parts:
            yield flush()

    return texts.mapInArrow(offer, "bucket int, keys binary, starts binary")


def settle(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Starts of the runs of a bucket that a smaller document holds."""
    keys, dids, tags, ats = [], [], [], []
    for k, s in zip(pdf["keys"], pdf["starts"], strict=True):
        n = len(k) // 12
        keys.append(np.stack([np.frombuffer(k, np.uint64, n), np.frombuffer(k, np.uint32, n, 8 * n).astype(np.uint64)], 1))
        rest = np.frombuffer(s, np.int64)
        head, at = rest[:len(rest) - n].reshape(-1, 3), rest[len(rest) - n:]
        dids.append(np.repeat(head[:, 0], head[:, 2]))
        tags.append(np.repeat(head[:, 1], head[:, 2]))
        ats.append(at)
    key, did, tag, at = (np.concatenate(x) for x in (keys, dids, tags, ats))
    lost = smallest(key, did)
    return repeats.frame(repeats.sharded(np.stack([tag[lost], did[lost], at[lost]], 1), shards))


def remove_repeats(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text).

    A word goes if a run of ``run`` words around it also starts in a document with a smaller doc_id; judged on the input.
    Null texts and texts of fewer words lose nothing.  Of rows with equal texts all but those with the smallest doc_id lose
    everything, if they have ``run`` words; rows with the same doc_id don't remove from one another.  A null doc_id counts as
    larger than all others.  An empty table gives an empty result; other columns are ignored.
    """
    block = run // 2
    rows = repeats.prepared(docs, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))
    kept = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    facts = stored(rows.select("doc_id", "did", "tag", "size", F.sha2(F.col("text").cast("binary"), 256).alias("whole"),
                               F.sha2(kept.cast("binary"), 256).alias("plain")), "run-facts")
    long_rows = rows.where(F.octet_length("text") >= 2 * run - 1)
    total = facts.agg(F.sum("size")).first()[0] or 0
    buckets = max(16, total // repeats.BUCKET_KEYS)
    found = repeats.shared_keys(long_rows, lambda data, offsets: probes(data, offsets, run, block), buckets)
    texts = stored(repeats.holders(long_rows, found), "run-texts")
    offered = run_rows(texts, buckets, buckets, run, block)
    gone = repeats.merged(repeats.settled(offered, lambda pdf: settle(pdf, buckets), buckets, "keys"), 2, 3).select(
        F.col("k1").alias("did"), F.col("k0").alias("tag"), F.col("rows").alias("starts"))

    def cut(batches):
        for batch in batches:
            out = []
            for did, tag, text, starts in zip(*(batch.column(c) for c in ("did", "tag", "text", "starts")), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                begin, end, _ = common.find_words(data, np.array([0, len(data)]))
                at = np.unique(np.frombuffer(starts.as_buffer(), np.int64))
                lost = repeats.ranges_covered(at, run, len(begin))
                raw, digest, first = data.tobytes(), hashlib.sha256(), True
                for b, e in zip(begin[~lost].tolist(), end[~lost].tolist(), strict=True):
                    digest.update(raw[b:e] if first else b" " + raw[b:e])
                    first = False
                out.append((did.as_py(), tag.as_py(), int(lost.sum()), digest.hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["did", "tag", "removed", "sha"])

    changed = texts.select("did", "tag", "text").join(gone, ["did", "tag"]).mapInArrow(
        cut, "did long, tag long, removed long, sha string")
    first = facts.groupBy("whole").agg(F.min("did").alias("_least"))
    out = facts.join(first, "whole").join(changed, ["did", "tag"], "left")
    copy = (F.col("did") > F.col("_least")) & (F.col("size") >= run)
    return out.select(
        "doc_id", F.col("size").alias("n_words"),
        F.when(copy, F.col("size")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("sha", "plain")).alias("kept_sha256"))


def op10_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
