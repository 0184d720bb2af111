"""What the two removers of exact repeats share: classes of equal texts, and the search for keys that several texts hold.

Equal texts are folded first: only the class of a text, named by a hash, takes part in the search.  A task offers the keys of
its texts; of each key that several of its texts hold it keeps only one holder, as the others are known to share it.  So
a key reaches its bucket once per task however many rows hold it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytempo.llm import common

#: Bits of a key kept inside a bucket (with the flag 5 bytes), and keys per bucket, about.
KEPT = 39
BUCKET_KEYS = 1_500_000
#: Keys a task gathers before it packs them.
FLUSH = 2_000_000
LAST = (1 << 63) - 1


def prepared(docs: DataFrame, size) -> DataFrame:
    """doc_id, text, did (null doc_ids count as largest), tag (a hash of the text) and size."""
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"),
                       F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"),
                       size.alias("size"))


def place(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and kept bits of a key as one number."""
    return ((key % np.uint64(buckets)) << np.uint64(KEPT)) | (key >> np.uint64(64 - KEPT))


def local_keys(where: np.ndarray, owner: np.ndarray, anchor: np.ndarray):
    """Of a task's keys: those held by several owners (all holders), and one holder for each key with its flag."""
    order = np.argsort(where, kind="stable")
    w, o = where[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(w))))
    several = np.zeros(len(begin), bool)
    several[group[1:][(w[1:] == w[:-1]) & (o[1:] != o[:-1])]] = True
    flag = np.logical_or.reduceat(anchor[order], begin)
    first = order[begin]
    return order[several[group]], first, flag, several


def shared_keys(rows: DataFrame, keys_of: Callable, buckets: int) -> DataFrame:
    """(tag, places) of the texts' keys that other texts hold too, if one of the holders offers the key as an anchor.

    ``keys_of(data, offsets)`` gives (document number, key, anchor flag) of a slice of texts, documents in order.  The same
    key may be reported as shared where it isn't, with a probability of about BUCKET_KEYS / 2**KEPT: callers verify.
    """
    def offer(batches):
        seen: set = set()
        parts: list = []

        def flush():
            where, owner, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            if not len(where):
                return []
            known, first, flag, several = local_keys(where, owner, anchor)
            out = []
            out += [(buckets + shard, rows, None, None) for shard, rows in
                    sharded(np.stack([owner[known], where[known].view(np.int64)], 1), buckets)]
            again = np.argsort(first, kind="stable")  # back to the order of documents, so that owners form runs
            first, flag, several = first[again], flag[again], several[again]
            bucket = (where[first] >> np.uint64(KEPT)).astype(np.uint32)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                low = where[first[at]] & np.uint64((1 << KEPT) - 1)
                packed = (low << np.uint64(1)) | (flag[at]).astype(np.uint64)
                own = owner[first[at]]
                run = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                out.append((int(bucket[at[0]]), packed.view(np.uint8).reshape(-1, 8)[:, :5].tobytes(),
                            own[run].tobytes(), np.diff(np.append(run, len(own))).astype(np.uint32).tobytes()))
            return out

        def rows_out(found):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in found], t) for i, t in enumerate(
                    (pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                names=["bucket", "keys", "owners", "runs"])

        held = 0
        for batch in batches:
            for tags, data, offsets in common.text_slices(batch.column(0), batch.column(1)):
                new = np.array([t not in seen and not seen.add(t) for t in tags.tolist()], bool)
                doc, key, anchor = keys_of(data, offsets)
                keep = new[doc]
                parts.append((place(key[keep], buckets), tags[doc[keep]], anchor[keep]))
                held += int(keep.sum())
                if held >= FLUSH:
                    yield rows_out(flush())
                    held = 0
        if parts:
            yield rows_out(flush())

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """The keys of a bucket that several owners hold."""
        bucket = np.uint64(int(pdf["bucket"].iloc[0]))
        keys, owners = [], []
        for k, o, r in zip(pdf["keys"], pdf["owners"], pdf["runs"], strict=True):
            wide = np.zeros((len(k) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(k, np.uint8).reshape(-1, 5)
            keys.append(wide.view(np.uint64).ravel())
            owners.append(np.repeat(np.frombuffer(o, np.int64), np.frombuffer(r, np.uint32)))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key >> np.uint64(1), kind="stable")
        key, owner = key[order], owner[order]
        low = key >> np.uint64(1)
        begin = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        count = np.diff(np.append(begin, len(low)))
        group = np.repeat(np.arange(len(begin)), count)
        several = np.zeros(len(begin), bool)
        several[group[1:][(low[1:] == low[:-1]) & (owner[1:] != owner[:-1])]] = True
        anchored = np.logical_or.reduceat((key & np.uint64(1)).astype(bool), begin)
        hit = (several & anchored)[group]
        where, owner = (bucket << np.uint64(KEPT)) | low[hit], owner[hit]
        return frame(sharded(np.stack([owner, where.view(np.int64)], 1), buckets))

    offered = rows.select("tag", "text").mapInArrow(offer, "bucket int, keys binary, owners binary, runs binary")
    return merged(settled(offered, meet, buckets, "keys"), 1, 2).select(F.col("k0").alias("tag"), F.col("rows").alias("places"))


def sharded(rows: np.ndarray, shards: int) -> list[tuple[int, bytes]]:
    """Rows of numbers, the name of a text (a hash) first, packed by a shard of the texts."""
    shard = (common.mix(rows[:, 0].astype(np.int64).view(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order])) + 1
    return [(int(shard[g[0]]), np.ascontiguousarray(rows[g], np.int64).tobytes()) for g in np.split(order, cut) if len(g)]


def frame(found: list[tuple[int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["shard", "rows"])


def settled(offered: DataFrame, settle: Callable, buckets: int, passing: str) -> DataFrame:
    """(shard, rows) of ``settle`` for each bucket.  What tasks settled on their own stands in buckets from ``buckets`` on and
    leaves through the same stage, so that texts are read once."""
    return offered.groupBy("bucket").applyInPandas(
        lambda pdf: settle(pdf) if pdf["bucket"].iloc[0] < buckets
        else pd.DataFrame({"shard": pdf["bucket"] - buckets, "rows": pdf[passing]}), "shard int, rows binary")


def merged(shards: DataFrame, names: int, width: int) -> DataFrame:
    """One row per text: its name (``names`` numbers k0, k1) and the rest of its rows of ``width`` numbers, packed."""
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(pdf["rows"]), np.int64).reshape(-1, width)
        rows = rows[np.lexsort(rows.T[::-1])]
        key = rows[:, :names]
        begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        ends = np.append(begin[1:], len(rows))
        rest = np.ascontiguousarray(rows[:, names:])
        return pd.DataFrame({**{f"k{i}": key[begin, i] for i in range(names)},
                             "rows": [rest[b:e].tobytes() for b, e in zip(begin, ends, strict=True)]})

    return shards.groupBy("shard").applyInPandas(merge, ", ".join(f"k{i} long" for i in range(names)) + ", rows binary")


def holders(rows: DataFrame, found: DataFrame) -> DataFrame:
    """did, tag, text, places for the smallest did of every text with shared keys."""
    best = rows.groupBy("tag").agg(F.min("did").alias("did"))
    wanted = found.join(best, "tag")
    return (rows.select("did", "tag", "text").join(wanted, ["did", "tag"])
            .dropDuplicates(["did", "tag"]))


def ranges_covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Which of ``size`` places are in [s, s + width) for a start s."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, size), -1)
    return np.cumsum(change[:-1]) > 0
