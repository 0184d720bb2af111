"""Exact repeats of 50 bytes by suffix arrays.

Building one suffix array over all texts is not a cluster job, so places that can hold a repeat are brought together first.
Of any 50 bytes the least hash of its 20-byte strings (the leftmost such string) is its anchor; equal strings have equal
anchors.  Anchors found in several texts give contexts, the bytes that 50-byte strings with this anchor can cover.  The
contexts of an anchor, equal ones folded, form a small text whose suffix array (see lyndon) puts equal 50-byte strings next to
one another; a string goes where the smallest document with it is another one.

Strings are taken by the part of the possible places around the anchor that they start in, as those of a part share more bytes
than the anchor, which are their key: contexts that agree in the anchor only aren't sorted.  A key with many different
contexts, such as one at the edge of a very common passage, is split again by halves of its places until groups are small.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo.llm import common, repeats
from keytempo.llm.block_dedup import EMPTY
from keytempo.llm.common import stored, table
from keytempo.llm.lyndon import suffix_order

RUN, GRAM = 50, 20
SPREAD = RUN - GRAM + 1
#: Parts that the places of a string around its anchor are taken in at first, and different contexts sorted together.
PARTS, TOGETHER = 4, 4
#: Contexts per bucket and per flush, about; bytes sorted at once.
BUCKET, FLUSH, SORTED = 120_000, 100_000, 1 << 20
_VALUES = common.byte_values(31)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, place and hash of the anchors of all 50-byte strings of a slice of texts."""
    none = np.zeros(0, np.int64)
    size = np.diff(offsets)
    if len(data) < RUN or not (size >= RUN).any():
        return none, none, none.astype(np.uint64)
    places = len(data) - GRAM + 1
    # One place after another: the start factor of a rolling difference is taken off at once.
    prefix = common.sums(_VALUES[data])
    hashes = common.mix((prefix[GRAM:] - prefix[:-GRAM]) * common.powers(places)[1])
    bits = np.uint64(max(1, int(places).bit_length()))
    least = ((hashes >> bits) << bits) | np.arange(places, dtype=np.uint64)
    for shift in (1, 2, 4, 8, SPREAD - 16):
        least = np.minimum(least[:-shift], least[shift:])
    start = common.concat_ranges(offsets[:-1], np.maximum(size - RUN + 1, 0))
    found = least[start]
    found = found[np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))]
    at = np.unique((found & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))
    return np.searchsorted(offsets, at, "right") - 1, at, hashes[at]


def anchor_keys(data: np.ndarray, offsets: np.ndarray):
    doc, _, key = anchors(data, offsets)
    return doc, key, np.ones(len(doc), bool)


class Hashes:
    """Hashes of parts of contexts: prefix sums in one row per context, made some thousand rows at a time."""

    def __init__(self, flat, begin, length):
        width = int(length.max()) if len(length) else 0
        up, self.down = common.powers(width + 1)
        self.sums = np.zeros((len(begin), width + 1), np.uint64)
        for k in range(0, len(begin), 20_000):
            n = length[k:k + 20_000]
            some = self.sums[k:k + 20_000]
            at = common.concat_ranges(np.arange(len(n)) * (width + 1) + 1, n)
            some.reshape(-1)[at] = _VALUES[flat[common.concat_ranges(begin[k:k + 20_000], n)]]
            some[:, 1:] *= up[None, :width]
            np.cumsum(some, axis=1, out=some)

    def __call__(self, which, start, end):
        return common.mix((self.sums[which, end] - self.sums[which, start]) * self.down[start])


def fold(key: np.ndarray, content: np.ndarray, shape: np.ndarray, did: np.ndarray):
    """Equal contexts of a key: order, first of each kind in it, kind of each, and whether a smaller did has the same."""
    order = np.lexsort((did, shape, content, key))
    k, c, s, d = key[order], content[order], shape[order], did[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (s[1:] != s[:-1])
    first = np.flatnonzero(new)
    kind = np.cumsum(new) - 1
    return order, first, kind, d > d[first][kind]


def sort_lanes(flat, begin, length, lane, did):
    """Suffix arrays of contexts grouped in lanes (ascending).  (context, offset) of the 50-byte strings that a context of the
    same lane with a smaller did holds."""
    out_c, out_s = [], []
    # Lanes of like length advance together, so they are sorted by length first.
    cut = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
    members = np.diff(np.append(cut, len(lane)))
    by = np.argsort(np.add.reduceat(length + 1, cut), kind="stable")
    moved = common.concat_ranges(cut[by], members[by])
    begin, length, did, lane = begin[moved], length[moved], did[moved], np.repeat(np.arange(len(cut)), members[by])
    ends = np.concatenate([[0], np.cumsum(members[by])])
    cut = ends[:-1]
    room = np.cumsum(length + 1)
    at = 0
    while at < len(cut):
        have = room[ends[at] - 1] if ends[at] else 0
        to = int(np.searchsorted(room[ends[1:] - 1], have + SORTED, "right"))
        to = max(at + 1, min(to, len(cut)))
        a, b = ends[at], ends[to]
        size = length[a:b] + 1
        stop = np.cumsum(size)
        text = np.ones(stop[-1], np.int16)  # 1 ends a context
        inner = common.concat_ranges(stop - size, size - 1)
        text[inner] = flat[common.concat_ranges(begin[a:b], length[a:b])].astype(np.int16) + 2
        last = ends[at + 1:to + 1] - a - 1
        text[stop[last] - 1] = 0  # and 0 a lane
        limits = np.concatenate([[0], stop[last]])
        order = suffix_order(text, limits)
        context = np.repeat(np.arange(b - a), size)
        offset = np.arange(len(text)) - np.repeat(stop - size, size)
        whole = offset + RUN <= np.repeat(size - 1, size)
        order = order[whole[order]]
        same = np.zeros(len(order), bool)
        group = lane[a:b][context[order]]
        near = np.flatnonzero(group[1:] == group[:-1]) + 1
        for k in range(0, len(near), 1 << 17):  # neighbours in the order with 50 equal bytes
            n = near[k:k + (1 << 17)]
            span = np.arange(RUN)
            same[n] = (text[order[n][:, None] + span] == text[order[n - 1][:, None] + span]).all(1)
        start = np.flatnonzero(~same)
        if len(start):
            d = did[a:b][context[order]]
            least = np.minimum.reduceat(d, start)[np.cumsum(~same) - 1]
            hit = order[d > least]
            out_c.append(moved[context[hit] + a])
            out_s.append(offset[hit])
        at = to
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_c), np.concatenate(out_s)) if out_c else (empty, empty)


def resolve(flat, begin, left, length, anchor, did):
    """(entry, first start, number of starts): the 50-byte strings of contexts that a smaller document holds.

    Entry i is flat[begin[i]:begin[i] + length[i]] with its anchor at ``left[i]``; starts count from the context's begin.
    """
    hashes = Hashes(flat, begin, length)
    entries, starts, counts = [], [], []
    edges = np.linspace(1 - SPREAD, 1, PARTS + 1).astype(int)
    todo = [(np.arange(len(begin)), int(a), int(b) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    while todo:
        which, low, high = todo.pop()
        a = np.maximum(0, left[which] + low)
        e = np.minimum(length[which], left[which] + high + RUN)
        fits = e - a >= RUN
        which, a, e = which[fits], a[fits], e[fits]
        if not len(which):
            continue
        core = common.mix(hashes(which, left[which] + high, left[which] + low + RUN) ^ anchor[which])
        content = hashes(which, a, e)
        order, first, kind, lost = fold(core, content, (left[which] - a) * 256 + (e - a), did[which])
        which, a, e, core = which[order], a[order], e[order], core[order]
        entries.append(which[lost])
        starts.append(a[lost])
        counts.append(e[lost] - a[lost] - RUN + 1)
        # The kinds of each key: one is settled, a few are sorted, many are split.
        key = core[first]
        group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
        many = np.bincount(group)[group]
        keepers = np.flatnonzero(~lost)
        split = many[kind[keepers]] > TOGETHER
        if split.any():
            half = (low + high) // 2
            todo += [(which[keepers[split]], low, half), (which[keepers[split]], half + 1, high)]
        some = np.flatnonzero((many > 1) & (many <= TOGETHER))
        if not len(some):
            continue
        f = first[some]
        context, offset = sort_lanes(flat, begin[which[f]] + a[f], e[f] - a[f], group[some], did[which[f]])
        by = np.lexsort((offset, context))
        context, offset = context[by], offset[by]
        run = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(context) else context
        number = np.diff(np.append(run, len(context)))
        # Every entry of a kind with its smallest did has the same starts.
        of_kind = np.searchsorted(kind[keepers], some[context[run]], "left")
        holders = np.searchsorted(kind[keepers], some[context[run]], "right") - of_kind
        who = keepers[common.concat_ranges(of_kind, holders)]
        entries.append(which[who])
        starts.append(a[who] + np.repeat(offset[run], holders))
        counts.append(np.repeat(number, holders))
    return np.concatenate(entries), np.concatenate(starts), np.concatenate(counts)


def joined(tag, did, start, count) -> np.ndarray:
    """Rows (tag, did, start, count) with overlapping and touching ranges of a text made one."""
    order = np.lexsort((start, did, tag))
    tag, did, start, end = tag[order], did[order], start[order], (start + count)[order]
    if not len(tag):
        return np.zeros((0, 4), np.int64)
    text = np.cumsum(np.concatenate([[True], (tag[1:] != tag[:-1]) | (did[1:] != did[:-1])]))
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(text * step + end) - text * step  # the furthest end so far in this text
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(tag)) - 1
    return np.stack([tag[first], did[first], start[first], reach[last] - start[first]], 1)


def context_rows(texts: DataFrame, buckets: int, places: int) -> DataFrame:
    """Contexts of shared anchors, per bucket of the anchor; what this task's own texts settle goes out as ranges."""
    def offer(batches):
        parts: list = []

        def flush():
            key, left, length, did, tag, start = (np.concatenate([p[i] for p in parts]) for i in range(6))
            flat = np.concatenate([p[6] for p in parts])
            parts.clear()
            begin = np.cumsum(length) - length
            content = Hashes(flat, begin, length)(np.arange(len(begin)), np.zeros_like(length), length)
            order, _, _, lost = fold(key, content, left * 256 + length, did)
            gone, kept = order[lost], np.sort(order[~lost])
            out = [(buckets + shard, rows, None) for shard, rows in repeats.sharded(
                joined(tag[gone], did[gone], start[gone], length[gone] - RUN + 1), buckets)]
            bucket = (key[kept] % np.uint64(buckets)).astype(np.int64)
            again = np.argsort(bucket, kind="stable")
            for g in np.split(again, np.flatnonzero(np.diff(bucket[again])) + 1):
                if len(g):
                    i = kept[g]
                    numbers = np.stack([key[i].view(np.int64), left[i], length[i], did[i], tag[i], start[i]])
                    small = zstandard.ZstdCompressor(level=1).compress
                    out.append((int(bucket[g[0]]), small(numbers.astype(np.int64).tobytes()),
                                small(flat[common.concat_ranges(begin[i], length[i])].tobytes())))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (pa.int32(), pa.binary(), pa.binary()))],
                names=["bucket", "numbers", "bytes"])

        held = 0
        for batch in batches:
            for did, tag, text, hits in zip(*(batch.column(c) for c in ("did", "tag", "text", "places")), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                _, at, key = anchors(data, np.array([0, len(data)]))
                known = np.unique(np.frombuffer(hits.as_buffer(), np.uint64))
                hit = np.isin(repeats.place(key, places), known)
                at, key = at[hit], key[hit]
                for k in range(0, len(at), FLUSH):
                    p = at[k:k + FLUSH]
                    start, end = np.maximum(0, p + GRAM - RUN), np.minimum(len(data), p + RUN)
                    parts.append((key[k:k + FLUSH], p - start, end - start, np.full(len(p), did.as_py()),
                                  np.full(len(p), tag.as_py()), start, data[common.concat_ranges(start, end - start)]))
                    held += len(p)
                    if held >= FLUSH:
                        yield flush()
                        held = 0
        if parts:
            yield flush()

    return texts.mapInArrow(offer, "bucket int, numbers binary, bytes binary")


def settle(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    """The removed ranges of a bucket's contexts."""
    whole = zstandard.ZstdDecompressor().decompress
    numbers = np.concatenate([np.frombuffer(whole(x), np.int64).reshape(6, -1) for x in pdf["numbers"]], 1)
    flat = np.concatenate([np.frombuffer(whole(x), np.uint8) for x in pdf["bytes"]])
    key, left, length, did, tag, start = numbers
    entry, first, count = resolve(flat, np.cumsum(length) - length, left, length, key.view(np.uint64), did)
    return repeats.frame(repeats.sharded(joined(tag[entry], did[entry], start[entry] + first, count), shards))


def covered(ranges: bytes, size: int) -> np.ndarray:
    pairs = np.frombuffer(ranges, np.int64).reshape(-1, 2)
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, pairs[:, 0], 1)
    np.add.at(change, pairs[:, 0] + pairs[:, 1] - 1 + RUN, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text).

    A byte goes if 50 bytes around it also start in a document with a smaller doc_id; judged on the input, on UTF-8 bytes.
    Null, empty and shorter texts lose nothing.  Of rows with equal texts all but those with the smallest doc_id lose
    everything, if they have 50 bytes; rows with the same doc_id don't remove from one another.  A null doc_id counts as larger
    than all others.  An empty table gives an empty result; other columns are ignored.
    """
    rows = repeats.prepared(docs, F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    facts = stored(rows.select("doc_id", "did", "tag", "size", F.sha2(F.col("text").cast("binary"), 256).alias("whole")),
                   "byte-facts")
    long_rows = rows.where(F.col("size") >= RUN)
    total = facts.agg(F.sum("size")).first()[0] or 0
    places = max(16, total // 16 // repeats.BUCKET_KEYS)
    texts = stored(repeats.holders(long_rows, repeats.shared_keys(long_rows, anchor_keys, places)), "byte-texts")
    held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, held // 16 // BUCKET)
    offered = context_rows(texts, buckets, places)
    gone = repeats.merged(repeats.settled(offered, lambda pdf: settle(pdf, buckets), buckets, "numbers"), 2, 4).select(
        F.col("k1").alias("did"), F.col("k0").alias("tag"), F.col("rows").alias("ranges"))

    def cut(batches):
        for batch in batches:
            out = []
            for did, tag, text, ranges in zip(*(batch.column(c) for c in ("did", "tag", "text", "ranges")), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                lost = covered(ranges.as_py(), len(data))
                edges = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum())
                out.append((did.as_py(), tag.as_py(), int(lost.sum()), edges, hashlib.sha256(data[~lost].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["did", "tag", "removed", "spans", "sha"])

    changed = texts.select("did", "tag", "text").join(gone, ["did", "tag"]).mapInArrow(
        cut, "did long, tag long, removed long, spans long, sha string")
    first = facts.groupBy("whole").agg(F.min("did").alias("_least"))
    out = facts.join(first, "whole").join(changed, ["did", "tag"], "left")
    copy = (F.col("did") > F.col("_least")) & (F.col("size") >= RUN)
    whole = lambda all_gone, some: F.when(copy, all_gone).otherwise(some)
    return out.select(
        "doc_id", F.col("size").alias("n_bytes"),
        whole(F.col("size"), F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        whole(F.lit(1), F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        whole(F.lit(EMPTY), F.coalesce("sha", "whole")).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
