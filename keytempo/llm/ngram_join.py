"""Exact Jaccard join on word shingles with prefix filters under several global token orders.

A document's set is its distinct shingles as 52-bit hashes.  Documents with equal sets are one class.  Two sets with
Jaccard >= t share a token among the first |S| - ceil(t |S|) + 1 of each under *any* global order of the tokens:

* order 1 sorts tokens by the count of their cell in a counting sketch over all documents, so it starts with rare tokens.
  Its prefixes are dealt to buckets by token and give the candidates.
* orders 2 and 3 are two hash orders; candidates must share a prefix token under these too, and may not differ there in more
  tokens than linked sets can, before the sets are compared.

Before any set is fetched, candidates must also agree in a parity sketch of at least half as many bits as the set has tokens: each
token flips one bit, so two sets differ in at least as many tokens as their sketches do in bits.

A token group of more than ``SMALL`` classes gives only pairs with its centre (its smallest class) first.  After these are
verified and joined into components, rounds of nearest pairs join more of them, and a last round takes every pair of classes
that are still in different components, unless sketches or distances to the centre (Jaccard distance is a metric) rule it out.
Every linked pair shares a group, so it is either inside one component already or compared: components are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from keytempo.llm import common
from keytempo.llm.common import columns_of, stored, table
from keytempo.llm.graph import components

#: Bits of a token's hash, and of a cell of the sketch of token counts.
HASH, CELLS, CHUNK = 52, 20, 1 << 14
PARITY = 512  # bits of the smallest sketch
LAST = (1 << 63) - 1
SMALL = 3
#: Rounds of nearest pairs, and classes that a nearest pair is looked for among.
ROUNDS, BLOCK = 2, 1024
#: Prefix tokens per bucket, about; the number of buckets follows the data.
BUCKET_TOKENS = 250_000
_VALUES = common.byte_values(5, lower=True)
_LOW = np.uint64((1 << HASH) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of each distinct shingle, sorted; at most 4,096 documents at once."""
    start, end, first = common.find_words(data, offsets)
    words = common.spans(common.sums(_VALUES[data]), start, end)
    count = np.diff(first)
    whole = np.flatnonzero((count > 0) & (count < n))  # too short: all words as one shingle
    at = common.concat_ranges(first[:-1], np.maximum(count - n + 1, 0))
    rolled = words[at] if len(at) else np.zeros(0, np.uint64)
    for j in range(1, n):
        rolled = rolled * np.uint64(common.BASE) + words[at + j] if len(at) else rolled
    hashes = [common.mix(rolled)]
    docs = [np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))]
    for d in whole.tolist():
        h = np.uint64(first[d + 1] - first[d])
        for w in words[first[d]:first[d + 1]]:
            h = np.uint64((int(h) * common.BASE + int(w)) & 0xFFFFFFFFFFFFFFFF)
        hashes.append(common.mix(np.array([h], np.uint64)))
        docs.append(np.array([d]))
    key = (np.concatenate(docs).astype(np.uint64) << np.uint64(HASH)) | (np.concatenate(hashes) & _LOW)
    key = np.unique(key)
    return (key >> np.uint64(HASH)).astype(np.int64), key & _LOW


def fingerprints(doc: np.ndarray, token: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and a 63-bit fingerprint of each set; -1 for the empty set."""
    size = np.bincount(doc, minlength=docs)
    mixed = common.mix(token + np.uint64(99))
    ends = np.cumsum(size)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    total = common.mix(run[ends] - run[ends - size] + size.astype(np.uint64))
    return size, np.where(size > 0, (total >> np.uint64(1)).astype(np.int64), -1)


def prefix_length(size: np.ndarray, percent: int) -> np.ndarray:
    return size - (percent * size + 99) // 100 + 1


def first_of(doc: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Places of the prefix tokens of sets that stand one after the other."""
    size = size[size > 0]
    begin = np.cumsum(size) - size
    return common.concat_ranges(begin, prefix_length(size, percent))


def parities(doc: np.ndarray, token: np.ndarray, docs: int) -> list[bytes]:
    """A sketch per document; its width is a power of two, at least PARITY and half the size of the set."""
    size = np.bincount(doc, minlength=docs)
    width = np.maximum(PARITY, 1 << np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) >> 1)
    end = np.cumsum(width)
    bit = (common.mix(token + np.uint64(7)) & (width[doc] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount((end - width)[doc] + bit, minlength=int(end[-1])) & 1
    packed = np.packbits(odd.astype(np.uint8))
    return [packed[e - w:e].tobytes() for e, w in zip(end // 8, width // 8, strict=True)]


def at_width(sketch: bytes, width: int) -> np.ndarray:
    """A sketch folded to a smaller width."""
    bits = np.frombuffer(sketch, np.uint64)
    while len(bits) * 8 > width:
        bits = bits[:len(bits) // 2] ^ bits[len(bits) // 2:]
    return bits


def allowed(size_x, size_y, percent: int):
    """Tokens in which linked sets of these sizes may differ."""
    total = size_x + size_y
    return total - 2 * -(-percent * total // (100 + percent))


def scan(docs: DataFrame, n: int) -> DataFrame:
    """Per document its set's size and fingerprint; per task one row with the sketch of its token counts."""
    def run(batches):
        cells = np.zeros(1 << CELLS, np.int32)
        for batch in batches:
            at = 0
            for ids, data, offsets in common.text_slices(batch.column(0), batch.column(1)):
                doc, token = shingle_sets(data, offsets, n)
                size, fp = fingerprints(doc, token, len(ids))
                cells += np.bincount((token >> np.uint64(HASH - CELLS)).astype(np.int64), minlength=1 << CELLS).astype(np.int32)
                some = batch.slice(at, len(ids))
                at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("tag"), pa.array(size.astype(np.int64)), pa.array(fp),
                     pa.array(parities(doc, token, len(ids)), pa.binary()), pa.nulls(len(ids), pa.int32()),
                     pa.nulls(len(ids), pa.binary())], names=names)
        parts = [c.tobytes() for c in np.split(cells, len(cells) // CHUNK)] if cells.any() else []
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(parts), kind), *[pa.nulls(len(parts), pa.int64())] * 3, pa.nulls(len(parts), pa.binary()), pa.array(range(len(parts)), pa.int32()),
             pa.array(parts, pa.binary())], names=names)

    names = ["doc_id", "tag", "n", "fp", "sketch", "chunk", "cells"]
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    name = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(F.lit(0).alias("i"), "text", "doc_id", F.xxhash64("text").alias("tag")).mapInArrow(
        run, f"doc_id {name}, tag long, n long, fp long, sketch binary, chunk int, cells binary")


def rarity(scanned: DataFrame) -> np.ndarray:
    """A level 0..63 per cell of the sketch (1,048,576 in all): its count in standard deviations from the median."""
    def total(kind):
        return lambda pdf: pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "cells": [
            np.sum([np.frombuffer(c, kind) for c in pdf["cells"]], axis=0, dtype=np.int64).tobytes()]})

    rows = scanned.where("cells is not null").select("chunk", "cells", F.pmod(F.xxhash64("cells"), F.lit(256)).alias("g"))
    rows = rows.groupBy("chunk", "g").applyInPandas(total(np.int32), "chunk int, cells binary")  # never all tasks in one group
    rows = rows.groupBy("chunk").applyInPandas(total(np.int64), "chunk int, cells binary")
    count = np.zeros((1 << CELLS) // CHUNK * CHUNK)
    for r in rows.collect():
        count[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.frombuffer(r.cells, np.int64)
    middle = np.median(count)
    z = (count - middle) / max(1.0, np.sqrt(middle))
    return np.where(z < 4, np.clip((z + 3) * 6, 0, 42), np.minimum(63, 41 + np.log2(np.maximum(z, 4)) / 2)).astype(np.uint8)


def prefixes(docs: DataFrame, levels: np.ndarray, n: int, percent: int, buckets: int) -> DataFrame:
    """Prefix tokens under order 1 as packed arrays per bucket; per task a class is given once."""
    def run(batches):
        seen: set = set()
        parts: list = []

        def flush():
            if not parts:
                return None
            token, fp, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            parts.clear()
            bucket = (token % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order])) + 1
            groups = np.split(order, cut)
            return pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[g[0]]) for g in groups], pa.int32()),
                 *[pa.array([x[g].tobytes() for g in groups], pa.binary()) for x in (token, fp, size)]],
                names=["bucket", "tokens", "fps", "sizes"])

        held = 0
        for batch in batches:
            for ids, data, offsets in common.text_slices(batch.column(0), batch.column(1)):
                doc, token = shingle_sets(data, offsets, n)
                size, fp = fingerprints(doc, token, len(ids))
                new = np.zeros(len(ids), bool)
                for i, f in enumerate(fp.tolist()):
                    if f >= 0 and f not in seen:
                        seen.add(f)
                        new[i] = True
                keep = new[doc]
                doc, token = doc[keep], token[keep]
                key = np.sort((doc.astype(np.uint64) << np.uint64(52))
                              | (levels[(token >> np.uint64(HASH - CELLS)).astype(np.int64)].astype(np.uint64) << np.uint64(46))
                              | (token >> np.uint64(6)))
                at = first_of(doc, np.bincount(doc, minlength=len(ids)), percent)
                owner = (key[at] >> np.uint64(52)).astype(np.int64)
                parts.append((key[at] & np.uint64((1 << 46) - 1), fp[owner], size[owner].astype(np.int32)))
                held += len(at)
                if held > 1_000_000:
                    yield flush()
                    held = 0
        if (last := flush()) is not None:
            yield last

    return docs.select(F.lit(0).alias("i"), "text").mapInArrow(
        run, "bucket int, tokens binary, fps binary, sizes binary")


def unpack(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column])


def close_in_size(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def candidates_of(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs of a bucket's small groups and of members with the centre; larger groups as records for the second round."""
    token, fp, size = unpack(pdf["tokens"], np.uint64), unpack(pdf["fps"], np.int64), unpack(pdf["sizes"], np.int32)
    order = np.lexsort((fp, token))
    token, fp, size = token[order], fp[order], size[order].astype(np.int64)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])
    token, fp, size = token[new], fp[new], size[new]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(token)))
    pairs = []
    begin, count = begin[count > 1], count[count > 1]
    centre = np.repeat(begin, count - 1)
    other = common.concat_ranges(begin + 1, count - 1)
    pairs.append(np.stack([centre, other]))
    for b in begin[count == 3]:
        pairs.append(np.array([[b + 1], [b + 2]]))
    i, j = np.concatenate(pairs, 1)
    ok = close_in_size(size[i], size[j], percent)
    both = np.unique(np.stack([fp[i[ok]], fp[j[ok]]], 1), axis=0)
    out = [pd.DataFrame({"a": both[:, 0], "b": both[:, 1], "fps": None, "sizes": None})]
    large: dict[bytes, bytes] = {}  # equal groups of several tokens once
    for b, c in zip(begin.tolist(), count.tolist(), strict=True):
        if c > SMALL:
            large[fp[b:b + c].tobytes()] = size[b:b + c].tobytes()
    out.append(pd.DataFrame({"a": -1, "b": -1, "fps": list(large), "sizes": list(large.values())}))
    return pd.concat(out, ignore_index=True)


def set_table(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n: int, percent: int) -> DataFrame:
    """(fp, n, low, mixed, tokens) of the wanted classes: prefixes under orders 2 and 3, and all tokens sorted."""
    def run(batches):
        for batch in batches:
            for ids, data, offsets in common.text_slices(batch.column(0), batch.column(1)):
                doc, token = shingle_sets(data, offsets, n)
                size, fp = fingerprints(doc, token, len(ids))
                ends = np.cumsum(size)
                sets = [token[e - s:e] for s, e in zip(size, ends, strict=True)]
                first = [max(0, int(k)) for k in prefix_length(size, percent)]
                mixed = [np.sort(common.mix(t))[:k] for t, k in zip(sets, first, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp), pa.array(size.astype(np.int64)),
                     pa.array([t[:k].tobytes() for t, k in zip(sets, first, strict=True)], pa.binary()),
                     pa.array([t.tobytes() for t in mixed], pa.binary()), pa.array([t.tobytes() for t in sets], pa.binary())],
                    names=["fp", "n", "low", "mixed", "tokens"])

    one = classes.join(wanted, "fp").select(F.col("one").alias("_doc"))
    some = docs.select("doc_id", "text").join(one, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    return (some.select(F.lit(0).alias("i"), "text")
            .mapInArrow(run, "fp long, n long, low binary, mixed binary, tokens binary")
            .join(wanted, "fp", "left_semi").dropDuplicates(["fp"]))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def agree(x: np.ndarray, y: np.ndarray, size_x: int, size_y: int, percent: int) -> bool:
    """Whether two prefixes under one order leave it open that the sets are linked.

    Up to the smaller of the prefixes' last tokens both are complete, so a token of one that the other lacks there is missing
    from the other's set.  Linked sets share at least ``need`` tokens.
    """
    common_ = shared(x, y)
    need = -(-percent * (size_x + size_y) // (100 + percent))
    end = min(x[-1], y[-1])
    return (common_ > 0 and np.searchsorted(x, end, "right") - common_ <= size_x - need
            and np.searchsorted(y, end, "right") - common_ <= size_y - need)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, both, size_a, size_b, linked) of the pairs that pass the filters of orders 2 and 3."""
    def sides(rows, *columns):
        for c, other in (("a", "x"), ("b", "y")):
            rows = rows.join(sets.select(F.col("fp").alias(c), *[F.col(k).alias(f"{k}_{other}") for k in columns]), c)
        return rows

    def numbers(column):
        return [np.frombuffer(v.as_buffer(), np.uint64) for v in column]

    def filtered(batches):
        for batch in batches:
            names = ("low_x", "low_y", "mixed_x", "mixed_y")
            sizes = [batch.column(c).to_numpy() for c in ("n_x", "n_y")]
            keep = [agree(x, y, int(m), int(k), percent) and agree(p, q, int(m), int(k), percent)
                    for x, y, p, q, m, k in zip(*(numbers(batch.column(c)) for c in names), *sizes, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def compared(batches):
        for batch in batches:
            x, y = numbers(batch.column("tokens_x")), numbers(batch.column("tokens_y"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array([shared(s, t) for s, t in zip(x, y, strict=True)], pa.int64()),
                 pa.array([len(s) for s in x], pa.int64()), pa.array([len(s) for s in y], pa.int64())],
                names=["a", "b", "both", "size_a", "size_b"])

    left = sides(pairs, "n", "low", "mixed").select("a", "b", "n_x", "n_y", "low_x", "low_y", "mixed_x", "mixed_y")
    left = left.mapInArrow(filtered, "a long, b long")
    done = sides(left, "tokens").select("a", "b", "tokens_x", "tokens_y").mapInArrow(
        compared, "a long, b long, both long, size_a long, size_b long")
    return done.withColumn("linked", F.col("both") * 100 >= percent * (F.col("size_a") + F.col("size_b") - F.col("both")))


def sketched(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parity sketches leave it open that they are linked."""
    def run(batches):
        for batch in batches:
            most = allowed(*(batch.column(c).to_numpy() for c in ("n_x", "n_y")), percent)
            keep = []
            for x, y, k in zip(*(batch.column(c).to_pylist() for c in ("sketch_x", "sketch_y")), most, strict=True):
                width = min(len(x), len(y))
                keep.append(np.bitwise_count(at_width(x, width) ^ at_width(y, width)).sum(dtype=np.int64) <= k)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs
    for c, other in (("a", "x"), ("b", "y")):
        rows = rows.join(classes.select(F.col("fp").alias(c), F.col("n").alias(f"n_{other}"),
                                        F.col("sketch").alias(f"sketch_{other}")), c)
    return rows.select("a", "b", "n_x", "n_y", "sketch_x", "sketch_y").mapInArrow(run, "a long, b long")


def open_pairs(pdf: pd.DataFrame, percent: int, nearest: bool) -> pd.DataFrame:
    """Pairs of a group's classes in different components that neither sketches nor distances to the centre rule out.

    With ``nearest`` one for each class, the nearest by sketch among BLOCK classes, else all.
    """
    fp, size, root = (pdf[c].to_numpy() for c in ("fp", "size", "root"))
    distance = pdf["distance"].to_numpy(float)  # NaN: not known
    out, limit = [], 1 - percent / 100
    order = np.lexsort((fp, root))
    fp, size, root, distance = fp[order], size[order], root[order], distance[order]
    sketch = [pdf["sketch"].iloc[i] for i in order]
    width = np.array([len(x) for x in sketch])
    # Sketches stacked by width; sizes close enough to link are at most one power of two apart.
    stacks, row = {}, {}
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for v in (w, w // 2):
            if v * 8 >= PARITY:
                stacks.setdefault(v, []).append(np.stack([at_width(sketch[i], v) for i in at]))
                row.setdefault(v, []).append(at)
    for v in stacks:
        where = np.full(len(fp), -1)
        where[np.concatenate(row[v])] = np.arange(sum(map(len, row[v])))
        stacks[v], row[v] = np.concatenate(stacks[v]), where
    block = np.argsort(np.argsort(fp)) // BLOCK
    for i in range(len(fp)):
        if nearest:
            j = np.flatnonzero((root != root[i]) & (block == block[i]))
        else:
            j = np.arange(np.searchsorted(root, root[i], "right"), len(fp))
        j = j[close_in_size(size[j], size[i], percent) & ~(np.abs(distance[j] - distance[i]) > limit + 1e-9)]
        differ = np.zeros(len(j), np.int64)
        for v in np.unique(np.minimum(width[j], width[i])):
            some = np.flatnonzero(np.minimum(width[j], width[i]) == v)
            differ[some] = np.bitwise_count(stacks[v][row[v][j[some]]] ^ stacks[v][row[v][i]]).sum(1, dtype=np.int64)
        open_ = differ <= allowed(size[j], size[i], percent)
        j, differ = j[open_], differ[open_]
        if nearest and len(j):
            j = j[[np.argmin(differ)]]
        out.append(np.stack([np.minimum(fp[i], fp[j]), np.maximum(fp[i], fp[j])], 1))
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def jaccard_classes(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, root (a number for the component) and tag (a hash of the text) for every row of ``docs`` (doc_id, text).

    A-Z count as a-z; a text of fewer than n words is one shingle; a null text or one without words has the empty set
    and links with nothing.  Rows with equal sets always link.  component_id is the smallest doc_id reachable, a null doc_id
    counts as larger than all.  Repeated rows and doc_ids are rows of their own.  An empty table gives an empty result;
    other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    scanned = stored(scan(docs, n), "shingle-sets")
    known = scanned.where("n is not null").drop("chunk", "cells")
    levels = rarity(scanned)
    total = known.agg(F.sum("n")).first()[0] or 0
    buckets = max(32, total * (100 - percent) // 100 // BUCKET_TOKENS)
    found = stored(prefixes(docs, levels, n, percent, buckets).groupBy("bucket").applyInPandas(
        lambda pdf: candidates_of(pdf, percent), "a long, b long, fps binary, sizes binary"), "shingle-candidates")
    classes = stored(known.where("n > 0").groupBy("fp").agg(
        F.min("doc_id").alias("one"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "shingle-classes")
    pairs = stored(sketched(found.where("fps is null").select("a", "b").distinct(), classes, percent), "shingle-pairs")
    groups = stored(found.where("fps is not null").select("fps", "sizes").dropDuplicates(["fps"]), "shingle-groups")
    ends = lambda p: p.select(F.col("a").alias("fp")).unionByName(p.select(F.col("b").alias("fp"))).distinct()
    sets = stored(set_table(docs, classes, ends(pairs), n, percent), "shingle-tokens")
    tested = stored(verified(pairs, sets, percent), "shingle-links")
    links = tested.where("linked").select("a", "b")
    roots = components(links)

    members = groups.select(F.xxhash64("fps").alias("g"), "fps", "sizes").mapInPandas(_members, "g long, centre long, fp long, size long")
    away = tested.select(
        F.col("a").alias("centre"), F.col("b").alias("fp"),
        (1 - F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))).alias("distance"))
    members = stored(members.join(classes.select("fp", "sketch"), "fp").join(away, ["centre", "fp"], "left")
                     .withColumn("distance", F.when(F.col("fp") == F.col("centre"), 0.0).otherwise(F.col("distance"))),
                     "shingle-members")
    done = pairs

    def still_open(nearest):
        placed = members.join(roots, members["fp"] == roots["node"], "left").drop("node").withColumn(
            "root", F.coalesce("root", "fp"))
        mixed = placed.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("g")
        return stored(placed.join(mixed, "g").groupBy("g").applyInPandas(
            lambda pdf: open_pairs(pdf, percent, nearest), "a long, b long").distinct().join(
            done, ["a", "b"], "left_anti"), "shingle-pairs")

    # Nearest pairs first, as long as they join components, so that few pairs are left for the last, complete round.
    for nearest in [True] * ROUNDS + [False]:
        more = still_open(nearest)
        if more.isEmpty():
            continue
        lacking = stored(ends(more).join(sets.select("fp"), "fp", "left_anti"), "shingle-ends")
        if not lacking.isEmpty():
            sets = sets.unionByName(stored(set_table(docs, classes, lacking, n, percent), "shingle-tokens"))
        late = stored(verified(more, sets, percent).where("linked").select("a", "b"), "shingle-links")
        done = done.unionByName(more)
        if not late.isEmpty():
            links = links.unionByName(late)
            roots = components(links)

    named = known.join(roots, known["fp"] == roots["node"], "left").select(
        "doc_id", "tag", F.col("n").alias("n_shingles"), F.coalesce("root", "fp").alias("root"))
    smallest = named.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("_least"))
    return named.join(smallest, "root", "left").select(
        "doc_id", "n_shingles", "root", "tag",
        F.when(F.col("n_shingles") > 0, F.coalesce("_least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest doc_id stays, of rows that
    agree in doc_id and text one.  Texts without words stay.  All columns are kept."""
    rows = jaccard_classes(docs, n, percent).withColumn("_did", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    best = (rows.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("_did", "tag")).alias("x"))
            .select("x._did", F.col("x.tag").alias("_tag")))
    stay = best.unionByName(rows.where("n_shingles = 0").select("_did", F.col("tag").alias("_tag")))
    # The row travels whole, so its column names can't clash with those used here.
    marked = docs.select(F.struct(*columns_of(docs)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
                         .alias("_did"), F.xxhash64("text").alias("_tag"))
    return marked.join(stay, ["_did", "_tag"], "left_semi").dropDuplicates(["_did", "_tag"]).select("row.*")


def _members(batches):
    for pdf in batches:
        for g, fps, sizes in zip(pdf["g"], pdf["fps"], pdf["sizes"], strict=True):
            fp, size = np.frombuffer(fps, np.int64), np.frombuffer(sizes, np.int64)
            yield pd.DataFrame({"g": g, "centre": fp[0], "fp": fp, "size": size})


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
