"""Benchmark decontamination: rare word trigrams seed alignments of documents with test items.

1. The trigrams of the test items are counted over all documents.
2. In every stretch of ``STRETCH`` trigrams of an item the ``KEEP`` rarest that occur become seeds, so an item always has seeds all
   along, also where all its trigrams are frequent.  Of items of up to ``SHORT`` words all that occur are seeds.
3. Where a document has a seed, the item is aligned with the words around it by Smith-Waterman (words as letters).
   A document leaks an item if the alignment's score is ``LEAK`` or more of that of the item with itself, or of a passage of a
   long item.  Passages overlap, so that each run of ``LEAK`` of a passage's words lies whole in one.

Test items are taken in blocks of bounded size; each block goes to all documents in one map, without a shuffle of text.
Words are lower-cased runs of ASCII letters, digits and non-ASCII characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo.llm import common
from keytempo.llm.common import columns_of, numbered, table

N, STRETCH, KEEP = 3, 6, 4
MATCH, MISMATCH, GAP = 2, -1, -1
LEAK = 0.6
#: Items of up to so many words are searched by all their trigrams.
SHORT = 20
#: Words of an item aligned at once; of longer items, passages of this length start every ``STEP`` words.  A run of 60 % of a
#: passage (77 words) lies whole in one of them as STEP <= PASSAGE - 76.
PASSAGE, STEP = 128, 32
#: Test items of a block, and words of it that are aligned.
BLOCK = 10_000
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_VALUES = common.byte_values(11, lower=True)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word, and the first word of each document."""
    clean = np.where(_APART[data], np.uint8(32), data)
    start, end, first = common.find_words(clean, offsets)
    return common.spans(common.sums(_VALUES[data]), start, end), first


def grams(words: np.ndarray) -> np.ndarray:
    if len(words) < N:
        return np.zeros(0, np.uint64)
    out = words[:len(words) - N + 1].copy()
    for j in range(1, N):
        out = out * np.uint64(common.BASE) + words[j:len(words) - N + 1 + j]
    return common.mix(out)


def passages(n: int) -> list[tuple[int, int]]:
    """Start and end of the passages of an item of n words.

    Some of them lie end to end, the last with up to half a passage more: what is a leak of the whole item is one of them.
    The others overlap.
    """
    most = PASSAGE + PASSAGE // 2
    joined = {(k, n if k + most >= n else k + PASSAGE) for k in range(0, max(1, n - PASSAGE // 2), PASSAGE)}
    return sorted(joined | {(k, k + PASSAGE) for k in [*range(0, n - PASSAGE, STEP), n - PASSAGE] if k >= 0})


class Items:
    """A block of test items as passages of word hashes with their trigrams."""

    def __init__(self, rows: list[tuple]):
        self.passages: list[tuple[object, np.ndarray]] = []
        for item, text in rows:
            data = np.frombuffer((text or "").lower().encode(), np.uint8)
            words, _ = word_hashes(data, np.array([0, len(data)]))
            for start, end in passages(len(words)):
                if end - start >= N:
                    self.passages.append((item, words[start:end]))
        self.grams = np.unique(np.concatenate([grams(w) for _, w in self.passages] or [np.zeros(0, np.uint64)]))

    def choose(self, counts: np.ndarray) -> None:
        """Keep the rarest trigrams of each stretch as seeds: sorted hashes, each with its passages and places."""
        seeds: dict[int, set[tuple[int, int]]] = {}
        for i, (_, words) in enumerate(self.passages):
            own = grams(words)
            count = counts[np.searchsorted(self.grams, own)]
            for k in range(0, len(own), STRETCH):
                # Those that no document holds would find nothing.
                by = np.lexsort((own[k:k + STRETCH], count[k:k + STRETCH]))
                for j in by[count[k:k + STRETCH][by] > 0][:KEEP if len(words) > SHORT else STRETCH]:
                    seeds.setdefault(int(own[k + j]), set()).add((i, int(k + j)))
        self.seeds = np.array(sorted(seeds), np.uint64)
        self.places = [sorted(seeds[int(s)]) for s in self.seeds]


class Lookup:
    """Finds members of a sorted set of hashes; a small bit table rules out most others first."""

    BITS = 20

    def __init__(self, values: np.ndarray):
        self.values, self.bits = values, np.zeros(1 << self.BITS, bool)
        self.bits[(values >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` of members, and which member."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        real = self.values[which] == hashes[at]
        return at[real], which[real]


def count_grams(docs: DataFrame, items: Items) -> np.ndarray:
    """Occurrences of each of the items' trigrams in all documents."""
    wanted = items.grams

    def run(batches):
        look, total = Lookup(wanted), np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, data, offsets in common.text_slices(batch.column(0), batch.column(1)):
                words, first = word_hashes(data, offsets)
                at, which = look(grams(words))
                same = np.searchsorted(first, at, "right") == np.searchsorted(first, at + N - 1, "right")
                np.add.at(total, which[same], 1)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["gram", "n"])

    counts = np.zeros(len(wanted), np.int64)
    rows = docs.select(F.lit(0).alias("i"), F.lower("text").alias("text")).mapInArrow(run, "gram long, n long")
    for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # one row per trigram of the block at most
        counts[r.gram] = r.n
    return counts


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of pairs with linear gaps, and the place after the last aligned word of the text."""
    n, m, size = len(items), max(map(len, items)), max(map(len, texts))
    a, b = np.zeros((n, m), np.uint64), np.ones((n, size), np.uint64)
    used, have = np.zeros((n, m), bool), np.zeros((n, size), bool)
    for i, (x, y) in enumerate(zip(items, texts, strict=True)):
        a[i, :len(x)], used[i, :len(x)] = x, True
        b[i, :len(y)], have[i, :len(y)] = y, True
    row = np.zeros((n, size + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    slope = -GAP * np.arange(size + 1, dtype=np.int32)
    for k in range(m):
        step = np.where((a[:, k:k + 1] == b) & have & used[:, k:k + 1], MATCH, MISMATCH).astype(np.int32)
        new = np.maximum(row + GAP, 0)
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + step)
        new = np.maximum.accumulate(new + slope, axis=1) - slope  # gaps along the text
        at = new.argmax(1)
        top = new[np.arange(n), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
        row = new
    return best, end


def leaks_of(items: Items, look: Lookup, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """(document, passage, similarity, start word, end word) of all leaks in a slice of documents."""
    words, first = word_hashes(data, offsets)
    at, which = look(grams(words))
    doc = np.searchsorted(first, at, "right") - 1
    tried: set[tuple[int, int, int]] = set()
    for p, s, d in zip(at.tolist(), which.tolist(), doc.tolist(), strict=True):
        if p + N > first[d + 1]:
            continue
        for passage, place in items.places[s]:
            width = max(8, len(items.passages[passage][1]) // 4)  # nearby diagonals are aligned once
            tried.add((d, passage, (p - place) // width))
    out = []
    todo = sorted(tried, key=lambda t: len(items.passages[t[1]][1]))
    for k in range(0, len(todo), 128):
        some, mine, texts, starts = todo[k:k + 128], [], [], []
        for d, passage, cell in some:
            item = items.passages[passage][1]
            width = max(8, len(item) // 4)
            begin = max(int(first[d]), cell * width - len(item) // 2)
            texts.append(words[begin:min(int(first[d + 1]), (cell + 1) * width + len(item) + len(item) // 2)])
            mine.append(item)
            starts.append(begin - int(first[d]))
        score, end = align(mine, texts)
        similarity = score / np.array([MATCH * len(x) for x in mine])
        hit = np.flatnonzero(similarity >= LEAK)
        if len(hit):
            _, back = align([mine[i][::-1] for i in hit], [texts[i][:end[i]][::-1] for i in hit])
            for i, length in zip(hit.tolist(), back.tolist(), strict=True):
                e = starts[i] + int(end[i])
                out.append((some[i][0], some[i][1], float(similarity[i]), e - length, e))
    return out


def blocks(benchmark: DataFrame, size: int = BLOCK):
    """The test items in blocks of bounded size, with the block's rows on the driver."""
    rows = numbered(benchmark.select("item_id", "text"), [], ["item_id", "text"], "_k")
    for k in range(0, rows.count(), size):
        yield Items([(r.item_id, r.text) for r in rows.where(F.col("_k").between(k, k + size - 1)).orderBy("_k").collect()])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and leaked test item: doc_id, item_id, similarity, start_word, end_word (best passage).

    Null and empty texts leak nothing, items of fewer than three words are not searched.  Repeated rows of documents give
    repeated rows, repeated items are reported each.  Ties of similarity take the earlier place.  Empty tables give an
    empty result.  Other columns are ignored.
    """
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, similarity double, start_word long, end_word long"
    out = docs.sparkSession.createDataFrame([], kind)
    for items in blocks(benchmark):
        items.choose(count_grams(docs, items))

        def run(batches, items=items):
            look = Lookup(items.seeds)
            for batch in batches:
                found = []
                for rows, data, offsets in common.text_slices(pa.array(np.arange(batch.num_rows)), batch.column(1)):
                    best: dict = {}
                    for d, passage, similarity, start, end in leaks_of(items, look, data, offsets):
                        item = items.passages[passage][0]
                        best[d, item] = max(best.get((d, item), (-1.0,)), (similarity, -start, end))
                    found += [(int(rows[d]), item, s, -start, end) for (d, item), (s, start, end) in best.items()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r[0] for r in found], pa.int64())),
                     *[pa.array([r[i] for r in found], t) for i, t in (
                         (1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]],
                    names=["doc_id", "item_id", "similarity", "start_word", "end_word"])

        out = out.unionByName(docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, kind))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no test item, unchanged; text is mapped in place and never shuffled."""
    for items in blocks(benchmark):
        items.choose(count_grams(docs, items))

        def run(batches, items=items):
            look = Lookup(items.seeds)
            for batch in batches:
                bad, at = set(), 0
                for ids, data, offsets in common.text_slices(
                        pa.array(np.arange(batch.num_rows)), batch.column("lower")):
                    bad |= {at + r[0] for r in leaks_of(items, look, data, offsets)}
                    at += len(ids)
                keep = pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_())
                yield batch.select(["row"]).filter(keep)

        # The row travels whole, so its column names can't clash with those used here.
        packed = docs.select(F.struct(*columns_of(docs)).alias("row"), F.lower("text").alias("lower"))
        docs = packed.mapInArrow(run, packed.select("row").schema).select("row.*")
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
