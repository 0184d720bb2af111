"""Byte-level BPE encoding and decoding by forced boundaries.

A merge only ever makes a token of the vocabulary.  So where two neighbouring bytes occur side by side inside no token, no
token can span the place between them: it is a certain cut.  Texts are split into pieces by the tokenizer's pattern, pieces
are split at their certain cuts, every fragment is encoded by itself and the ids are concatenated.  Fragments are short
even in scripts without spaces and in long runs of symbols, and they recur, so most are looked up in a bounded cache.

The tokenizer file is read by the driver and broadcast; its size is that of a vocabulary, whatever the input.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo.llm.common import table

# The pattern of byte-level pre-tokenizers, for any text and for ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Longest piece and fragment that is remembered, and how many of each: bounds of a worker's cache, not of the work.
LONGEST, MOST = 48, 1 << 17
#: Up to this length plain lists are quicker than a heap and numpy; the result is the same.
SHORT = 40
#: Rows and ids of a result batch; a text with more ids makes a batch of its own.
BATCH_ROWS, BATCH_IDS = 512, 1 << 20


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Remembered(dict):
    """A dictionary that computes missing values.  When it is full it starts anew, but what was asked for since the last
    time is still found, so frequent keys stay."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def vocabulary(whole: dict) -> dict[int, bytes]:
    """The bytes of every token, without the added ones."""
    as_byte = byte_characters()
    return {i: bytes(as_byte[c] for c in t) for t, i in whole["model"]["vocab"].items()}


class Decoder:
    """Token bytes of one tokenizer file."""

    def __init__(self, definition: str):
        whole = json.loads(definition)
        self.tokens = vocabulary(whole) | {t["id"]: t["content"].encode() for t in whole.get("added_tokens") or []}

    def decode(self, ids) -> str:
        """Bytes of the tokens; ids outside the vocabulary give nothing, bytes that are no UTF-8 replacement marks."""
        tokens = self.tokens
        return b"".join([tokens.get(i, b"") for i in ids]).decode("utf-8", "replace")


class ByteBPE:
    """Encoder of one tokenizer file."""

    def __init__(self, definition: str):
        whole = json.loads(definition)
        model, split = whole["model"], whole.get("pre_tokenizer") or {}
        if (model["type"], split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) != \
                ("BPE", "ByteLevel", True, False) or whole.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE with the usual pattern, without prefix space or normalizer")
        as_byte = byte_characters()
        ids = {t: i for i, t in vocabulary(whole).items()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (bytes(as_byte[c] for c in part) for part in (merge.split(" ") if isinstance(merge, str) else merge))
            self.ranks[ids[left], ids[right]] = rank, ids[left + right]
        self.forced = self.forced_boundaries(ids)
        self.forced_bytes = self.forced.tobytes()
        self.added = {}
        for t in whole.get("added_tokens") or []:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that take in their surroundings are not supported")
            self.added[t["content"]] = t["id"]
        longest_first = sorted(self.added, key=len, reverse=True)
        self.sections = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.any_text, self.ascii_text = regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.ASCII)
        self.assigned: set[str] = set()
        self.pieces = Remembered(self.encode_piece, MOST)
        self.fragments = Remembered(self.merge, MOST // 8)

    @staticmethod
    def forced_boundaries(tokens) -> np.ndarray:
        """[left, right] is true where no token holds the bytes left, right side by side."""
        tokens = list(tokens)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        inside = np.ones(max(len(data) - 1, 0), bool)
        inside[np.cumsum([len(t) for t in tokens])[:-1] - 1] = False
        forced = np.ones((256, 256), bool)
        forced[data[:-1][inside], data[1:][inside]] = False
        return forced

    def split(self, text: str) -> list[str]:
        """Pieces of the pattern.  Characters that Python's tables don't know yet may be letters to one library and not to
        another, so a text with such a character is split by the tokenizers library itself."""
        if text.isascii():
            return self.ascii_text.findall(text)
        unknown = set(text) - self.assigned
        if unknown:
            if any(unicodedata.category(c) == "Cn" for c in unknown):
                if not hasattr(self, "splitter"):
                    from tokenizers import pre_tokenizers
                    self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
                return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
            self.assigned |= unknown
        return self.any_text.findall(text)

    def cut(self, piece: bytes) -> list[bytes]:
        """The fragments of a piece between its certain cuts."""
        if len(piece) <= SHORT:
            cuts = [i for i in range(1, len(piece)) if self.forced_bytes[piece[i - 1] << 8 | piece[i]]]
        else:
            codes = np.frombuffer(piece, np.uint8)
            cuts = (np.flatnonzero(self.forced[codes[:-1], codes[1:]]) + 1).tolist()
        if not cuts:
            return [piece]
        return [piece[i:j] for i, j in zip([0, *cuts], [*cuts, len(piece)], strict=True)]

    def encode_piece(self, piece: str) -> bytes:
        """The ids of a piece as 32-bit numbers, put together from those of its fragments."""
        parts = self.cut(piece.encode())
        ids = self.merge(parts[0]) if len(parts) == 1 else [i for p in parts for i in self.fragments[p]]
        return array("i", ids).tobytes()

    def merge(self, fragment: bytes) -> list[int]:
        """Merge neighbours by rank, leftmost first, until none is left."""
        return self.merge_short(fragment) if len(fragment) <= SHORT else self.merge_long(fragment)

    def merge_short(self, fragment: bytes) -> list[int]:
        find, none = self.ranks.get, (len(self.ranks), -1)
        ids = [self.byte_ids[b] for b in fragment]
        found = [find(pair, none) for pair in zip(ids, ids[1:])]  # noqa: B905
        while found:
            least = min(found)
            if least is none:
                break
            i = found.index(least)
            ids[i:i + 2] = [least[1]]
            del found[i]
            if i:
                found[i - 1] = find((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = find((ids[i], ids[i + 1]), none)
        return ids

    def merge_long(self, fragment: bytes) -> list[int]:
        """With a heap that holds each possible merge, so the time grows with n log n."""
        ids, n = array("q", (self.byte_ids[b] for b in fragment)), len(fragment)
        before, after = array("q", range(-1, n - 1)), array("q", range(1, n + 1))
        ranks = self.ranks
        heap = [(found[0], i) for i in range(n - 1) if (found := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            found = ranks.get((ids[i], ids[j]))
            if found is None or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := ranks.get((ids[i], ids[k])):
                    heapq.heappush(heap, (found[0], i))
            h = before[i]
            if h >= 0 and (found := ranks.get((ids[h], ids[i]))):
                heapq.heappush(heap, (found[0], h))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> array:
        out = []
        for section in self.sections.split(text) if self.sections else (text,):
            if section in self.added:
                out.append(array("i", [self.added[section]]).tobytes())
            else:
                out += map(self.pieces.__getitem__, self.split(section))
        return array("i", b"".join(out))


_LOADED: dict[type, tuple[str, object]] = {}


def loaded(kind: type, definition: str):
    """The encoder or decoder of a worker process, with its caches; the last one of each kind is kept."""
    if kind not in _LOADED or _LOADED[kind][0] != definition:
        _LOADED[kind] = definition, kind(definition)
    return _LOADED[kind][1]


def definition_of(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def runs_of(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows [start, end) that make a batch of bounded size; one row at least."""
    total, start = np.concatenate(([0], np.cumsum(sizes))), 0
    while start < len(sizes):
        end = max(int(np.searchsorted(total, total[start] + BATCH_IDS, "right")) - 1, start + 1)
        yield start, min(end, start + BATCH_ROWS)
        start = min(end, start + BATCH_ROWS)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row of ``docs`` (doc_id, text), as the tokenizers library encodes the
    whole text without adding special tokens; special tokens written in a text get their ids.

    A null text is empty and an empty text has no ids.  Null and repeated doc_ids are kept as rows of their own, an empty
    table gives an empty result, other columns are ignored.  Bytes that are no UTF-8 are read as replacement marks.  A text
    is one row however long; a task holds one batch of texts and, per text, memory in proportion to its longest fragment.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(definition_of(path))

    def run(batches):
        bpe = loaded(ByteBPE, shared.value)
        for batch in batches:
            texts = batch.column(1)
            # A text has no more ids than bytes.
            for start, end in runs_of(pc.binary_length(texts).fill_null(0).to_numpy()):
                flat, offsets = array("i"), [0]
                for text in texts[start:end]:
                    flat.extend(bpe.encode((text.as_py() or b"").decode("utf-8", "replace")))
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:end], ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to ``encoded`` (doc_id, ids): the text of the ids, special tokens included.

    Null ids are an empty list; a null or an id outside the vocabulary inside a list gives nothing.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(definition_of(path))

    def run(batches):
        decoder = loaded(Decoder, shared.value)
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            values = lists.values.fill_null(-1).to_numpy()
            for start, end in runs_of(np.diff(offsets)):
                texts = [decoder.decode(values[offsets[i]:offsets[i + 1]].tolist()) for i in range(start, end)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:end], lists[start:end], pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op11_forced_boundary_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
