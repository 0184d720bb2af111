"""Language identification with a byte convolutional network, trained in numpy.

A window is 256 consecutive bytes (A-Z folded to a-z).  Filters of 2, 3 and 4 bytes run over it; as the input is one byte
out of 256 per place, a filter is a sum of table rows.  The maximum of each filter over the window goes through a ReLU and a
softmax layer.  A text is cut into windows from its first to its last byte; its logits are the mean over its windows, so the
whole text decides.  The network is small and travels in the task; scoring is a map over Arrow batches without a shuffle.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keytempo.llm.common import columns_of, hex_number, stored, table, text_slices

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 12, 256
#: Bounds of the training sample: documents per label, cuts per document, characters per cut.
PER_LABEL, CUTS, CUT_CHARS = 600, 4, 256
#: Bound of the outputs of the network; a column of languages has far fewer values.
LABELS = 1024
STEPS, BATCH = 1200, 96
UNKNOWN = "und"
#: Score that always suffices, and shares of labelled held-out rows that the level and the whole rule may drop.
LEAST, LOST, MOST_LOST = 0.5, 0.001, 0.05


def training_rows(docs: DataFrame, per_label: int = PER_LABEL, labels: int = LABELS) -> list[tuple[str, str]]:
    """(label, cut) rows of a bounded sample of labelled documents: per label at most ``per_label`` documents with the
    smallest hashes of id and text, and cuts from hashed places anywhere in their texts.  Rows without an id count like
    others; rows with equal id, text and label are one.  Of more than ``labels`` labels the most frequent are learned."""
    known = (docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
             .select("lang", "text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 12).alias("_h")))
    # Different rows per label: copies of a row neither fill the sample nor thin out the rest.
    found = known.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n"))
    counts = {r.lang: r.n for r in found.orderBy(F.desc("n"), "lang").limit(labels).collect()}
    if not counts:
        return []
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 2.0 * per_label / n)])[F.col("lang")]
    some = (known.where(F.col("_h") / float(1 << 52) <= limit)  # about twice the wanted number; all where there are few
            .groupBy("lang", "_h").agg(F.min("text").alias("text"))
            .withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_h")))
            .where(F.col("_k") <= per_label))
    cuts = some.select("lang", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.lit(CUTS)),
        lambda k: F.substring(F.col("text"), (F.pmod(F.xxhash64("_h", k), F.length("text")) + 1).cast("int"),
                              F.lit(CUT_CHARS)))).alias("k", "cut"))
    return [(r.lang, r.cut) for r in cuts.collect()]


class ByteNet:
    """tables[w][j]: the contribution of each byte at place j of the filters of width w."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels, self.rng = labels, rng
        self.tables = {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), np.float32)
        self.pairs: dict = {}

    def parts(self) -> list[np.ndarray]:
        return [*self.tables.values(), self.out, self.bias]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "pairs"} | {"pairs": {}}

    def pooled(self, windows: np.ndarray, where: bool = False):
        """Maxima of all filters over (n, WINDOW) byte windows, and the places of the maxima if asked for."""
        if not where and not self.pairs:  # two neighbouring bytes at once
            for w, t in self.tables.items():
                two = (t[0][None, :, :] + t[1][:, None, :]).reshape(65536, FILTERS)
                rest = t[2] if w == 3 else (t[2][None, :, :] + t[3][:, None, :]).reshape(65536, FILTERS) if w == 4 else None
                self.pairs[w] = two, rest
        maxima, places = [], []
        two = None if where else windows[:, :-1].astype(np.int32) + (windows[:, 1:].astype(np.int32) << 8)
        for w, t in self.tables.items():
            size = windows.shape[1] - w + 1
            if where:
                x = t[0].take(windows[:, :size], axis=0)
                for j in range(1, w):
                    x += t[j].take(windows[:, j:j + size], axis=0)
                places.append(x.argmax(axis=1))
            else:
                x = self.pairs[w][0].take(two[:, :size], axis=0)
                if w > 2:
                    x += self.pairs[w][1].take(windows[:, 2:] if w == 3 else two[:, 2:], axis=0)
            maxima.append(x.max(axis=1))
        return np.concatenate(maxima, 1), places

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(windows)[0], 0) @ self.out + self.bias

    def train(self, windows: np.ndarray, target: np.ndarray, steps: int = STEPS) -> None:
        """Adam on batches with equal shares of the labels; windows are cut short at random so that short texts work."""
        of = [np.flatnonzero(target == c) for c in range(len(self.labels))]
        first, second = ([np.zeros_like(p) for p in self.parts()] for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([self.rng.choice(x, -(-BATCH // len(of))) for x in of if len(x)])
            x, y = windows[pick].copy(), target[pick]
            length = np.where(self.rng.random(len(x)) < 0.5, WINDOW, self.rng.integers(4, WINDOW, len(x)))
            x[np.arange(WINDOW)[None, :] >= length[:, None]] = 0
            h, places = self.pooled(x, True)
            a = np.maximum(h, 0)
            z = a @ self.out + self.bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            grads = [np.zeros_like(t) for t in self.tables.values()] + [a.T @ p, p.sum(0)]
            back = (p @ self.out.T) * (h > 0)
            for i, w in enumerate(WIDTHS):  # only the place of the maximum learns
                g = back[:, i * FILTERS:(i + 1) * FILTERS]
                for j in range(w):
                    byte = np.take_along_axis(x, places[i] + j, axis=1)
                    np.add.at(grads[i][j], (byte, np.arange(FILTERS)[None, :]), g)
            rate = 0.01 * (1 - step / (steps + 1))
            for q, g, m, v in zip(self.parts(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            for t in self.tables.values():
                t[:, 0, :] = 0  # padding says nothing


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window and the document it belongs to; each document's last window may be short."""
    count = -(-np.diff(offsets) // WINDOW)
    doc = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[:-1][doc] + within * WINDOW, doc


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, WINDOW) folded bytes from start on; 0 from end on."""
    at = start[:, None] + np.arange(WINDOW)[None, :]
    out = _FOLD[data[np.minimum(at, max(len(data) - 1, 0))]]
    out[at >= end[:, None]] = 0
    return out


def noise(rows: list[tuple[str, str]], seed: int = 11) -> list[tuple[str, str]]:
    """Cuts in no language, labelled ``UNKNOWN``: for each of ``rows`` base64, digits, symbols or its text with letters exchanged."""
    rng = np.random.default_rng(seed)
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pools = [small * 2 + digits + "+/", small[:6] + digits, "!#$%&*()=_-|~^<>[]{}:;?/" * 3 + digits + small, small + "     "]
    out = []
    for i, (_, text) in enumerate(rows):
        k = i % (len(pools) + 2)
        if k < len(pools):
            made = "".join(rng.choice(list(pools[k]), CUT_CHARS))
        else:  # every letter becomes another one, alike in the whole cut
            letters = sorted({*text.lower(), *small} - {c for c in text.lower() if not c.isalpha()})
            made = text.lower().translate(dict(zip(map(ord, letters), map(str, rng.permutation(letters)), strict=True)))
        out.append((UNKNOWN, made))
    return out


def fit(docs: DataFrame, per_label: int = PER_LABEL, with_noise: bool = False) -> ByteNet | None:
    """Train on the labelled rows of ``docs`` (doc_id, text, lang); None without any.  ``with_noise`` adds the label ``und``."""
    rows = sorted(training_rows(docs, per_label))
    if not rows:
        return None
    if with_noise:
        rows += noise(rows)
    labels = sorted({lang for lang, _ in rows})
    texts = [x.encode()[:WINDOW] for _, x in rows]
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for i, x in enumerate(texts):
        windows[i, :len(x)] = _FOLD[np.frombuffer(x, np.uint8)]
    net = ByteNet(labels)
    net.train(windows, np.array([labels.index(lang) for lang, _ in rows]))
    return net


def scores(net: ByteNet, ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best label and its probability for each text."""
    best, prob = [], []
    for _, data, offsets in text_slices(ids, texts):
        start, doc = windows_of(data, offsets)
        total = np.zeros((len(offsets) - 1, len(net.labels)))
        for k in range(0, len(start), 512):  # bounds the memory whatever the length of a text
            part = doc[k:k + 512]
            np.add.at(total, part, net.logits(cut(data, start[k:k + 512], offsets[1:][part])))
        total /= np.maximum(np.bincount(doc, minlength=len(total)), 1)[:, None]
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best.append(p.argmax(1))
        prob.append(p.max(1))
    return np.concatenate(best or [np.zeros(0, int)]), np.concatenate(prob or [np.zeros(0)])


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row of ``docs``; all its columns are kept.

    A text that is null or has no letter, and every text without a trained network, gives ``und`` with score 0.  Repeated
    rows are scored each.  A table that has columns lang_pred or score gets new ones in their place.  Training takes rows
    with a label and a letter, with or without an id.
    """
    docs = docs.drop("lang_pred", "score")
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    # The row travels whole, so its column names can't clash with those used here.
    packed = docs.select(F.struct(*columns_of(docs)).alias("row"),
                         F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))

    def run(batches):
        for batch in batches:
            text = batch.column("row").field("text")
            best, prob = scores(net, pa.array(np.arange(batch.num_rows)), text)
            letter = batch.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            names = np.array([*net.labels, UNKNOWN], object)[np.where(letter, best, len(net.labels))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names, pa.string()), pa.array(np.where(letter, prob, 0.0))],
                names=["row", "lang_pred", "score"])

    schema = packed.select("row").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return packed.mapInArrow(run, schema).select("row.*", "lang_pred", "score")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang) in whose text a language is identified, unchanged.

    A text without a letter is in no language.  Others are scored by a network that has learned the languages of the rows not
    held out, and noise.  A row stays if a language wins over noise with a score of at least ``LEAST``, or of the level that
    all but ``LOST`` of the labelled held-out rows reach where they are recognised, if that is lower.  If that would drop more
    than ``MOST_LOST`` of the labelled held-out rows, or no row has a label to learn from, all texts with a letter stay.
    """
    packed = (docs.where(F.col("text").rlike(r"\p{L}"))
              .select(F.struct(*columns_of(docs)).alias("row"), "doc_id", "text", F.col("lang").alias("want")))
    net = fit(docs.where(~is_held_out()), with_noise=True)
    if net is None:
        logging.getLogger(__name__).warning("no row has a language to learn from: all texts with a letter stay")
        return packed.select("row.*")
    known = (F.col("lang_pred") != UNKNOWN)
    seen = stored(predict(packed.where(is_held_out() & F.col("want").isNotNull()).select("doc_id", "text", "want"), net)
                  .select("want", "lang_pred", "score"), "language-held-out")
    level = seen.where(known & (F.col("want") == F.col("lang_pred"))).agg(F.percentile_approx("score", F.lit(LOST), F.lit(10000)))
    level = level.first()[0]
    least = LEAST if level is None else min(LEAST, level)
    lost = seen.agg(F.avg(F.when(known & (F.col("score") >= least), 0.0).otherwise(1.0))).first()[0]
    if lost is not None and lost > MOST_LOST:
        logging.getLogger(__name__).warning("the network would drop %.3f of the labelled held-out rows: "
                                            "all texts with a letter stay", lost)
        return packed.select("row.*")
    return predict(packed, net).where(known & (F.col("score") >= least)).select("row.*")


def is_held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(~is_held_out()))
    return predict(docs.select("doc_id", "text"), net).select(
        "doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
