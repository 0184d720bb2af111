import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from keytempo.llm import resampling

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORDS.findall(data)
    return len(w), [zlib.crc32(b" ".join(w[i:i + n])) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target):
    s, t = collections.Counter(), collections.Counter()
    found = [plain_features(x) for _, x in docs]
    for _, f in found:
        s.update(f)
    for x in target:
        t.update(plain_features(x)[1])
    s_all, t_all = float(sum(s.values()) + 10000), float(sum(t.values()) + 10000)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all))) for b in range(10000)]
    rows = []
    for (d, _), (n, f) in zip(docs, found, strict=True):
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    ranked = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for i, r in enumerate(ranked[:5 * len(ranked) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, rows), key=repr)


def some_texts(n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "été", "中文", "x1", "42", "a" * 70, "long" * 300]
    return [" ".join(rng.choice(words[:7 if rng.random() < .95 else 9]) + rng.choice(["", ",", ".\n", " -"])
                     for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_checksums():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(20_000))
    at = sorted(rng.sample(range(len(data)), 400)) + [19_999]
    start, end = np.array(at[:-1]), np.array(at[1:])
    got = resampling.checksums(np.frombuffer(data, np.uint8), start, end)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start, end, strict=True)]
    sizes = np.array([0, 1, 63, 64, 65, 4095, 4096, 300_000])
    moved = resampling.shifted(np.full(len(sizes), zlib.crc32(b"start"), np.uint32), sizes)
    for m, n in zip(moved.tolist(), sizes.tolist(), strict=True):
        rest = bytes(n)
        assert m ^ zlib.crc32(rest) == zlib.crc32(b"start" + rest)


def test_cut_texts_have_the_same_features():
    text = " ".join(some_texts(40, 7))
    want = collections.Counter(plain_features(text)[1])
    for most in (64, 1000, 5000, 1 << 20):
        got, words = collections.Counter(), 0
        batch = pa.record_batch([pa.array([text])], names=["text"])
        for _, _, n, (_, bucket) in resampling.scanned([batch], most):
            got.update(bucket.tolist())
            words += int(n.sum())
        assert got == want and words == plain_features(text)[0]


def test_like_plain(spark, frame):
    docs = list(enumerate(some_texts(300))) + [(None, some_texts(1, 3)[0] * 3), (7, None), (8, ""), (900, "word " * 30)] + [(901, "a b " * 20)] * 5
    target = [*some_texts(20, 9), None, ""]
    odd = frame(docs).withColumnRenamed("lang", "score").withColumnRenamed("source", "rank")
    given = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(odd, given).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == plain_resample(docs, target)


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(frame([]), none).count() == 0
    docs = [(i, "some words " * 15) for i in range(40)]
    assert sorted(map(tuple, resampling.resample(frame(docs), none).collect()), key=repr) == plain_resample(docs, [])


@pytest.mark.parametrize("part", [7, 64, 1 << 20])
def test_radix_sort(spark, part):
    rng = random.Random(part)
    values = ([(rng.randint(-5, 5), rng.choice([None, 1, 70_000, -3])) for _ in range(200)] + [(3, 3)] * 100
              + [(-(1 << 62), -(1 << 63)), (1 << 62, (1 << 63) - 1), (None, 5)])
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(values)], "i long, a long, b long").coalesce(1)
    got = resampling.radix_sorted(rows, [("a", True), ("b", False)], "place", part).collect()
    low = lambda v: (v is not None, v or 0)
    want = sorted(range(len(values)), key=lambda i: (values[i][0] is not None, -(values[i][0] or 0), low(values[i][1]), i))
    assert [r.i for r in sorted(got, key=lambda r: r.place)] == want
    assert sorted(r.place for r in got) == list(range(len(values)))


def test_equal_keys_keep_their_order(spark):
    rows = spark.range(500).selectExpr("id", "1L AS a").coalesce(1)
    got = resampling.radix_sorted(rows, [("a", False)], "place", 100).orderBy("place").collect()
    assert [r.id for r in got] == list(range(500))
