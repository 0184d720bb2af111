import random

import numpy as np
import pytest

from keytempo.llm import block_dedup, suffix_dedup
from keytempo.llm.lyndon import suffix_order
from tests.llm import brute


def test_suffix_orders_of_many_texts():
    rng = np.random.default_rng(1)
    for _ in range(60):
        texts = [np.append(rng.integers(1, rng.integers(2, 6), rng.integers(0, 40)), 0) for _ in range(5)]
        begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        found = suffix_order(np.concatenate(texts), begin)
        for t, b in zip(texts, begin, strict=False):
            naive = sorted(range(len(t)), key=lambda i, t=t: t[i:].tolist())
            assert (found[b:b + len(t)] - b).tolist() == naive


def corpus(seed, words):
    rnd = random.Random(seed)
    pool = [" ".join(rnd.choice(words) for _ in range(rnd.randint(40, 130))) for _ in range(6)]
    docs = []
    for d in range(40):
        parts = []
        for _ in range(rnd.randint(0, 3)):
            w = rnd.choice(pool).split(" ")
            parts += [*w[rnd.randint(0, 20):rnd.randint(60, 140)], *[f"w{rnd.random()}" for _ in range(rnd.randint(0, 9))]]
        docs.append((d, rnd.choice([" ", "\n", " \t "]).join(parts)))
    docs += [(100, None), (101, ""), (102, "short"), (103, docs[5][1]), (None, docs[6][1]), (None, "x " * 80),
             (104, "x " * 80), (104, "x " * 80), (105, pool[0] + " " + pool[0]), (2, docs[9][1]), (106, "é" * 120), (107, "é" * 90)]
    rnd.shuffle(docs)
    return docs


def rows(df, columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_word_runs_match_brute_force(frame, seed):
    docs = corpus(seed, "a b c the of and".split() if seed == 1 else [f"v{i}" for i in range(300)])
    got = rows(block_dedup.remove_repeats(frame(docs)), ["doc_id", "n_words", "n_removed", "kept_sha256"])
    assert got == sorted(map(list, brute.word_runs(docs)), key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_byte_runs_match_brute_force(frame, seed):
    docs = corpus(seed, "a b c the of and".split() if seed == 3 else [f"v{i}" for i in range(300)])
    got = rows(suffix_dedup.remove_repeats(frame(docs)), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    assert got == sorted(map(list, brute.byte_runs(docs)), key=repr)


def test_many_different_contexts_are_split():
    """A passage in 60 texts with different surroundings is one anchor with many contexts."""
    rnd = random.Random(5)
    passage = "".join(rnd.choice("abcdefgh") for _ in range(90))
    docs = [(d, "".join(rnd.choice("xyz") for _ in range(40)) + passage + "".join(rnd.choice("xyz") for _ in range(40)))
            for d in range(60)]
    parts = []
    for d, t in docs:
        data = np.frombuffer(t.encode(), np.uint8)
        _, at, key = suffix_dedup.anchors(data, np.array([0, len(data)]))
        s, e = np.maximum(0, at - 30), np.minimum(len(data), at + 50)
        parts.append((key, at - s, e - s, np.full(len(at), d), s, np.concatenate([data[i:j] for i, j in zip(s, e, strict=True)])))
    key, left, length, did, start, flat = (np.concatenate([p[i] for p in parts]) for i in range(6))
    entry, first, count = suffix_dedup.resolve(flat, np.cumsum(length) - length, left, length, key, did)
    for d, _, removed, _, _ in brute.byte_runs(docs):
        mine = did[entry] == d
        ranges = np.stack([start[entry][mine] + first[mine], count[mine]], 1).astype(np.int64)
        assert (suffix_dedup.covered(ranges.tobytes(), len(docs[d][1])).sum() if mine.any() else 0) == removed


def test_empty_table_and_clashing_columns(spark, frame):
    assert block_dedup.remove_repeats(frame([])).count() == 0
    assert suffix_dedup.remove_repeats(frame([])).count() == 0
    odd = frame([(1, "a " * 60), (2, "a " * 60)])
    for c in ("did", "tag", "size", "whole", "places", "bucket", "rows"):
        odd = odd.withColumnRenamed("source", c) if "source" in odd.columns else odd.withColumn(c, odd["lang"])
    assert sorted(r.n_removed for r in block_dedup.remove_repeats(odd).collect()) == [0, 60]
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(odd).collect()) == [0, 120]
