import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keytempo.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "é", "中文字", "1", "22", "!", "…", " ", "<|endoftext|>", "<|end", "of", "text|>",
       "\U0001f600", "กั", "՘", "�", "\x00", "\x1c", "\x85", "ſ", "aaaa", "====", "Ᲊ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE(bpe.definition_of(PATH))


@pytest.fixture(scope="module")
def decoder():
    return bpe.Decoder(bpe.definition_of(PATH))


def test_boundaries_are_those_of_the_vocabulary(own, decoder):
    inside = {t[i:i + 2] for t in decoder.tokens.values() for i in range(len(t) - 1)} - {b"<|"}
    rng = random.Random(3)
    for _ in range(2000):
        pair = bytes([rng.randrange(256), rng.randrange(256)])
        if pair != b"<|":
            assert own.forced[pair[0], pair[1]] == (pair not in inside)
    for piece in ("hello", "中文字中文字", "=" * 100 + "Ω" * 60, "\x00\x01\x02"):
        data = piece.encode()
        parts = own.cut(data)
        assert b"".join(parts) == data
        at = 0
        for p in parts[:-1]:
            at += len(p)
            assert own.forced[data[at - 1], data[at]]


def test_both_ways_of_merging_agree(own):
    rng = random.Random(4)
    for _ in range(300):
        data = bytes(rng.choice(b"abe tnhs\xc3\xa9=") for _ in range(rng.randint(0, 40)))
        assert own.merge_short(data) == own.merge_long(data)


def test_like_the_library(own, decoder, library):
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert decoder.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    for _ in range(50):  # ids in no order, so the bytes are often no UTF-8
        ids = [rng.randrange(50257) for _ in range(60)]
        assert decoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_fragments(own, library):
    for text in ("a" * 30_000, "=" * 10_000 + "ab" * 5_000, "中" * 20_000, " " * 5_000 + "x"):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_full_caches_change_nothing(own, library, monkeypatch):
    monkeypatch.setattr(own, "pieces", bpe.Remembered(own.encode_piece, 3))
    text = "many different words follow one another, and return: many different words"
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.pieces) <= 3


def test_odd_rows(spark, frame, library):
    docs = [(1, None), (2, ""), (None, "text with <|endoftext|> inside"), (3, "twice"), (3, "twice"), (4, "long words " * 50_000)]
    odd = frame(docs).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    got = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    want = [(d, library.encode(t or "", add_special_tokens=False).ids, t or "") for d, t in docs]
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.encode(frame([]), PATH).count() == 0
    given = spark.createDataFrame([(1, None), (2, [None, 99999999, 31373])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(given, PATH).collect()} == {1: "", 2: "hello"}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteBPE(bpe.definition_of(public_tokenizers.path("word_bpe_49k.json")))


def test_query(spark, sf, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in texts:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = bpe.op11_forced_boundary_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
