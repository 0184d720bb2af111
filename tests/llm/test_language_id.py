import numpy as np
import pyarrow as pa

from keytempo.llm import language_id
from keytempo.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    net = language_id.fit(docs.where(~language_id.is_held_out()))
    seen = language_id.predict(docs.where(language_id.is_held_out()), net)
    total, right = seen.count(), seen.where("lang = lang_pred").count()
    assert total > 300 and right / total > 0.97
    assert seen.where("score < 0 or score > 1").count() == 0


def test_whole_text_decides_and_batches_do_not_matter():
    net = language_id.ByteNet(["a", "b"])
    texts = ["x" * 300 + "y" * 900, "", "é" * 1000, "z"]
    best, prob = language_id.scores(net, pa.array(range(4)), pa.array(texts))
    for i, t in enumerate(texts):
        one, p = language_id.scores(net, pa.array([0]), pa.array([t]))
        assert one[0] == best[i] and abs(p[0] - prob[i]) < 1e-6
        data = np.frombuffer(t.encode(), np.uint8)
        pad = np.zeros(max(1, -(-len(data) // 256)) * 256, np.uint8)
        pad[:len(data)] = data
        if len(data):
            windows = pad.reshape(-1, 256)
            slow = []  # plain convolution, one place after another
            for w in windows:
                h = [max(0, max(sum(net.tables[k][j, w[p + j], f] for j in range(k)) for p in range(256 - k + 1)))
                     for k in language_id.WIDTHS for f in range(language_id.FILTERS)]
                slow.append(np.array(h) @ net.out + net.bias)
            z = np.mean(slow, 0)
            assert abs(np.exp(z - z.max()).max() / np.exp(z - z.max()).sum() - prob[i]) < 1e-4


def test_edges(spark, frame):
    rows = [(1, "the cat and the dog"), (2, None), (3, ""), (4, "12 34 !!"), (5, "the cat and the dog"), (None, "hello there")]
    docs = frame(rows).withColumnRenamed("source", "letter").withColumnRenamed("n_chars", "row")
    net = language_id.fit(docs)
    got = language_id.predict(docs, net)
    assert got.columns == ["doc_id", "text", "lang", "letter", "row", "lang_pred", "score"]
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "en", 2: "und", 3: "und", 4: "und", 5: "en", None: "en"}
    assert language_id.fit(frame(rows, lang=None)) is None
    assert {r.lang_pred for r in language_id.predict(frame(rows), None).collect()} == {"und"}
    assert language_id.fit(frame([])) is None and language_id.predict(frame([]), net).count() == 0
    assert language_id.predict(got, net).columns == got.columns  # old predictions are replaced


def test_network_decides_what_is_identified(spark, frame):
    rng = np.random.default_rng(5)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    chars = lambda pool, n: "".join(rng.choice(list(pool), n))
    b64 = [chars("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 400) for _ in range(15)]
    symbols = ["a " + chars("!#$%&*()=_-|~^<>[]{}:;?/0123456789", 300) for _ in range(15)]
    bad = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate([*b64, *symbols, "12 34", None])],
                                "doc_id long, text string, lang string")
    some = docs.select("doc_id", "text", "lang")
    got = language_id.identified(some.unionByName(bad)).select("doc_id").collect()
    clean = [r.doc_id for r in got if r.doc_id < 10**9]
    assert len(got) == len(clean) and len(clean) >= 0.999 * some.count()


def test_all_lettered_texts_stay_without_labels(frame):
    rows = [(i, f"some words {i}") for i in range(9)] + [(20, None), (21, "12 34")]
    assert sorted(r.doc_id for r in language_id.identified(frame(rows, lang=None)).collect()) == list(range(9))
    assert language_id.identified(frame([])).count() == 0


def test_rows_without_ids_are_learned_from_and_copies_do_not_thin_the_sample(frame):
    english = [(None, f"the cat and the dog number {i} went home") for i in range(40)]
    rows = english + [(7, "one and the same row")] * 5000
    cuts = language_id.training_rows(frame(rows), per_label=30)
    assert len(cuts) == 30 * language_id.CUTS
    assert language_id.fit(frame(english)) is not None
    assert len({lang for lang, _ in language_id.training_rows(frame(rows), labels=1)}) == 1
