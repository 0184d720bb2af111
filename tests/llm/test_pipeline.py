import random

import corpus_pipeline
from keytempo.llm import pii
from tests.llm import brute


def small_corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(4)]
    docs = [(i, " ".join(word() for _ in range(rnd.randint(5, 90)))) for i in range(40)]
    docs += [(50, docs[3][1]), (51, docs[4][1].upper()), (52, None), (53, ""), (54, "12 34"), (55, "x " + items[1][1] + " y"),
             (56, "reach me at some.one@mail.example.com please now"), (57, "ip 169.122.221.182 here once more " * 2),
             (None, docs[5][1]), (58, " ".join(word() for _ in range(9000)))]
    return docs, items


def test_stages_against_plain_versions(spark, frame, tmp_path):
    docs, items = small_corpus()
    frame(docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns, now, seen = frame(docs).columns, spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen[name] = now.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == columns, name
    ids = lambda name: sorted(map(repr, (r.doc_id for r in seen[name])))
    left = [(d, t) for d, t in docs if t and any(c.isalpha() for c in t)]
    assert ids("language_id") == sorted(repr(d) for d, _ in left)
    classes = brute.jaccard(left, 5, 80)
    left = [(d, t) for (d, t), (_, _, c) in zip(left, classes, strict=True) if d == c]
    assert ids("ngram_jaccard") == sorted(repr(d) for d, _ in left)
    left = [(d, t) for d, t in left if d != 55]
    assert ids("decontamination") == sorted(repr(d) for d, _ in left)
    texts = {r.doc_id: r.text for r in seen["pii"]}
    assert set(texts) == {d for d, _ in left}
    for d, t in left:
        assert (texts[d] == t) == (not pii.find(t))
    assert all(r.n_chars == len(r.text) for r in seen["pii"])
    assert sum(r.length for r in seen["best_fit_packing"]) == sum(len(t.split()) + 1 for t in texts.values())
    packed = {}
    for r in sorted(seen["best_fit_packing"], key=lambda r: r.piece):
        packed[r.doc_id] = packed.get(r.doc_id, "") + r.text
    assert packed == texts  # surrogates are in the result
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, ran.select("doc_id", "piece", "length").collect())) == sorted(
        map(repr, now.select("doc_id", "piece", "length").collect()))


def test_empty_documents(spark, frame, tmp_path):
    frame([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
