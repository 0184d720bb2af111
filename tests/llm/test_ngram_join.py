import random

import pytest

from keytempo.llm import ngram_join
from keytempo.llm.graph import components
from tests.llm import brute


def corpus(seed):
    """Unrelated texts, a shared passage, chains of edits, and groups of near copies of several sizes."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 4000)}"
    docs, d = [], 0
    passage = [word() for _ in range(40)]
    for _ in range(25):
        docs.append((d := d + 1, " ".join([word() for _ in range(60)] + passage)))
    for size in (2, 3, 5, 12, 30):
        w = [word() for _ in range(rnd.choice([30, 80, 200]))]
        for _ in range(size):
            docs.append((d := d + 1, " ".join(w)))
            w = list(w)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                w[rnd.randrange(len(w))] = word()
    docs += [(900, None), (901, ""), (902, " \n"), (903, "Two words"), (904, "two WORDS"), (905, "x x x x x x x x"),
             (906, "x x x x"), (None, docs[30][1]), (907, docs[3][1].upper()), (30, docs[40][1]), (31, docs[31][1])]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_match_brute_force(frame, seed):
    docs = corpus(seed)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(frame(docs)).collect()), key=repr)
    assert got == sorted(brute.jaccard(docs), key=repr)


def test_one_of_each(frame):
    docs = corpus(4)
    kept = ngram_join.one_of_each(frame(docs).withColumnRenamed("source", "_did"), 5, 80)
    assert kept.columns == ["doc_id", "text", "lang", "_did", "n_chars"]
    sets, root = brute.linked_rows(docs, 5, 80)
    least = {}
    for i, (d, t) in enumerate(docs):
        least[root[i]] = min(least.get(root[i], (float("inf"),)), (brute.order(d), i))
    want = [d for i, (d, t) in enumerate(docs) if not sets[i] or least[root[i]][1] == i]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(frame):
    assert ngram_join.jaccard_classes(frame([])).count() == 0
    assert ngram_join.one_of_each(frame([])).count() == 0


def test_components_of_long_chains_and_stars(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(5, 5), (None, 3)]
    links += [(rnd.randint(300, 420), rnd.randint(300, 420)) for _ in range(70)]
    rnd.shuffle(links)
    real = [x for x in links if None not in x and x[0] != x[1]]
    want = brute.roots({n for x in real for n in x}, real)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
