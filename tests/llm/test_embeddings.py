import numpy as np
import pytest

from keytempo.llm import embedding_dedup
from tests.llm import brute


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (0, 1, None):
        for size in (1, 1, 2, 7, 40):
            centre = rng.normal(size=16)
            for k in range(size):
                v = centre if k % 4 == 0 else centre + rng.normal(size=16) * 0.15
                rows.append((n := n + 1, [float(np.float32(x)) for x in v], label))
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * 16, 0), (503, [float("nan")] * 16, 0), (504, [1.0, None], 0),
             (505, [float("inf")] + [1.0] * 15, 0), (506, [1.0, 0.0], 0), (507, [2.0, 0.0], 0), (None, rows[0][1], 0),
             (rows[3][0], rows[3][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("x", "y")
    df = df.withColumn("cid", df["label"]).withColumn("n", df["label"]).repartition(3)
    got = embedding_dedup.embedding_duplicates(df)
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows
          if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, count = [], {k: 0 for k in range(len(ok))}
    for a, (i, x, p) in enumerate(ok):
        for b, (j, y, q) in enumerate(ok):
            if a != b and p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                count[a] += 1
                links.append((i, j))
    root = brute.roots({i for i, *_ in ok}, links)
    want = sorted([(i, count[k], root[i], root[i] == i) for k, (i, *_) in enumerate(ok)]
                  + [(i, 0, i, True) for i, v, lab in rows if not any(i == j and lab == q for j, _, q in ok)], key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def as_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_windows_widen_until_their_edge_links_no_more(spark, monkeypatch):
    """500 near-equal vectors over 8 blocks in one pass: windows of one block grow to the whole cluster, each link counts once."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(4)
    base = rng.normal(size=8)
    rows = [(i, [float(x) for x in base + rng.normal(size=8) * 0.01], 0) for i in range(500)]
    for miss in (0.9999, 0.2):  # one pass, several passes
        got = embedding_dedup.embedding_duplicates(as_frame(spark, rows), miss=miss)
        assert got.where("n_links = 499").count() == 500
        assert got.where("kept").count() == 1


def test_recall_of_a_label_of_many_blocks(spark, monkeypatch):
    """Pairs at the limit in a label of 94 blocks: nearly all are found, and no link that isn't one."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(5000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(1000, 32))
    side -= (side * x[:1000]).sum(1, keepdims=True) * x[:1000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    pairs = 0.932 * x[:1000] + np.sqrt(1 - 0.932 ** 2) * side
    v = np.float32(np.concatenate([x, pairs]))
    got = embedding_dedup.embedding_duplicates(as_frame(spark, [(i, r.tolist(), 0) for i, r in enumerate(v)]))
    n = {r.vec_id: r.n_links for r in got.collect()}
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(1) - 1
    have = np.array([n[i] for i in range(len(v))])
    assert (have <= want).all() and have.sum() >= 0.98 * want.sum()


def test_empty_table(spark):
    assert embedding_dedup.embedding_duplicates(
        spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("exact", [False, True])
def test_links_of_a_cluster_wider_than_any_window(spark, monkeypatch, exact):
    """2,600 near-equal vectors over several blocks, one of them held twice, next to other labels."""
    monkeypatch.setattr(embedding_dedup, "TILE", 600 * 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=16) + rng.normal(size=(2600, 16)) * 0.16
    x = np.float32(np.concatenate([x, x[:1], rng.normal(size=(700, 16))]))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000 + i, v.tolist(), i % 3 + 1) for i, v in enumerate(x[2500:3300])]
    got = embedding_dedup.embedding_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3), exact=exact).collect()
    got = {r.vec_id: r for r in got}
    ids, vectors, labels = (np.array(c) for c in zip(*rows, strict=True))
    u = vectors.astype(float)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    count = near.sum(1) - 1
    assert count.max() > 2000 and [got[i].n_links for i in ids] == count.tolist()
    root = brute.roots(set(ids.tolist()), [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    assert all(got[i].component_id == root[i] and got[i].kept == (root[i] == i) for i in ids.tolist())
