import hashlib
import zlib

import pytest

from keytempo.llm import merkle

ROW = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])))


def plain_tree(nodes):
    """(root, per leaf the list of (left siblings, right siblings))."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, joined = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a:a + 16]
            for k in range(len(run)):
                for leaf_ in below[a + k]:
                    paths[leaf_].append((run[:k], run[k + 1:]))
            above.append(digest("".join(run)))
            joined.append([x for b in below[a:a + 16] for x in b])
        nodes, below = above, joined
    return nodes[0], paths


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    members = [sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources]
    trees = [plain_tree([leaf(r) for r in m]) for m in members]
    root, tops = plain_tree([t[0] for t in trees])
    out = []
    for m, (subroot, paths), top in zip(members, trees, tops, strict=True):
        for r, p in zip(m, paths, strict=True):
            steps = p + top
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node = leaf((*r[:4], text))
            for left, right in steps:
                node = digest("".join(left) + node + "".join(right))
            proof = digest("".join("".join(a) + "".join(b) for a, b in steps))
            out.append((r[0], leaf(r), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def run(spark, tmp_path, rows, extra=False):
    docs = spark.createDataFrame(rows, ROW).repartition(3)
    if extra:
        for name in ("leaf", "tree", "idx", "root", "path", "unit", "_p"):
            docs = docs.withColumn(name, docs.lang)
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


def rows_of(sizes):
    return [(1000 * k + i, s, "en", i, f"Text {i} of {s}") for k, (s, n) in enumerate(sizes) for i in range(n)]


@pytest.mark.parametrize("sizes", [
    [("a", 1)], [("a", 16)], [("a", 17), ("b", 1)], [("a", 256), ("b", 257), (None, 3)], [("a", 700), ("é", 40), ("z", 2)]])
def test_trees_of_many_shapes(spark, tmp_path, sizes):
    rows = rows_of(sizes)
    assert run(spark, tmp_path, rows, extra=True) == plain_manifest(rows)


def test_many_sources(spark, tmp_path):
    rows = [(i, f"s{i % 300:03d}" if i % 7 else None, None, None, "x" * (i % 5)) for i in range(400)]
    assert run(spark, tmp_path, rows) == plain_manifest(rows)


def test_odd_rows(spark, tmp_path):
    rows = ([(None, None, None, None, None)] * 90 + [(5, "a", "en", 3, "ABC")] * 40 + [(5, "a", "en", 3, "other")]
            + [(6, "", "", 0, ""), (7, "", None, None, None), (8, "a", "en", 1_000_000, "Long Text " * 100_000)])
    assert run(spark, tmp_path, rows) == plain_manifest(rows)


def test_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_queue_delivers_in_label_order():
    digests = [digest(str(i)) for i in range(200)]
    levels = merkle.forward(digests, 2)
    assert [len(x) for x in levels] == [13, 1] and levels[1][0] == plain_tree(digests)[0]
    proofs = merkle.backward([digests, *levels], [("up", "down")])
    for node, proof in zip(digests, proofs, strict=True):
        assert proof[-1] == ("up", "down")
        for left, right in proof[:-1]:
            node = digest(left + node + right)
        assert node == levels[1][0]


def test_a_changed_row_is_found(spark):
    rows = rows_of([("a", 300), ("b", 20)])
    parts = merkle.manifest(spark.createDataFrame(rows, ROW))
    assert parts.columns == ["doc_id", "source", "leaf", "changed", "path", "subroot", "root"]
    wrong = parts.where("leaf <> coalesce(changed, leaf)").select(
        (merkle.folded(parts.changed, parts.path) == parts.root).alias("same")).collect()
    assert wrong and not any(r.same for r in wrong)
