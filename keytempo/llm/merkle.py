"""Merkle manifest of a table by time-forward processing.

Every row is a leaf; runs of 16 nodes become one, first inside each source, then over the sources.  Nodes carry labels that
grow from children to parents.  A node's message (label of the parent, place in its run, digest) waits in a priority queue
ordered by label, and a node is computed when its label is the smallest one: all its messages come out together.  The
queue is external: a round takes the messages of the next levels, in the order of their labels, from a table that Spark
has sorted by blocks of 256 siblings, each block runs its two levels through a heap, and the messages to higher levels
are written as the table of the next round.  So there are log256 rounds, each 256 times smaller than the one before, and
no task holds more than two blocks.

The reversed sweep visits the labels from the root down.  Each node hands its children its own proof suffix, preceded by
the children's siblings; only one suffix per block travels between rounds.  At the leaves the suffix is the proof.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keytempo.llm.common import stored, table

FAN, LEVELS = 16, 2
#: Nodes that a block takes in: two levels.
BLOCK = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest_of(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


# one block -----------------------------------------------------------------------------------------------------


def forward(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level above ``digests``: up to ``levels`` levels, fewer only for a whole tree (see block_levels)."""
    queue = [((1, i // FAN), i % FAN, d) for i, d in enumerate(digests)] if levels else []
    heapq.heapify(queue)
    above: list[list[str]] = [[] for _ in range(levels)]
    while queue:
        label = queue[0][0]
        inputs = []
        while queue and queue[0][0] == label:
            inputs.append(heapq.heappop(queue)[2])
        level, i = label
        node = digest_of("".join(inputs).encode())
        above[level - 1].append(node)
        if level < levels:
            heapq.heappush(queue, ((level + 1, i // FAN), i % FAN, node))
    return above


def block_levels(n: int) -> int:
    """Levels that a block of a tree of n nodes runs through: all of a tree that is one block, else LEVELS."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // FAN), levels + 1
    return levels


def backward(nodes: list[list[str]], suffix: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The proof of each of ``nodes[0]`` from the block's proof suffix; ``nodes`` holds the block's levels from below."""
    proofs = [suffix]
    for level in reversed(nodes[:-1]):
        below = []
        for i in range(len(level)):
            start = i - i % FAN
            below.append([("".join(level[start:i]), "".join(level[i + 1:start + FAN])), *proofs[i // FAN]])
        proofs = below
    return proofs


# rounds ----------------------------------------------------------------------------------------------------------


def blocks_of(group: pa.Table) -> list[list[int]]:
    """Row numbers of each block (tree, idx div BLOCK) of a group of nodes, in the order of idx."""
    found: dict = {}
    for row, (tree, idx) in enumerate(zip(group.column("tree").to_pylist(), group.column("idx").to_pylist(), strict=True)):
        found.setdefault((tree, idx // BLOCK), []).append((idx, row))
    return [[row for _, row in sorted(rows)] for _, rows in sorted(found.items())]


def climb_block(group: pa.Table) -> pa.Table:
    tree, n, idx, digest = (group.column(c).to_pylist() for c in ("tree", "n", "idx", "digest"))
    out = []
    for rows in blocks_of(group):
        first = rows[0]
        levels = forward([digest[r] for r in rows], block_levels(n[first]))
        out.append((tree[first], -(-n[first] // BLOCK), idx[first] // BLOCK, levels[-1][0] if levels else digest[first]))
    kinds = {"tree": pa.int64(), "n": pa.int64(), "idx": pa.int64(), "digest": pa.string()}
    return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(kinds.items())})


def descend_block(nodes: pa.Table, messages: pa.Table) -> pa.Table:
    n, digest, tree, idx = (nodes.column(c).to_pylist() for c in ("n", "digest", "tree", "idx"))
    given = {(m["to"], m["block"]): m for m in messages.to_pylist()}
    order, path, subroot, root = [], [], [], []
    for rows in blocks_of(nodes):
        message = given[tree[rows[0]], idx[rows[0]] // BLOCK]
        digests = [digest[r] for r in rows]
        levels = [digests, *forward(digests, block_levels(n[rows[0]]))]
        proofs = backward(levels, [(s["left"], s["right"]) for s in message["path"]])
        order += rows
        path += [[{"left": left, "right": right} for left, right in p] for p in proofs]
        subroot += [message["subroot"]] * len(rows)
        root += [message["root"]] * len(rows)
    out = nodes.take(pa.array(order, pa.int64()))
    for name, values, kind in (("path", path, _PATH), ("subroot", subroot, pa.string()), ("root", root, pa.string())):
        out = out.append_column(name, pa.array(values, kind))
    return out


def in_large_tree() -> Column:
    """The group of a block of a tree of more than BLOCK nodes; ``tree`` is the global number of a tree's first leaf."""
    return -F.col("tree") - F.col("block") * BLOCK - 1


def in_small_tree() -> Column:
    """Trees of one block whose numbers share tree div BLOCK have fewer than 2 * BLOCK nodes, so they share a group."""
    return F.expr(f"tree div {BLOCK}")


def with_unit(nodes: DataFrame) -> DataFrame:
    return (nodes.withColumn("block", F.expr(f"idx div {BLOCK}"))
            .withColumn("unit", F.when(F.col("n") > BLOCK, in_large_tree()).otherwise(in_small_tree())).drop("block"))


def sweep_up(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(the nodes that each round takes in, the roots: tree, digest and the round that made it).

    ``leaves``: tree, n (nodes of the tree), idx, digest, and columns that later travel to the proofs.
    """
    rounds, roots = [leaves], []
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        above = stored(with_unit(rounds[-1].select("tree", "n", "idx", "digest")).groupBy("unit").applyInArrow(
            climb_block, "tree long, n long, idx long, digest string"), f"merkle-{name}{len(rounds)}")
        roots.append(above.where("n = 1").select("tree", "digest", F.lit(len(rounds) - 1).alias("round")))
        most = -(-most // BLOCK)
        if most <= 1:
            return rounds, reduce(DataFrame.unionByName, roots)
        rounds.append(above.where("n > 1"))


def sweep_down(rounds: list[DataFrame], suffixes: DataFrame) -> DataFrame:
    """The leaves with path, subroot and root, from a suffix per tree (tree, round, path, subroot, root)."""
    # The name "to" gives the message a column of its own where both sides come from one stored table.
    message = [F.col("tree").alias("to"), "block", "path", "subroot", "root", "unit"]
    nodes = None
    for k in reversed(range(len(rounds))):
        inbox = (suffixes.where(F.col("round") == k).withColumn("block", F.lit(0).cast("long"))
                 .withColumn("unit", in_small_tree()).select(*message))
        if nodes is not None:
            inbox = inbox.unionByName(nodes.withColumn("block", F.col("idx")).withColumn("unit", in_large_tree()).select(*message))
        here = with_unit(rounds[k])
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in here.schema)
        nodes = (here.groupBy("unit").cogroup(inbox.groupBy("unit"))
                 .applyInArrow(descend_block, f"{kind}, path {PATH}, subroot string, root string").drop("unit"))
    return nodes


# the manifest ----------------------------------------------------------------------------------------------------


def framed(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[framed(columns[c].cast("string")) for c in FIELDS]), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and ``changed``: the leaf after tampering, null where nothing was tampered with."""
    own = {c: F.col(c) for c in FIELDS}
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = own | {"text": F.translate("text", upper, upper.lower())}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select("doc_id", "source", leaf_digest(own).alias("leaf"), F.when(tampered, leaf_digest(lowered)).alias("changed"))


def numbered_leaves(leaves: DataFrame) -> DataFrame:
    """Adds tree (number of the source's first leaf among all leaves), n (leaves of the source) and idx (place among them).

    Leaves are dealt by ranges of (source, doc_id, leaf) and, among equal ones, of their place in the table, so neither a
    large source nor a row repeated very often fills a task.  A row per source and range gives what lies before it.
    """
    by = ["source", "doc_id", "leaf", "_at"]
    leaves = stored(leaves.withColumn("_at", F.monotonically_increasing_id()), "merkle-leaves")
    placed = stored(leaves.repartitionByRange(*by).sortWithinPartitions(*by).drop("_at")
                    .withColumn("_id", F.monotonically_increasing_id()), "merkle-ordered")
    placed = placed.withColumn("_p", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND((1 << 33) - 1))
    runs = placed.groupBy("_p", "source").agg(F.min("_in").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ranges = runs.groupBy("_p").agg(F.sum("_n").alias("_all")).select(
        F.col("_p"), F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("source")  # a row per range of a source
    runs = runs.join(ranges, "_p").select(
        F.col("_p").alias("_q"), F.col("source").alias("_s"), "_before",
        F.min(F.col("_before") + F.col("_first")).over(own).alias("tree"), F.sum("_n").over(own).alias("n"))
    return (placed.join(runs, (F.col("_p") == F.col("_q")) & F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("idx", F.col("_before") + F.col("_in") - F.col("tree"))
            .select("tree", "n", "idx", F.col("leaf").alias("digest"), "doc_id", "source", "changed"))


def ranked(trees: DataFrame) -> DataFrame:
    """Adds idx, the rank of ``tree`` among all trees, and n, their number; by ranges, as trees may be many."""
    placed = stored(trees.repartitionByRange("tree").sortWithinPartitions("tree")
                    .withColumn("_id", F.monotonically_increasing_id()), "merkle-trees")
    placed = placed.withColumn("_p", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND((1 << 33) - 1))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    ranges = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select(
        "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("n"))
    return placed.join(ranges, "_p").withColumn("idx", F.col("_before") + F.col("_in")).drop("_id", "_p", "_in", "_before")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, changed, path, subroot and root of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    ``path`` is the proof from the leaf to the root: per level, the digests of the siblings to the left and to the right,
    concatenated.  ``changed`` is the leaf after tampering (see leaves_of), null where the row is not touched; a null doc_id
    is never touched.  Leaves of a source stand in the order of (doc_id, leaf), null doc_ids first, so repeated ids and rows
    have a defined tree, each row with a leaf of its own.  A null source is a source of its own, the first one; a source of
    one row has its leaf as subroot.  Null and empty texts give different leaves.  An empty table gives an empty result.
    Other columns are ignored.  No text is shuffled, so long texts cost their hashing only.
    """
    leaves = stored(numbered_leaves(leaves_of(docs)), "merkle-numbered")
    rounds, subroots = sweep_up(leaves, "sources")
    tops = stored(ranked(subroots).select(
        F.lit(0).cast("long").alias("tree"), "n", "idx", "digest", F.col("tree").alias("of"), "round"), "merkle-top")
    top_rounds, top = sweep_up(tops, "top")
    nothing = F.array().cast(PATH)
    given = sweep_down(top_rounds, top.select("tree", "round", nothing.alias("path"), F.lit(None).cast("string").alias("subroot"),
                                              F.col("digest").alias("root")))
    suffixes = stored(given.select(F.col("of").alias("tree"), "round", "path", F.col("digest").alias("subroot"), "root"),
                      "merkle-suffixes")
    return sweep_down(rounds, suffixes).select("doc_id", "source", F.col("digest").alias("leaf"), "changed", "path", "subroot", "root")


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
