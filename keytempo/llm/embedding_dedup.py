"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label are first folded into one class.  In each pass the classes are sorted by label and by a key of
concatenated random hashes (signs of random projections, as bytes), so that similar vectors come to stand near one another, and
the order is cut into blocks of ``BLOCK`` places.  A block is compared with itself and with the next one in double precision:
that is the window of a pass.  Links of all passes are united.

* How many passes a label takes follows its counted classes: enough that two vectors at the limit share a run of about a block
  in one of them with probability 1 - ``MISS``.  A label of one block is compared whole in its first pass.
* Where the far edge of a block's window still links (one link per place of the block or more), the window of that block is
  doubled, round by round, until its edge links no more; so a tight cluster is compared in full whatever its size.
* Every class knows its block, and how wide that block's window is, in all passes.  So a link is counted in the first pass and
  round that meet its two ends, and tasks give one row per linked class (number of linked vectors, one member of its component),
  never a row per pair.

``exact`` compares all pairs of a label in tiles of two bounded blocks instead; slices that the triangle inequality holds
further apart than the limit are passed over.  Its work grows with the square of a label.

Sorting is a range partitioning of narrow rows; places in the global order come from stored partition sizes, so no label and no
group of copies is one task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keytempo.llm.common import stored, table
from keytempo.llm.graph import components

#: Bits of a sort key, and places of a block.
HASH_BITS, BLOCK = 48, 1024
#: Components of all vectors in a block of an exact tile, and vectors of a slice.
TILE, SLICE = 1 << 19, 256
LIMIT = 0.93
#: Share of links at the limit that all passes together may miss where vectors spread evenly over the keys.
MISS = 0.002


def directions(passes: int, size: int, seed: int = 20) -> np.ndarray:
    """Random projections of a pass for vectors of a given length; the same wherever they are made."""
    return np.random.default_rng([seed, passes, size]).normal(size=(HASH_BITS, size))


def pass_keys(classes: DataFrame, whole: bool) -> DataFrame:
    """One row per class and pass with its sort key; ``passes`` is the number of a class's passes.  With ``whole``, the rows
    carry their vectors too."""
    def run(batches):
        made: dict = {}
        for batch in batches:
            vectors, passes = batch.column("embedding").to_pylist(), batch.column("passes").to_numpy()
            size = np.array([len(v) for v in vectors])
            for n in np.unique(size):
                for p in range(passes[size == n].max()):
                    at = np.flatnonzero((size == n) & (passes > p))
                    x = np.array([vectors[i] for i in at], float)
                    d = made.setdefault((p, n), directions(p, int(n)))
                    keys = np.packbits(x @ d.T > 0, axis=1)
                    rows = batch.take(pa.array(at))
                    columns = {"pass": pa.array(np.full(len(at), p, np.int32)), "label": rows.column("label"),
                               "size": pa.array(np.full(len(at), n, np.int32)),
                               "key": pa.array([k.tobytes() for k in keys], pa.binary()), "cid": rows.column("cid"),
                               "k": rows.column("k")}
                    if whole:
                        columns |= {"n": rows.column("n"), "vector": pa.array([v.tobytes() for v in x], pa.binary())}
                    yield pa.RecordBatch.from_pydict(columns)

    label = classes.schema["label"].dataType.simpleString()
    return classes.mapInArrow(run, f"pass int, label {label}, size int, key binary, cid long, k long"
                              + (", n long, vector binary" if whole else ""))


def ordered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with ``place``, their number in the global order of ``by``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)),
                 pa.array(np.arange(at, at + batch.num_rows))], names=[*batch.schema.names, "_part", "_at"])
            at += batch.num_rows

    schema = rows.withColumns({"_part": F.lit(0), "_at": F.lit(0).cast("long")}).schema
    placed = stored(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(run, schema), "order")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return (placed.join(F.broadcast(before), F.col("_part") == F.col("_p"))
            .withColumn("place", F.col("_before") + F.col("_at")).drop("_part", "_at", "_p", "_before"))


def unit(vectors) -> np.ndarray:
    x = np.stack([np.frombuffer(v, float) if isinstance(v, bytes) else np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def unite(root: np.ndarray, at: np.ndarray, others: np.ndarray, ends: np.ndarray) -> None:
    """Joins the component of at[i] with those of others[ends[i]:ends[i + 1]], for every i."""
    for i in np.flatnonzero(ends[1:] > ends[:-1]):
        roots = root[others[ends[i]:ends[i + 1]]]
        if (roots != root[at[i]]).any():
            roots = np.unique(np.append(roots, root[at[i]]))
            root[np.isin(root, roots)] = roots[0]


def window_links(pdf: pd.DataFrame, limit: float, low: int, high: int, dense: int) -> pd.DataFrame:
    """Links of block ``i`` with itself and the next one (``low`` 0), or of block ``i`` with block ``j``.

    Blocks of a pass at most ``low`` apart met in earlier rounds; this round goes up to ``high``.  Gives (k, far, a, b) per linked
    class: ``far`` counts vectors whose link is met here for the first time, ``b`` is a member of the component.  A row without
    ``k`` says that ``dense`` links or more reach the window's edge.
    """
    p, i = int(pdf["pass"].iloc[0]), int(pdf["i"].iloc[0])
    j = int(pdf["j"].iloc[0])
    out, edge = [], 0
    for _, rows in pdf.groupby(["label", "size"], sort=False):
        block = rows["block"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        theirs = right if low else np.concatenate([left, right])
        if not len(left) or len(theirs) < 2 - bool(low):
            continue
        x, n = unit(rows["embedding"]), rows["n"].to_numpy(float)
        blocks, reach = np.stack(rows["blocks"]), np.stack(rows["reach"])
        far, root = np.zeros(len(rows)), np.arange(len(rows))
        for s in range(0, len(left), SLICE):
            mine = left[s:s + SLICE]
            near = x[mine] @ x[theirs].T >= limit
            if not low:  # theirs begins with left: each pair once
                near[:, :len(left)] &= np.arange(len(left))[None, :] > np.arange(s, s + len(mine))[:, None]
            u, v = np.nonzero(near)
            unite(root, mine, theirs[v], np.searchsorted(u, np.arange(len(mine) + 1)))
            u, v = mine[u], theirs[v]
            edge += int((block[v] == j).sum()) if j == i + high else 0
            new = np.ones(len(u), bool)
            for q in range(blocks.shape[1]):
                step = blocks[v, q] - blocks[u, q]
                wide = np.where(step < 0, reach[v, q], reach[u, q])  # the window of the block in front
                met = np.minimum(wide, low) if q >= p else wide
                new &= np.abs(step) > met if low or q < p else True
            far += np.bincount(u[new], n[v[new]], len(rows)) + np.bincount(v[new], n[u[new]], len(rows))
        cid = rows["cid"].to_numpy()
        hit = np.flatnonzero((far > 0) | (root != np.arange(len(rows))))
        out.append(pd.DataFrame({"k": rows["k"].to_numpy()[hit], "far": far[hit].astype(np.int64),
                                 "a": cid[hit], "b": cid[root[hit]]}))
    if edge >= dense:
        out.append(pd.DataFrame({"k": [None], "far": [edge], "a": [None], "b": [None]}, dtype=object))
    found = pd.concat(out) if out else pd.DataFrame({c: [] for c in ("k", "far", "a", "b")})
    return found.assign(**{"pass": p, "i": i})[["pass", "i", "k", "far", "a", "b"]]


def caps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle of each slice of unit vectors, and the largest angle of one of its vectors to it."""
    middle, angle = [], []
    for k in range(0, len(x), SLICE):
        part = x[k:k + SLICE]
        c = part.sum(0)
        c = c / np.sqrt(c @ c) if c @ c > 0 else part[0]
        middle.append(c)
        angle.append(np.arccos(np.clip((part @ c).min(), -1, 1)))
    return np.array(middle), np.array(angle)


def tile_links(pdf: pd.DataFrame, limit: float) -> pd.DataFrame:
    """For every class of a tile that links with another: the number ``far`` of vectors, and one member ``b`` of its component."""
    out, reach = [], np.arccos(limit) + 1e-6  # more than rounding
    same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    for _, rows in pdf.sort_values("place").groupby(["label", "size"], sort=False):
        x, n = unit(rows["vector"]), rows["n"].to_numpy(float)
        block = rows["block"].to_numpy()
        left = np.flatnonzero(block == pdf["i"].iloc[0])
        right = np.flatnonzero(block == pdf["j"].iloc[0])
        (mid, wide), (mids, wides) = caps(x[left]), caps(x[right])
        far, root = np.zeros(len(rows)), np.arange(len(rows))
        for s, (c, w) in enumerate(zip(mid, wide, strict=True)):
            mine = left[s * SLICE:(s + 1) * SLICE]
            meet = np.arccos(np.clip(mids @ c, -1, 1)) - w - wides <= reach
            if same:
                meet[:s] = False
                meet[s] = True
            theirs = right[np.repeat(meet, SLICE)[:len(right)]]
            near = x[mine] @ x[theirs].T >= limit
            if same:  # theirs begins with mine
                near[:, :len(mine)] = np.triu(near[:, :len(mine)], 1)
            p, q = np.nonzero(near)
            far += np.bincount(mine[p], n[theirs[q]], len(rows)) + np.bincount(theirs[q], n[mine[p]], len(rows))
            unite(root, mine, theirs[q], np.searchsorted(p, np.arange(len(mine) + 1)))
        hit, cid = np.flatnonzero(far), rows["cid"].to_numpy()
        out.append(pd.DataFrame({"k": rows["k"].to_numpy()[hit], "far": far[hit].astype(np.int64),
                                 "a": cid[hit], "b": cid[root[hit]]}))
    return pd.concat(out)


def all_links(classes: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) that connect all components, and (k, far) with the number of vectors each class links with."""
    longest = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = max(SLICE, TILE // longest)
    places = (ordered(pass_keys(classes.withColumn("passes", F.lit(1)), True), ["label", "size", "key", "cid", "k"])
              .withColumn("block", F.expr(f"place div {rows}")))
    # Only labels that span blocks are looked up: fewer than there are blocks.
    spans = (places.groupBy(F.col("label").alias("_l"), F.col("size").alias("_s"))
             .agg(F.min("block").alias("_low"), F.max("block").alias("_high")).where("_low < _high"))
    tiles = (places.join(spans, (F.col("label") == F.col("_l")) & (F.col("size") == F.col("_s")), "left")
             .withColumn("_other", F.explode(F.sequence(F.coalesce("_low", "block"), F.coalesce("_high", "block"))))
             .select(F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"),
                     "block", "place", "label", "size", "cid", "k", "n", "vector"))
    links = stored(tiles.groupBy("i", "j").applyInPandas(lambda pdf: tile_links(pdf, limit), "k long, far long, a long, b long"),
                   "vector-links")
    return links.select("a", "b").where("a <> b").distinct(), links.groupBy("k").agg(F.sum("far").alias("far"))


def passes_for(classes, limit: float, miss: float):
    """Number of passes of a label with a counted number of classes (a column)."""
    agree = 1 - float(np.arccos(limit) / np.pi)  # probability that two vectors at the limit share a bit
    share = F.pow(F.lit(agree), F.log2(F.greatest(classes / BLOCK, F.lit(1.0))))
    return F.when(classes <= BLOCK, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.log(F.lit(miss)) / F.log1p(-share)))).cast("int")


def pass_links(classes: DataFrame, limit: float, miss: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) that connect all components found, and (k, far) with the number of vectors each class links with."""
    classes = classes.withColumn("_size", F.size("embedding"))
    # Only labels of several blocks are looked up: at most rows / BLOCK of them.
    large = (classes.groupBy(F.col("label").alias("_l"), F.col("_size").alias("_s")).agg(F.count(F.lit(1)).alias("_all"))
             .where(F.col("_all") > BLOCK).select("_l", "_s", passes_for(F.col("_all"), limit, miss).alias("_passes")))
    keyed = (classes.join(large, (F.col("label") == F.col("_l")) & (F.col("_size") == F.col("_s")), "left")
             .withColumn("passes", F.coalesce("_passes", F.lit(1))).drop("_l", "_s", "_passes", "_size"))
    places = ordered(pass_keys(keyed, False), ["pass", "label", "size", "key", "cid", "k"])
    own = (places.groupBy(F.col("k").alias("_k")).agg(F.array_sort(F.collect_list(F.struct(
        "pass", F.expr(f"place div {BLOCK}").alias("block")))).alias("_b")))
    located = stored(classes.join(own, F.col("k") == F.col("_k")).select(
        "k", "cid", "n", "label", F.col("_size").alias("size"), "embedding", F.col("_b.block").alias("blocks")), "vector-places")
    spread = located.select("k", F.posexplode("blocks").alias("pass", "block"))
    schema = "pass int, i long, k long, far long, a long, b long"

    def links_of(rows: DataFrame, low: int, high: int) -> DataFrame:
        dense = BLOCK
        return stored(rows.groupBy("pass", "i", "j").applyInPandas(
            lambda pdf: window_links(pdf, limit, low, high, dense), schema), "vector-links")

    # The window of a pass: a block and the next one.
    first = (located.select("*", F.posexplode("blocks").alias("pass", "block"))
             .withColumn("reach", F.transform("blocks", lambda _: F.lit(1)))
             .withColumn("i", F.explode(F.array("block", F.col("block") - 1))).withColumn("j", F.col("i") + 1))
    rounds = [links_of(first, 0, 1)]
    reach, low = None, 1
    while True:
        still = rounds[-1].where("k is null").select("pass", "i")  # a row per block whose window ends inside a cluster
        if still.isEmpty():
            break
        high = 2 * low
        wider = still.select("pass", F.col("i").alias("block"), F.lit(high).alias("wide"))
        reach = wider if reach is None else stored(
            reach.unionByName(wider).groupBy("pass", "block").agg(F.max("wide").alias("wide")), "vector-windows")
        tiles = still.withColumn("j", F.explode(F.sequence(F.col("i") + low + 1, F.col("i") + high)))
        sides = tiles.withColumn("block", F.col("i")).unionByName(tiles.withColumn("block", F.col("j")))
        meet = stored(spread.join(sides, ["pass", "block"]), "vector-tiles")
        touched = spread.join(meet.select("k").distinct(), "k", "left_semi")
        windows = (touched.join(reach, ["pass", "block"], "left").groupBy("k")
                   .agg(F.array_sort(F.collect_list(F.struct("pass", F.coalesce("wide", F.lit(1)).alias("wide")))).alias("_w"))
                   .select("k", F.col("_w.wide").alias("reach")))
        rounds.append(links_of(meet.join(located.join(windows, "k"), "k"), low, high))
        low = high
    links = reduce(DataFrame.unionByName, rounds).where("k is not null")
    return links.select("a", "b").where("a <> b").distinct(), links.groupBy("k").agg(F.sum("far").alias("far"))


def embedding_duplicates(rows: DataFrame, limit: float = LIMIT, miss: float = MISS, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, embedding, label).

    Only vectors of equal, non-null label and equal length are compared.  A vector that is null, empty, zero, or holds a null
    or a non-finite component links with nothing.  Equal vectors of a label always link.  Rows with the same vec_id count
    as the same vector in components; a null vec_id never links and is kept.  No link below ``limit`` is given.  All links of a
    label of up to ``BLOCK`` different vectors are found, of larger ones those that some pass meets (see ``miss``); with
    ``exact`` all, at quadratic cost.  An empty table gives an empty result; other columns are ignored.
    """
    rows = rows.select("vec_id", "label", F.col("embedding").cast("array<float>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("embedding") > 0, F.lit(False))
              & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False)))
    valid = rows.where(usable)
    classes = stored(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n"))
                     .withColumn("k", F.monotonically_increasing_id()), "vector-classes")
    links, linked = all_links(classes, limit) if exact else pass_links(classes, limit, miss)
    roots = components(links)
    facts = (classes.join(linked, "k", "left").join(roots, F.col("cid") == F.col("node"), "left")
             .select("label", "embedding", (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("_links"),
                     F.coalesce("root", "cid").alias("_root")))
    found = valid.join(facts, ["label", "embedding"]).select("vec_id", F.col("_links").alias("n_links"),
                                                             F.col("_root").alias("component_id"))
    rest = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))
