"""Leakage-safe partitions: whole groups go to train, validation or test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytempo import names
from keytempo.operators.groups import ordered_rank

UNASSIGNED = "unassigned"
PREFIX = 4  # hex digits of the hash that bucket the groups: at most 65,536 buckets


def _hashed_groups(df: DataFrame, group: str, seed: int) -> DataFrame:
    text = F.col(group).cast("string")
    return (
        df.filter(F.col(group).isNotNull()).select(group).distinct()
        .withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}:"), text)))
        .withColumn("_bucket", F.substring("_hash", 1, PREFIX))
    )


def hash_rank(df: DataFrame, group: str, seed: int) -> DataFrame:
    """Every distinct group with its 0-based ``rank`` by salted hash and the number of groups.

    A global rank without a global sort: hash prefixes are ordered like hashes, so the rank is
    the rank inside the prefix bucket plus the size of all smaller buckets.  The bucket table
    has at most 65,536 rows whatever the data size.
    """
    hashed = _hashed_groups(df, group, seed)
    buckets = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    line = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_start"),
        F.sum("_n").over(Window.partitionBy()).alias("groups"),
    )
    inside = Window.partitionBy("_bucket").orderBy("_hash", F.col(group).cast("string"))
    return hashed.join(F.broadcast(starts), "_bucket").select(
        group,
        (F.col("_start") + F.row_number().over(inside) - 1).alias("rank"),
        "groups",
    )


def split_sizes(test: float, val: float) -> tuple[Column, Column]:
    """Groups in test and in validation, rounded up."""
    in_test = F.ceil(F.lit(test) * F.col("groups"))
    rest = F.col("groups") - in_test
    share = val / max(1.0 - test, 1e-6)
    in_val = F.when(rest >= 2, F.ceil(F.lit(share) * rest)).otherwise(F.lit(0))
    return in_test, in_val


def assign_split(
    df: DataFrame, group: str, test: float = 0.2, val: float = 0.0, seed: int = 42
) -> DataFrame:
    """One row per group with its ``split``: train, val or test."""
    ranked = hash_rank(df, group, seed)
    in_test, in_val = split_sizes(test, val)
    if val <= 0:
        in_val = F.lit(0)
    return ranked.select(group, F.when(F.col("rank") < in_test, "test")
                         .when(F.col("rank") < in_test + in_val, "val")
                         .otherwise("train").alias("split"))


def grouped_split(
    df: DataFrame, group: str = "user_id", test: float = 0.2, seed: int = 42,
    row_id: str | None = None,
) -> DataFrame:
    """Add ``split`` (train or test).  A single group is cut in row order by ``row_id``.

    Rows without a group stay in the result as ``unassigned``, here and in the other splits by group.
    """
    return _split(df, group, test, 0.0, seed, row_id, least=2)


def grouped_split3(
    df: DataFrame, group: str = "user_id", val: float = 0.15, test: float = 0.15, seed: int = 42,
    row_id: str | None = None,
) -> DataFrame:
    """Add ``split`` (train, val or test).  Fewer than three groups are cut by ``row_id``."""
    return _split(df, group, test, val, seed, row_id, least=3)


def has_groups(df: DataFrame, group: str, least: int) -> bool:
    """Whether there are at least ``least`` groups."""
    return df.select(group).filter(F.col(group).isNotNull()).distinct().limit(least).count() >= least


def _assigned(df: DataFrame, members: DataFrame, group: str) -> DataFrame:
    return df.join(members, group, "left").withColumn("split", F.coalesce("split", F.lit(UNASSIGNED)))


def _split(df, group, test, val, seed, row_id, least) -> DataFrame:
    if group in df.columns and has_groups(df, group, least):
        return _assigned(df, assign_split(df, group, test, val, seed), group)
    if row_id is None:
        raise ValueError("too few groups to split whole groups and no row_id to cut by")
    return sequential_split(df, row_id, val, test)


def sequential_split(df: DataFrame, row_id: str, val: float, test: float) -> DataFrame:
    """Cut the rows in the order of ``row_id``, a value of any ordered type: first train, then val, then test."""
    ranked = ordered_rank(df, [row_id], "_rank")
    total = ranked.count()
    return ranked.withColumn(
        "split", F.when(F.col("_rank") < int(total * (1.0 - test - val)), "train")
        .when(F.col("_rank") < int(total * (1.0 - test)), "val").otherwise("test")).drop("_rank")


def split_windows(
    windows: DataFrame, group: str = "user_id", val: float = 0.15, test: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Three-way split of windows; too few people fall back to whole sessions."""
    if has_groups(windows, group, 3):
        return _assigned(windows, assign_split(windows, group, test, val, seed), group)
    return _assigned(windows, assign_split(windows, "session_id", test, val, seed), "session_id")


def apply_split(rows: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys belong to a partition, e.g. events of the training sessions."""
    return rows.join(members.select(*keys).distinct(), list(keys), "left_semi")


def leaked_names(features: Sequence[str], target: str | None) -> list[str]:
    """Feature names that are the target or exactly a label word."""
    lowered = {f.strip().lower(): f for f in features}
    words = [*([target.strip().lower()] if target else []), *names.LABEL_PATTERNS]
    return [lowered[w] for w in dict.fromkeys(words) if w in lowered]


def leakage_audit(
    parts: DataFrame,
    features: Sequence[str] = (),
    target: str | None = None,
    user: str = "user_id",
    session: str | None = "session_id",
    content: str | None = None,
    fitted_on: str = "train",
) -> DataFrame:
    """Rows (check, value, passed) over rows labelled with ``split``.

    People, sessions and (with ``content``, a hash column) equal windows must not occur in two
    partitions.  All three are checked in one pass: a key lies in two partitions when the
    smallest and the largest partition name seen for it differ.
    """
    checked = {"user_overlap": [user]}
    if session:
        checked["session_overlap"] = [user, session]
    if content:
        checked["duplicate_windows"] = [content]
    entries = F.array(*[
        F.struct(F.lit(name).alias("check_name"), F.to_json(F.struct(*cols)).alias("key"))
        for name, cols in checked.items()
    ])
    found = (
        parts.select(F.explode(entries).alias("e"), "split").select("e.*", "split")
        .groupBy("check_name", "key").agg(F.min("split").alias("a"), F.max("split").alias("b"))
        .groupBy("check_name").agg(F.count_if(F.col("a") != F.col("b")).alias("value"))
    )
    leaked = leaked_names(features, target)
    # The fixed checks hang on one row, whatever the size of the parts.
    fixed = parts.sparkSession.range(1).select(F.explode(F.array(
        F.struct(F.lit("leaked_features").alias("check_name"),
                 F.lit(len(leaked)).cast("long").alias("value")),
        F.struct(F.lit("scaler_outside_train").alias("check_name"),
                 F.lit(0 if fitted_on == "train" else 1).cast("long").alias("value")),
    )).alias("r")).select("r.*")
    return found.unionByName(fixed).withColumn("passed", F.col("value") == 0)
