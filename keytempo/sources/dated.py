"""Stored tables partitioned by day: retention, erasure of a person, reading the newest rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo import names
from keytempo.functions import columns as c

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def filesystem(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def partitions(spark: SparkSession, path: str, columns: Sequence[str]) -> list[tuple[str, ...]]:
    """The partition values below ``path``, by listing folders; an absent table has none."""
    escapes = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    found: list[tuple[str, ...]] = [()]
    for name in columns:
        deeper = []
        for values in found:
            root, fs = filesystem(spark, partition_path(spark, path, columns, values))
            for s in fs.listStatus(root) if fs.exists(root) else ():
                folder = s.getPath().getName()
                if folder.startswith(f"{name}="):
                    deeper.append((*values, escapes.unescapePathName(folder[len(name) + 1:])))
        found = deeper
    return found


def partition_path(spark: SparkSession, path: str, columns: Sequence[str], values: Sequence[str]) -> str:
    """The folder of a partition; Spark writes some characters of values escaped."""
    escapes = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "/".join([path, *(f"{n}={escapes.escapePathName(v)}" for n, v in zip(columns, values, strict=False))])


def drop_partition(spark: SparkSession, path: str, columns: Sequence[str], values: Sequence[str]) -> None:
    root, fs = filesystem(spark, partition_path(spark, path, columns, values))
    fs.delete(root, True)


def store_by_day(df: DataFrame, path: str, created: str = "created_at", kind: str | None = "artifact_type", mode: str = "append") -> None:
    """Write a table by day of ``created`` (UTC) and, if given, by ``kind`` above it."""
    by = [*([kind] if kind else []), "day"]
    out = df.withColumn("day", F.date_format(F.col(created), "yyyy-MM-dd"))
    out.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def read_by_day(spark: SparkSession, path: str, schema: str, kind: str | None = "artifact_type") -> DataFrame:
    """The table of ``store_by_day``; ``schema`` names its columns, without the day."""
    wanted = [f.split()[0].strip("`") for f in schema.split(", ")]
    by = ", ".join(f"{n} string" for n in [*([kind] if kind and kind not in wanted else []), "day"])
    return spark.read.schema(f"{schema}, {by}").parquet(path).select(*wanted)


def rewrite_partitions(
    spark: SparkSession, path: str, columns: Sequence[str], touched: Sequence[tuple[str, ...]], keep
) -> None:
    """Replace each touched partition by the rows of it that ``keep`` leaves; emptied ones are removed.

    ``keep`` takes the frame of the touched partitions (with their partition columns) and returns some of its rows.  Other
    partitions are neither read nor written.
    """
    if not touched:
        return
    old = spark.read.option("basePath", path).parquet(*[partition_path(spark, path, columns, v) for v in touched])
    old = old.withColumns({n: F.col(n).cast("string") for n in columns})
    left = keep(old)
    # A partition without rows is not written, so what it held has to be deleted.
    stay = {tuple(NO_VALUE if v is None else v for v in r) for r in left.select(*columns).distinct().collect()}
    left.hint("rebalance", *columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *columns).parquet(path)
    for values in set(touched) - stay:
        drop_partition(spark, path, columns, values)


def retain(
    spark: SparkSession, path: str, now: datetime, created: str = "created_at", kind: str | None = "artifact_type",
    days: int | None = None, dry_run: bool = False,
) -> DataFrame:
    """Remove what is past retention from a table of ``store_by_day``; returns a row per partition and what was done.

    Days come from the storage policy of the kind unless given.  A partition whose last moment is past retention is deleted
    unread; the one that the limit falls into is rewritten; younger ones are not touched.  Rows without a date stay.
    """
    by = [*([kind] if kind else []), "day"]
    report, edges = [], []
    for values in partitions(spark, path, by):
        keep = days if days is not None else names.STORAGE_POLICIES.get(
            values[0].strip().lower() if kind else "", names.DEFAULT_POLICY)[3]
        limit, action = now - timedelta(days=keep), "kept"
        if values[-1] != NO_VALUE:
            start = datetime.combine(date.fromisoformat(values[-1]), datetime.min.time())
            if start + timedelta(days=1) <= limit:
                action = "dropped"
            elif start <= limit:
                action = "rewritten"
        report.append((*values, keep, action))
        if action == "dropped" and not dry_run:
            drop_partition(spark, path, by, values)
        elif action == "rewritten":
            edges.append((values, keep))
    for keep in sorted({k for _, k in edges}) if not dry_run else ():
        limit = F.lit(now - timedelta(days=keep)).cast("timestamp")
        rewrite_partitions(spark, path, by, [v for v, k in edges if k == keep],
                           lambda df, limit=limit: df.filter(F.col(created).cast("timestamp") > limit))
    return spark.createDataFrame(report, ", ".join(f"{n} string" for n in by) + ", retention_days int, action string")


def purge_tables(
    spark: SparkSession, tables: Mapping[str, tuple[str, Sequence[str]]], person: str, journal: str, secret: str | None = None,
) -> DataFrame:
    """Erase a person from stored tables: name -> (path, partition columns); returns rows found per id column.

    A table is scanned for partitions that hold the person, reading its id columns only, and these are rewritten.  The journal
    takes a line per table when it is done, under a pseudonym of the person and never the id itself; a run that was cut short
    goes on with the tables that have no line yet.
    """
    stored_id = c.pseudonym(F.lit(person), secret) if secret else F.lit(person)
    mark = spark.range(1).select(F.sha2(stored_id.cast("string"), 256)).first()[0]
    schema = "person string, table string, id_column string, records_deleted long"
    folder = f"{journal}/person={mark}"
    for name, (path, by) in tables.items():
        root, fs = filesystem(spark, f"{folder}/table={name}/_SUCCESS")
        if fs.exists(root):
            continue
        df = spark.read.parquet(path)
        ids = [n for n in df.columns if n in names.PURGE_ID_COLUMNS]
        same = {n: F.coalesce(F.col(n).cast("string") == stored_id, F.lit(False)) for n in ids}
        found: list[tuple[str, str, str, int]] = []
        if ids:
            hit = df.select(*[F.col(n).cast("string") for n in by], *[same[n].cast("long").alias(f"_{i}") for i, n in enumerate(ids)])
            per = hit.groupBy(*by).agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(ids))]).filter(
                " OR ".join(f"_{i} > 0" for i in range(len(ids)))).collect()
            found = [(mark, name, n, sum(r[f"_{i}"] for r in per)) for i, n in enumerate(ids)]
            touched = [tuple(NO_VALUE if v is None else v for v in r[:len(by)]) for r in per]
            rewrite_partitions(spark, path, by, touched, lambda d, same=same: d.filter(~_any(list(same.values()))))
        spark.createDataFrame(found, schema).coalesce(1).write.mode("overwrite").json(f"{folder}/table={name}")
    out = spark.read.schema("id_column string, records_deleted long").json(
        [f"{folder}/table={name}" for name in tables]) if tables else spark.createDataFrame([], "id_column string, records_deleted long")
    source = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return out.select(F.concat(F.substring_index(source, "=", -1), F.lit("."), F.col("id_column")).alias("table_column"),
                      "records_deleted")


def _any(conditions):
    out = conditions[0]
    for condition in conditions[1:]:
        out |= condition
    return out


def newest_partitions(spark: SparkSession, path: str, n: int, fmt: str = "text") -> list[str]:
    """Folders of the newest days that together hold ``n`` rows, or all.

    Days are counted from the newest one in steps that double, so older days are not opened.
    """
    days = sorted((v[0] for v in partitions(spark, path, ["day"])), key=lambda d: (d != NO_VALUE, d), reverse=True)
    taken, rows, step = 0, 0, 1
    while taken < len(days) and rows < n:
        more = [partition_path(spark, path, ["day"], [d]) for d in days[taken:taken + step]]
        rows += spark.read.format(fmt).load(more).count()
        taken, step = taken + len(more), step * 2
    return [partition_path(spark, path, ["day"], [d]) for d in days[:taken]]
