"""A keyed Parquet table that grows with its rows: merge, point read, erase, all on touched buckets only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo.operators.assessments import merge_by_key

#: Rows that a bucket holds on average before the table takes another one.
ROWS_PER_BUCKET = 1_000_000


def address(hashed: Column, buckets: int) -> Column:
    """The bucket of a hash in a table of ``buckets`` buckets, by linear hashing.

    One more bucket takes rows from a single older one; all others stay where they are.
    """
    half = 1 << (buckets.bit_length() - 1)
    wide = F.pmod(hashed, F.lit(2 * half))
    return F.when(wide < buckets, wide).otherwise(F.pmod(hashed, F.lit(half))).cast("int")


def address_of(number: int, buckets: int) -> int:
    """The bucket of ``buckets`` that held the rows which now lie in bucket ``number`` of a larger table."""
    half = 1 << (buckets.bit_length() - 1)
    return number % (2 * half) if number % (2 * half) < buckets else number % half


@dataclass
class Directory:
    """What is published: the last batch, the number of buckets, the key columns, and version and rows of each bucket."""

    batch: int = -1
    buckets: int = 1
    keys: list[str] = field(default_factory=list)
    held: dict[int, tuple[int, int]] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.held.values())


class KeyedTable:
    """A Parquet table with one row per key, dealt to buckets by a hash of the key.

    A merge rewrites the buckets that its rows fall into, as a new version of each, and then publishes the whole directory
    in one file; readers never see half a merge and a repeated batch is skipped.  The number of buckets follows the rows
    (linear hashing): when buckets would hold more than ``rows_per_bucket`` on average, the same merge splits as many
    as are needed.  Only the last two directories are kept, so publishing reads and writes as much after a thousand batches as
    after one; a directory has one row per bucket and is all that reaches the driver.  One writer at a time.

    ``cluster`` names key columns that are hashed alone, so rows that share them lie in one bucket; their number has to be bounded.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 1, rows_per_bucket: int = ROWS_PER_BUCKET,
                 cluster: Sequence[str] = ()):
        self.spark, self.path, self.schema = spark, path, schema
        self.first_buckets, self.rows_per_bucket, self.cluster = buckets, rows_per_bucket, list(cluster)

    def _bucket(self, d: Directory) -> Column:
        return address(F.xxhash64(*(self.cluster or d.keys)), d.buckets)

    # --- directory ---

    def _folder(self, name: str):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        root, fs = self._folder(name)
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def directory(self) -> Directory:
        """The newest complete directory; a half-written one has no mark of success yet."""
        for batch in sorted((int(n[6:]) for n in self._names("directory") if n.startswith("batch=")), reverse=True):
            folder = f"{self.path}/directory/batch={batch}"
            root, fs = self._folder(f"directory/batch={batch}/_SUCCESS")
            if fs.exists(root):
                rows = self.spark.read.schema("buckets int, keys array<string>, bucket int, version long, n long").json(
                    folder).collect()
                held = {r.bucket: (r.version, r.n) for r in rows if r.bucket is not None}
                return Directory(batch, rows[0].buckets, list(rows[0]["keys"]), held)
        return Directory(buckets=self.first_buckets)

    def _publish(self, d: Directory) -> None:
        rows = [(d.buckets, d.keys, b, v, n) for b, (v, n) in sorted(d.held.items())] + [(d.buckets, d.keys, None, None, None)]
        self.spark.createDataFrame(rows, "buckets int, keys array<string>, bucket int, version long, n long").coalesce(
            1).write.mode("overwrite").json(f"{self.path}/directory/batch={d.batch}")
        old = sorted(int(n[6:]) for n in self._names("directory") if n.startswith("batch="))[:-2]
        for batch in old:
            root, fs = self._folder(f"directory/batch={batch}")
            fs.delete(root, True)

    # --- reading ---

    def _rows(self, d: Directory, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/version={v}/bucket={b}" for b, (v, _) in sorted(d.held.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def current(self) -> tuple[int, DataFrame]:
        d = self.directory()
        return d.batch, self._rows(d)

    def _touched(self, rows: DataFrame, d: Directory) -> set[int]:
        return {r.b for r in rows.select(self._bucket(d).alias("b")).distinct().collect()}

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows whose key is in ``keys`` (all key columns, or the clustering ones at least); only their buckets are read."""
        d = self.directory()
        if not d.keys:
            return self._rows(d)
        on = [k for k in d.keys if k in keys.columns]
        if not set(self.cluster or d.keys) <= set(on):
            raise ValueError(f"rows are found by {self.cluster or d.keys}")
        wanted = keys.select(*on).distinct()
        return self._rows(d, self._touched(wanted, d)).join(wanted, on, "left_semi")

    # --- writing ---

    def _rewrite(self, d: Directory, batch_id: int, rows: DataFrame, replaced: set[int]) -> None:
        """Write ``rows`` as the new content of the ``replaced`` buckets and publish."""
        target = f"{self.path}/version={batch_id}"
        rows.withColumn("bucket", self._bucket(d)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        d.held = {b: held for b, held in d.held.items() if b not in replaced}
        if any(n.startswith("bucket=") for n in self._names(f"version={batch_id}")):
            # Counts come from the Parquet footers.
            written = self.spark.read.parquet(target).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
            d.held |= {r.bucket: (batch_id, r.n) for r in written}
        d.batch = batch_id
        self._publish(d)

    def merge(
        self, batch: DataFrame, batch_id: int, keys: Sequence[str], order: str | Sequence[str],
        update_cols: Sequence[str] | None = None,
    ) -> None:
        d = self.directory()
        if batch_id <= d.batch:
            return
        if d.keys and set(d.keys) != set(keys):
            raise ValueError(f"the table is keyed by {d.keys}")
        d.keys = d.keys or list(keys)
        batch = batch.persist()
        try:
            arrived, before = batch.count(), d.buckets
            if arrived:
                # At most all arriving rows are new.
                grown = max(before, -(-(d.rows + arrived) // self.rows_per_bucket))
                split = {address_of(b, before) for b in range(before, grown)}
                replaced = self._touched(batch, d) | split
                base = self._rows(d, replaced)
                d.buckets = grown
                self._rewrite(d, batch_id, merge_by_key(base, batch, keys, order, update_cols), replaced)
            else:
                d.batch = batch_id
                self._publish(d)
        finally:
            batch.unpersist()

    def erase(self, batch_id: int, keys: Sequence[str], rows: DataFrame) -> int:
        """Delete the rows that agree with ``rows`` in ``keys`` (some or all columns); returns how many buckets were rewritten.

        With all key columns the buckets follow from the hash; otherwise the named columns of the table are scanned for them.
        ``vacuum`` then removes the files that still hold the rows.
        """
        d = self.directory()
        if batch_id <= d.batch:
            return 0
        gone, touched = rows.select(*keys).distinct(), set()
        if d.held and set(keys) >= set(self.cluster or d.keys):
            touched = self._touched(gone, d) & set(d.held)
        elif d.held:
            folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
            where = self._rows(d).select(*keys, F.substring_index(folder, "=", -1).cast("int").alias("_b"))
            touched = {r["_b"] for r in where.join(gone, list(keys), "left_semi").select("_b").distinct().collect()}
        if touched:
            self._rewrite(d, batch_id, self._rows(d, touched).join(gone, list(keys), "left_anti"), touched)
        else:
            d.batch = batch_id
            self._publish(d)
        return len(touched)

    def vacuum(self) -> int:
        """Delete bucket folders that the published directory doesn't name; returns how many.  Readers of older directories
        must be done."""
        d, gone = self.directory(), 0
        for version in self._names(""):
            if not version.startswith("version="):
                continue
            for bucket in self._names(version):
                if bucket.startswith("bucket=") and d.held.get(int(bucket[7:]), (None,))[0] != int(version[8:]):
                    root, fs = self._folder(f"{version}/{bucket}")
                    gone += bool(fs.delete(root, True))
        return gone
