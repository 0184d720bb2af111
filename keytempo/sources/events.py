"""Event files in and data set discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keytempo import names

FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl",
           ".parquet": "parquet"}
MANIFEST = "dataset_manifest.json"


def format_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for ext, fmt in FORMATS.items():
        if name.endswith(ext):
            return fmt
    raise ValueError(f"unsupported file format: {path}; supported: {sorted(FORMATS)}")


def read_events(
    spark: SparkSession, path: str, fmt: str | None = None, schema: StructType | None = None
) -> DataFrame:
    """Events from CSV, TSV, JSON, JSON lines or Parquet, by extension unless ``fmt`` is given.

    Give a schema where it is known: inferring one reads the text twice.
    """
    fmt = fmt or format_of(path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt in ("csv", "tsv"):
        reader = reader.option("header", True).option("sep", "\t" if fmt == "tsv" else ",")
        if schema is None:
            reader = reader.option("inferSchema", True)
        return reader.csv(path)
    if fmt == "json":
        return reader.option("multiLine", True).json(path)
    if fmt == "jsonl":
        return reader.json(path)
    if fmt == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unknown format {fmt!r}")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Name, size and time of the files of a folder; contents are not read.

    A scan leaves out empty files, so the names come from the file index.
    """
    scan = spark.read.format("binaryFile").load(folder)
    names_found = [(p.rstrip("/").rsplit("/", 1)[-1],) for p in scan.inputFiles()]
    listed = spark.createDataFrame(names_found, "file_name string")
    sized = scan.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        "length", "modificationTime")
    return listed.join(sized, "file_name", "left").withColumn(
        "length", F.coalesce("length", F.lit(0)))


def discover_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """One row: candidate files, their size, the manifest gate, status and verdict."""
    name = F.lower("file_name")
    ext = F.concat(F.lit("."), F.element_at(F.split(name, "\\."), -1))
    is_manifest = name.contains("manifest")
    files = list_files(spark, folder).withColumns({
        "_candidate": ext.isin(*names.SUPPORTED_EXTENSIONS) & ~is_manifest,
        "_metadata": is_manifest | name.contains("metadata") | name.contains("readme"),
    })
    text = spark.read.format("binaryFile").option("pathGlobFilter", MANIFEST).load(folder).select(
        F.col("content").cast("string").alias("m"))
    gate = text.agg(
        F.max(F.upper(F.get_json_object("m", "$.access_type"))).alias("access_type"),
        F.max(F.get_json_object("m", "$.status")).alias("manifest_status"),
        F.max(F.get_json_object("m", "$.access_status")).alias("access_status"))
    found = files.agg(
        F.count_if("_candidate").alias("file_count"),
        F.coalesce(F.sum(F.when(F.col("_candidate"), F.col("length"))), F.lit(0))
        .alias("total_bytes"),
        F.count_if(F.col("_candidate") & (F.col("length") == 0)).alias("empty_files"),
        F.count_if("_metadata").alias("metadata_files"),
        F.coalesce(F.bool_or(F.col("file_name") == MANIFEST), F.lit(False))
        .alias("manifest_present"))
    found = found.withColumns({
        n: gate.select(n).scalar() for n in ("access_type", "manifest_status", "access_status")})
    blocked = (F.coalesce(F.col("access_type").contains("ACCESS REQUIRED"), F.lit(False))
               | F.coalesce(F.col("manifest_status") == "blocked", F.lit(False)))
    none = F.col("file_count") == 0
    empty = (F.col("file_count") == 1) & (F.col("empty_files") == 1)
    return found.select(
        "file_count", "total_bytes", "empty_files", "metadata_files", "manifest_present",
        F.when(none, "missing").when(empty, "invalid").when(blocked, "blocked")
        .otherwise("candidate_found").alias("status"),
        F.when(none, "REAL DATASET REQUIRED").when(empty, "REAL DATASET FOUND BUT INVALID")
        .when(blocked, "REAL DATASET REQUIRED")
        .otherwise("REAL DATASET FOUND -- VALIDATION REQUIRED").alias("verdict"),
        F.when(none, F.coalesce("access_status", F.lit("NONE"))).when(empty, "INVALID_CORRUPT")
        .when(blocked, "ACCESS REQUIRED").otherwise(F.coalesce("access_status", F.lit("READY")))
        .alias("access_status"),
        (~none & ~empty & ~blocked).alias("labeled_dataset_available"),
    )


def candidate_files(spark: SparkSession, folder: str) -> DataFrame:
    """Candidate data files with size and whether they are empty."""
    name = F.lower("file_name")
    ext = F.concat(F.lit("."), F.element_at(F.split(name, "\\."), -1))
    return list_files(spark, folder).filter(
        ext.isin(*names.SUPPORTED_EXTENSIONS) & ~name.contains("manifest")
    ).select("file_name", F.col("length").alias("size"), (F.col("length") == 0).alias("is_empty"))


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Content hash of a table that does not depend on row order or partitioning.

    A row's hash is 60 bits of the md5 of its values as text, each with its length before it and nulls as ``-``, so other
    engines can repeat it and values can't run into each other."""
    def framed(c: str):
        value = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    text = F.concat(*[framed(c) for c in df.columns])
    h = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(F.pmod("h", F.lit(1 << 20))), F.lit(0)).alias("sum_hash"),
    )
