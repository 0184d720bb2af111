"""Noisy aggregates, retention, erasure, storage compliance, encryption and redaction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keytempo import names
from keytempo.functions import columns as c
from keytempo.operators.groups import over_groups

EPSILON = 1.0
REDACTED = "[REDACTED]"


def _epsilon(value: float) -> float:
    if value <= 0:
        raise ValueError(f"epsilon must be positive, got {value}")
    return float(value)


def _noise(scale: Column, seed: int | None, keys: Sequence[str]) -> Column:
    """Laplace noise; with a seed it depends on the group only, not on partitions or retries.

    Whoever knows seed and groups can take seeded noise off again: seeds are for tests.
    """
    if seed is None:
        return c.laplace(scale, F.rand())
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    steps = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")
    return c.laplace(scale, (steps.cast("double") + 0.5) / float(1 << 52))


def private_mean(
    df: DataFrame, col: str, bounds: tuple[float, float], epsilon: float = EPSILON,
    seed: int | None = None, keys: Sequence[str] = (),
) -> DataFrame:
    """Mean of clipped values plus Laplace noise, per group.  The true mean is not returned.

    ``sample_size``, and with it the sensitivity, is exact: where group sizes are secret, drop both and publish a
    ``private_count``.
    """
    low, high = map(float, bounds)
    if low >= high:
        raise ValueError(f"lower bound {low} must be below upper bound {high}")
    eps = _epsilon(epsilon)
    value = c.clip(c.number(col), low, high)
    out = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.count(value).alias("sample_size"))
    n = F.when(F.col("sample_size") > 0, F.col("sample_size")).otherwise(
        F.raise_error(F.lit("private mean of an empty group")).cast("long"))
    out = out.withColumn("sensitivity", F.lit(high - low) / n)
    out = out.withColumn("noise_scale", F.col("sensitivity") / eps)
    return out.select(
        *keys,
        (F.col("_mean") + _noise(F.col("noise_scale"), seed, keys)).alias("private_value"),
        F.lit(eps).alias("epsilon"), "sensitivity", "noise_scale", "sample_size",
        F.lit("Laplace").alias("mechanism"),
    )


def private_count(
    df: DataFrame, epsilon: float = EPSILON, seed: int | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Row count plus Laplace noise, at least 0.  The true count is not returned."""
    eps = _epsilon(epsilon)
    scale = F.lit(1.0 / eps)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return out.select(
        *keys,
        F.greatest(F.lit(0.0), F.col("_n") + _noise(scale, seed, keys)).alias("private_value"),
        F.lit(eps).alias("epsilon"), F.lit(1.0).alias("sensitivity"), scale.alias("noise_scale"),
        F.lit("Laplace").alias("mechanism"),
    )


def privacy_budget(log: DataFrame, keys: Sequence[str], epsilon: str = "epsilon") -> DataFrame:
    """Total epsilon and number of queries per key (sequential composition)."""
    return log.groupBy(*keys).agg(
        F.coalesce(F.sum(epsilon), F.lit(0.0)).alias("total_epsilon"),
        F.count(F.lit(1)).alias("query_count"))


def privacy_spending(
    log: DataFrame, keys: Sequence[str], order: Sequence[str], epsilon: str = "epsilon",
    limit: int | None = None,
) -> DataFrame:
    """The query log with the epsilon spent so far."""
    return over_groups(
        log, keys, order,
        lambda g: g.derive(g.rows, sums={"spent_epsilon": F.col(epsilon)}).drop("_seg"), limit)


def _policy(position: int, kind: Column) -> Column:
    table = F.create_map(*[
        F.lit(x) for name, policy in names.STORAGE_POLICIES.items()
        for x in (name, policy[position])])
    return F.coalesce(
        F.element_at(table, F.lower(F.trim(kind))), F.lit(names.DEFAULT_POLICY[position]))


def expired(
    df: DataFrame, now: datetime | Column | None = None, created: str = "created_at",
    kind: str = "artifact_type", days: int | None = None,
) -> DataFrame:
    """Add ``retention_days``, ``expires_at`` and ``is_expired``.

    Days come from the storage policy of the artifact type unless given.
    """
    at = now if isinstance(now, Column) else F.lit(now) if now else F.current_timestamp()
    keep = F.lit(days) if days is not None else _policy(3, F.col(kind))
    born = F.col(created).cast("timestamp")
    expiry = born + F.make_dt_interval(days=keep)
    return df.withColumns({
        "retention_days": keep.cast("int"), "expires_at": expiry, "is_expired": at >= expiry})


def drop_expired(df: DataFrame, **options) -> DataFrame:
    """Rows that stay after the retention clean-up."""
    marked = expired(df, **options)
    return marked.filter(~F.col("is_expired")).select(*df.columns)


def expired_files(
    spark: SparkSession, folder: str, days: int, now: datetime | Column | None = None
) -> DataFrame:
    """Files of a folder with age and whether they are past retention.  Reads no content."""
    files = spark.read.format("binaryFile").load(folder).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("created_at"))
    return expired(files, now, days=days)


def purge_counts(
    tables: Mapping[str, DataFrame], person: str, secret: str | None = None
) -> DataFrame:
    """Rows of a person in every id column of every table (dry run)."""
    counts = None
    for name, df in tables.items():
        for col in df.columns:
            if col not in names.PURGE_ID_COLUMNS:
                continue
            found = df.filter(F.col(col).cast("string") == _person(person, secret)).agg(
                F.lit(f"{name}.{col}").alias("table_column"),
                F.count(F.lit(1)).alias("records_found"))
            counts = found if counts is None else counts.unionByName(found)
    if counts is None:
        raise ValueError("no table has a person id column")
    return counts


def purge_user(
    tables: Mapping[str, DataFrame], person: str, secret: str | None = None
) -> dict[str, DataFrame]:
    """Tables without the rows of a person, ready to be rewritten."""
    out = {}
    for name, df in tables.items():
        for col in [n for n in df.columns if n in names.PURGE_ID_COLUMNS]:
            same = F.col(col).cast("string") == _person(person, secret)
            df = df.filter(~F.coalesce(same, F.lit(False)))
        out[name] = df
    return out


def _person(person: str, secret: str | None) -> Column:
    """The stored id: tables keep pseudonyms when a secret is used."""
    return c.pseudonym(F.lit(person), secret) if secret else F.lit(person)


def storage_compliance(artifacts: DataFrame) -> DataFrame:
    """Violations of the storage policy per artifact row.

    Needs ``artifact_type, has_raw_text, is_pseudonymized, is_encrypted``.  Unknown types get
    the strict default policy.
    """
    kind = F.col("artifact_type")
    found = c.reasons([
        (F.col("has_raw_text"), "raw_text"),
        (_policy(2, kind) & ~F.col("is_pseudonymized"), "not_pseudonymized"),
        (_policy(1, kind) & ~F.col("is_encrypted"), "not_encrypted"),
    ])
    out = artifacts.withColumns({
        "sensitivity_level": _policy(0, kind),
        "retention_days": _policy(3, kind),
        "violations": F.array_join(found, ","),
    })
    return out.withColumn("compliant", F.col("violations") == "")


def _key(key: bytes) -> Column:
    if len(key) not in (16, 24, 32):
        raise ValueError("the key must have 16, 24 or 32 bytes")
    return F.lit(bytearray(key))


def encrypt_columns(df: DataFrame, columns: Sequence[str], key: bytes) -> DataFrame:
    """AES-GCM with a random nonce per value, as base64 text."""
    return df.withColumns({
        n: F.base64(F.aes_encrypt(F.col(n).cast("string"), _key(key), F.lit("GCM")))
        for n in columns
    })


def decrypt_columns(df: DataFrame, columns: Sequence[str], key: bytes) -> DataFrame:
    """Reverse of ``encrypt_columns``; a changed value or wrong key fails the query."""
    return df.withColumns({
        n: F.aes_decrypt(F.unbase64(F.col(n)), _key(key), F.lit("GCM")).cast("string")
        for n in columns
    })


def decrypt_or_reject(
    df: DataFrame, columns: Sequence[str], key: bytes
) -> tuple[DataFrame, DataFrame]:
    """(decrypted rows, rows with a value that cannot be authenticated)."""
    plain = {n: F.try_aes_decrypt(F.unbase64(F.col(n)), _key(key), F.lit("GCM")) for n in columns}
    opened = df.withColumns({f"_open_{n}": e for n, e in plain.items()})
    bad = c.any_of(F.col(n).isNotNull() & F.col(f"_open_{n}").isNull() for n in columns)
    helpers = [f"_open_{n}" for n in columns]
    good = opened.filter(~bad).withColumns({
        n: F.col(f"_open_{n}").cast("string") for n in columns}).drop(*helpers)
    return good, opened.filter(bad).drop(*helpers)


def _sensitive(name: str) -> bool:
    low = name.lower().strip()
    return low in names.REDACTED_KEYS or any(p in low for p in names.REDACTED_PARTS)


def _redacted(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StructType):
        fields = []
        for f in dtype.fields:
            inner = value[f.name]
            hidden = F.when(inner.isNotNull(), F.lit(REDACTED))
            fields.append((hidden if _sensitive(f.name) else _redacted(inner, f.dataType))
                          .alias(f.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType) and isinstance(
            dtype.elementType, (T.StructType, T.MapType, T.ArrayType)):
        return F.transform(value, lambda x: _redacted(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        def entry(k: Column, v: Column) -> Column:
            low = F.lower(F.trim(k))
            hide = low.isin(*names.REDACTED_KEYS) | c.any_of(
                low.contains(p) for p in names.REDACTED_PARTS)
            kept = _redacted(v, dtype.valueType)
            if isinstance(dtype.valueType, T.StringType):
                return F.when(hide, F.lit(REDACTED)).otherwise(kept)
            return F.when(~hide, kept)  # no text fits the type: the value is removed
        return F.transform_values(value, entry)
    return value


def redact(df: DataFrame, column: str) -> DataFrame:
    """Hide values of sensitive keys in a map or nested struct, at any depth."""
    return df.withColumn(column, _redacted(F.col(column), df.schema[column].dataType))
