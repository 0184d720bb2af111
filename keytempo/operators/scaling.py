"""Feature scaling, label encoding and class weights, all fitted on the training rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo.operators.groups import exact_quantiles, ordered_rank


def fit_scaler(train: DataFrame, features: Sequence[str], kind: str = "standard") -> DataFrame:
    """Parameters as rows (feature, centre, scale); a scale of 0 becomes 1.

    ``standard`` uses mean and population deviation, ``robust`` median and interquartile range.
    """
    if kind == "robust":
        wanted = {f"{name}{i}": (f, p) for i, f in enumerate(features)
                  for name, p in (("a", 0.25), ("b", 0.5), ("c", 0.75))}
        wide = exact_quantiles(train, [], wanted)
        pairs = [(F.col(f"b{i}"), F.col(f"c{i}") - F.col(f"a{i}")) for i in range(len(features))]
    elif kind == "standard":
        aggs = []
        for i, f in enumerate(features):
            aggs += [F.avg(f).alias(f"m{i}"), F.stddev_pop(f).alias(f"s{i}")]
        wide = train.agg(*aggs)
        pairs = [(F.col(f"m{i}"), F.col(f"s{i}")) for i in range(len(features))]
    else:
        raise ValueError(f"unknown scaler {kind!r}")
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), centre.alias("centre"),
                 F.when((scale == 0) | scale.isNull(), 1.0).otherwise(scale).alias("scale"))
        for f, (centre, scale) in zip(features, pairs, strict=True)
    ])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def _fitted(params: DataFrame) -> Column:
    """The parameters as one map from feature to (centre, scale), looked up while the plan runs."""
    pair = F.struct("feature", F.struct("centre", "scale"))
    return params.agg(F.map_from_entries(F.collect_list(pair)).alias("m")).scalar()


def apply_scaler(df: DataFrame, params: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scale ``features`` in place."""
    def scaled(f: str) -> Column:
        p = F.element_at("_fitted", F.lit(f))
        return (F.col(f) - p["centre"]) / p["scale"]

    return df.withColumn("_fitted", _fitted(params)).withColumns({f: scaled(f) for f in features}).drop("_fitted")


def fit_window_scaler(
    windows: DataFrame, features: Sequence[str], kind: str = "standard", values: str = "values"
) -> DataFrame:
    """Fit over all time steps of all training windows."""
    steps = windows.select(F.explode(values).alias("v")).select(*[
        F.col("v")[i].cast("double").alias(f) for i, f in enumerate(features)])
    return fit_scaler(steps, features, kind)


def apply_window_scaler(
    windows: DataFrame, params: DataFrame, features: Sequence[str], values: str = "values"
) -> DataFrame:
    """Scale every time step inside the window arrays."""
    fitted = F.array(*[F.element_at("_fitted", F.lit(f)) for f in features])

    def step(v: Column) -> Column:
        return F.array(*[
            ((v[i].cast("double") - F.col("_pairs")[i]["centre"]) / F.col("_pairs")[i]["scale"]).cast("float")
            for i in range(len(features))
        ])

    return (windows.withColumn("_fitted", _fitted(params)).withColumn("_pairs", fitted)
            .withColumn(values, F.transform(values, step)).drop("_fitted", "_pairs"))


def save_scaler(params: DataFrame, path: str) -> None:
    params.write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def label_mapping(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct labels as rows (label, label_id), however many there are."""
    found = df.filter(F.col(label).isNotNull()).select(
        F.col(label).cast("string").alias("label")).distinct()
    return ordered_rank(found, ["label"], "label_id").withColumn("label_id", F.col("label_id").cast("int"))


def encode_labels(
    df: DataFrame, label: str, mapping: DataFrame | Mapping[str, int] | None = None,
    out: str = "label_id",
) -> DataFrame:
    """Add the class number; missing and unknown labels become -1."""
    if isinstance(mapping, Mapping):
        table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
        code = F.element_at(table, F.col(label).cast("string"))
        return df.withColumn(out, F.coalesce(code.cast("int"), F.lit(-1)))
    mapping = mapping if mapping is not None else label_mapping(df, label)
    named = mapping.select(F.col("label").alias("_label"), F.col("label_id").alias(out))
    joined = df.withColumn("_label", F.col(label).cast("string")).join(
        named, "_label", "left").drop("_label")
    return joined.withColumn(out, F.coalesce(out, F.lit(-1)))


def decode_labels(
    df: DataFrame, mapping: DataFrame, label_id: str = "label_id", out: str = "label"
) -> DataFrame:
    """Add the label of a class number; unknown numbers become ``unassigned``."""
    named = mapping.select(F.col("label_id").alias("_id"), F.col("label").alias(out))
    joined = df.withColumn("_id", F.col(label_id)).join(named, "_id", "left")
    return joined.drop("_id").withColumn(out, F.coalesce(out, F.lit("unassigned")))


def inspect_labels(df: DataFrame, label: str) -> DataFrame:
    """Count and share per label, with the number of classes and of missing labels."""
    counts = df.groupBy(F.col(label).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("class_count"))
    known = F.when(F.col("label").isNotNull(), F.col("class_count"))
    missing = F.when(F.col("label").isNull(), F.col("class_count"))
    total = counts.agg(F.struct(F.sum(known).alias("valid"), F.count("label").alias("classes"),
                                F.coalesce(F.sum(missing), F.lit(0)).alias("nulls")).alias("t")).scalar()
    return counts.filter(F.col("label").isNotNull()).withColumn("_total", total).withColumns({
        "class_proportion": F.round(F.col("class_count") / F.greatest(F.col("_total.valid"), F.lit(1)), 4),
        "num_classes": F.col("_total.classes"), "null_count": F.col("_total.nulls")}).drop("_total")


def class_weights(train: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c)."""
    counts = train.filter(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("class_count"))
    total = counts.agg(F.struct(F.sum("class_count").alias("rows"), F.count(F.lit(1)).alias("classes")).alias("t")).scalar()
    return counts.withColumn("_total", total).withColumn(
        "class_weight", F.col("_total.rows") / (F.col("_total.classes") * F.col("class_count"))).drop("_total")
