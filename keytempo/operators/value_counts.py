"""Statistics of counted values: exact quantiles by bands, for groups of any size, in mergeable form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bands per octave, and the exponent below which values share the band 0.
FINE, LEAST = 64, -40


def band_of(value: Column) -> Column:
    """A whole number that never falls as the value grows; a band spans 1.1 % of its values."""
    size = F.floor(F.log2(F.abs(value)) * FINE) - LEAST * FINE + 1
    return F.when(F.abs(value) < 2.0 ** LEAST, F.lit(0)).otherwise(F.signum(value) * size).cast("long")


def quantiles(rows: DataFrame, keys: Sequence[str], probabilities: dict[str, float], value: str = "value", n: str = "n") -> DataFrame:
    """One row per group with the linearly interpolated quantiles of ``value``, each counted ``n`` times.

    Counts per band (combined before the shuffle) show which band holds a rank; only these bands are sorted.
    """
    keys = list(keys)
    rows = rows.filter(F.col(value).isNotNull() & (F.col(n) > 0)).select(*keys, F.col(value).alias("_v"), F.col(n).alias("_n"))
    rows = rows.withColumn("_band", band_of(F.col("_v")))
    line = Window.partitionBy(*keys).orderBy("_band")
    bands = rows.groupBy(*keys, "_band").agg(F.sum("_n").alias("_in")).withColumns({
        "_before": F.coalesce(F.sum("_in").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_all": F.sum("_in").over(Window.partitionBy(*keys))})
    place = {name: (F.col("_all") - 1) * p for name, p in probabilities.items()}
    targets = F.array(*[F.struct(F.lit(f"{side}_{name}").alias("name"), end(at).cast("long").alias("rank"))
                        for name, at in place.items() for side, end in (("low", F.floor), ("high", F.ceil))])
    inside = F.filter(targets, lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_before") + F.col("_in")))
    wanted = bands.select(*keys, "_band", "_before", "_all", F.explode(inside).alias("_t")).select(
        *keys, "_band", "_all", "_t.name", (F.col("_t.rank") - F.col("_before")).alias("_rank"))
    values = rows.groupBy(*keys, "_band", "_v").agg(F.sum("_n").alias("_n")).join(wanted, [*keys, "_band"])
    upto = Window.partitionBy(*keys, "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = values.withColumn("_upto", F.sum("_n").over(upto)).filter(
        (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
    sides = found.groupBy(*keys).agg(F.first("_all").alias("_all"), *[
        F.max(F.when(F.col("name") == f"{side}_{name}", F.col("_v"))).alias(f"_{side}_{name}")
        for name in probabilities for side in ("low", "high")])

    def between(name: str, p: float) -> Column:
        low, high, at = F.col(f"_low_{name}"), F.col(f"_high_{name}"), (F.col("_all") - 1) * p
        return low + (high - low) * (at - F.floor(at))

    return sides.select(*keys, *[between(name, p).alias(name) for name, p in probabilities.items()])


def statistics(rows: DataFrame, keys: Sequence[str], value: str = "value", n: str = "n") -> DataFrame:
    """mean, std (sample), median, mad, iqr, min, max and sample_count of each group of counted values."""
    keys = list(keys)
    count, x = F.col(n), F.col(value)
    base = rows.groupBy(*keys).agg(
        F.sum(count).alias("sample_count"), (F.sum(x * count) / F.sum(count)).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    base = base.join(quantiles(rows, keys, {"_q1": 0.25, "median": 0.5, "_q3": 0.75}, value, n), keys)
    off = rows.join(base.select(*keys, "mean", "median"), keys).select(
        *keys, count.alias("n"), F.abs(x - F.col("median")).alias("value"), ((x - F.col("mean")) ** 2 * count).alias("_square"))
    spread = off.groupBy(*keys).agg(F.sum("_square").alias("_squares"))
    mad = quantiles(off, keys, {"mad": 0.5})
    one = F.col("sample_count") > 1
    return base.join(spread, keys).join(mad, keys).select(
        *keys, "mean", F.when(one, F.sqrt(F.col("_squares") / (F.col("sample_count") - 1))).otherwise(0.0).alias("std"),
        "median", "mad", (F.col("_q3") - F.col("_q1")).alias("iqr"), "min", "max", "sample_count")
