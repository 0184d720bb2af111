"""Sliding windows over the events of a session, and their summary vectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytempo import names
from keytempo.operators.events import feature_columns
from keytempo.operators.groups import over_groups
from keytempo.operators.pairing import KEYS, ORDER, key_rows, live_pairs

STATS = ("mean", "std", "median", "min", "max")


def _window_numbers(position: Column, length: int, stride: int) -> Column:
    """All windows a row belongs to: window ``k`` holds rows k*stride .. k*stride+length-1."""
    last = F.floor(position / stride)
    first = F.greatest(F.lit(0), F.ceil((position - (length - 1)) / stride))
    # A stride above the length leaves rows between windows.
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _collected(features: Sequence[str], fill: float | None) -> list[Column]:
    def cell(name: str) -> Column:
        value = F.col(name).cast("double")
        return F.coalesce(value, F.lit(fill)) if fill is not None else value

    vector = F.array(*[cell(n) for n in features]).cast("array<float>")
    return [F.transform(
        F.array_sort(F.collect_list(F.struct("_at", vector.alias("v")))), lambda x: x["v"]
    ).alias("values")]


def _summarised(features: Sequence[str]) -> list[Column]:
    def safe(x: Column) -> Column:
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
        return F.when(bad, 0.0).otherwise(x)

    out = []
    for n in features:
        v = F.coalesce(F.col(n).cast("double"), F.lit(0.0))
        per = {"mean": F.avg(v), "std": F.stddev_pop(v), "median": F.median(v), "min": F.min(v),
               "max": F.max(v)}
        out += [safe(per[s]).alias(f"{s}_{n}") for s in STATS]
    return out


@dataclass(frozen=True)
class Windows:
    """Windows of ``length`` consecutive events every ``stride`` events.

    ``label`` is the column whose first value in the session labels its windows, ``times`` the
    columns that give a window its start and end.
    """

    features: Sequence[str] = names.SEQUENCE_FEATURES
    length: int = 30
    stride: int = 10
    label: str | None = None
    times: tuple[str, str] | None = None
    fill: float | None = 0.0
    summary: bool = False

    def body(self, g, rows: DataFrame) -> DataFrame:
        """Body: every row is sent only to its length / stride windows.

        The group-by keys are the session keys plus the window number, so small sessions need
        no second exchange, and a group holds exactly ``length`` rows.
        """
        first = {"_label": self.label} if self.label else None
        rows = g.derive(rows, number="_at", first=first)
        rows = rows.withColumn("window_index", F.explode(
            _window_numbers(F.col("_at"), self.length, self.stride)))
        aggs = [F.count(F.lit(1)).alias("_rows")]
        aggs += _summarised(self.features) if self.summary else _collected(
            self.features, self.fill)
        if self.label:
            aggs.append(F.first("_label").alias("label"))
        if self.times:
            aggs += [F.min_by(self.times[0], "_at").alias("start_time"),
                     F.max_by(self.times[1], "_at").alias("end_time")]
        out = (rows.groupBy(*g.keys, "window_index").agg(*aggs)
               .filter(F.col("_rows") == self.length).drop("_rows"))
        return out.withColumns({
            "start_index": F.col("window_index") * self.stride,
            "end_index": F.col("window_index") * self.stride + self.length,
        })


def _over_events(
    df: DataFrame, spec: Windows, keys: Sequence[str], order: Sequence[str], limit: int | None
) -> DataFrame:
    wanted = {*keys, *order, *spec.features, *([spec.label] if spec.label else []),
              *(spec.times or ())}
    rows = df.select(*[n for n in df.columns if n in wanted])
    return over_groups(rows, keys, order, lambda g: spec.body(g, g.rows), limit)


def sliding_windows(
    df: DataFrame, features: Sequence[str] = names.SEQUENCE_FEATURES, length: int = 30,
    stride: int = 10, keys: Sequence[str] = KEYS, order: Sequence[str] = ("sequence_index",),
    label: str | None = None, times: tuple[str, str] | None = None, fill: float | None = 0.0,
    limit: int | None = None,
) -> DataFrame:
    """One row per window; ``values`` is an array of ``length`` float feature vectors.

    Windows never cross sessions, short sessions give none.  ``fill`` replaces missing values;
    None keeps them.
    """
    spec = Windows(features, length, stride, label, times, fill)
    return _over_events(df, spec, keys, order, limit)


def window_aggregates(
    df: DataFrame, features: Sequence[str] = names.SEQUENCE_FEATURES, length: int = 30,
    stride: int = 10, keys: Sequence[str] = KEYS, order: Sequence[str] = ("sequence_index",),
    label: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Mean, population std, median, min and max of each feature per window.

    Missing event values count as 0; results that are not finite become 0.
    """
    spec = Windows(features, length, stride, label, summary=True)
    return _over_events(df, spec, keys, order, limit)


def live_windows(raw: DataFrame, spec: Windows = Windows(), limit: int | None = None) -> DataFrame:
    """Windows straight from raw key events: pairing, features and windows in one shuffle."""

    def body(g):
        return spec.body(g, feature_columns(live_pairs(g, g.rows)))

    return over_groups(key_rows(raw), KEYS, ORDER, body, limit, colocate=True)


def window_hash(windows: DataFrame, values: str = "values") -> DataFrame:
    """Add a 64-bit content hash, to find equal windows in different partitions."""
    return windows.withColumn("window_hash", F.xxhash64(values))
