"""Baselines that are kept up to date from new sessions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo import names
from keytempo.functions import columns as c
from keytempo.operators.baselines import MIN_SESSIONS
from keytempo.operators.value_counts import band_of, statistics
from keytempo.streaming.keyed import ROWS_PER_BUCKET, KeyedTable

PERSON, SESSION = "user_id", "session_id"
#: The entry that counts the sessions of a person, whatever features they have.
SESSIONS = "(sessions)"
_VALUES = "user_id string, feature string, band long, v array<double>, n array<bigint>, rows long"
_BASE = ("user_id string, feature string, session_count long, mean double, std double, median double, mad double, iqr double, "
         "min double, max double, sample_count long")


class IncrementalBaselines:
    """Baselines per person and feature in keyed tables; a batch of sessions updates them without reading older sessions.

    ``values`` holds the value counts of a person and feature, cut into bands: counts add up and can be taken back, so medians
    and MADs stay exact.  A person has a bounded number of bands and lies in one bucket.  ``sessions`` remembers what a session
    has put in, for a session that is sent again.  A batch reads and rewrites the buckets of its sessions and persons only.
    ``baselines`` holds the statistics of persons with ``min_sessions`` sessions or more.

    Batches have increasing numbers; one that is run again, or was cut short, gives the same tables.  A batch has one row per
    session; rows without person or session are left out.
    """

    def __init__(self, spark: SparkSession, path: str, features: Sequence[str] = names.BASELINE_FEATURES,
                 min_sessions: int = MIN_SESSIONS, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.features, self.min_sessions = list(features), min_sessions
        self.sessions = KeyedTable(spark, f"{path}/sessions", f"{PERSON} string, {SESSION} string, x array<double>",
                                   rows_per_bucket=rows_per_bucket)
        self.values = KeyedTable(spark, f"{path}/values", _VALUES, rows_per_bucket=rows_per_bucket, cluster=[PERSON])
        self.baselines = KeyedTable(spark, f"{path}/baselines", _BASE, rows_per_bucket=rows_per_bucket, cluster=[PERSON])

    def update(self, new: DataFrame, batch_id: int) -> None:
        cells = [c.number(f) if f in new.columns else F.lit(None).cast("double") for f in self.features]
        new = new.filter(F.col(PERSON).isNotNull() & F.col(SESSION).isNotNull()).select(
            F.col(PERSON).cast("string").alias(PERSON), F.col(SESSION).cast("string").alias(SESSION),
            F.array(*cells).alias("x")).persist()
        try:
            if self.values.directory().batch < batch_id:
                self.values.merge(self._changed(new), batch_id, [PERSON, "feature", "band"], "rows")
            if self.baselines.directory().batch < batch_id:
                self.baselines.merge(self._statistics(new), batch_id, [PERSON, "feature"], "sample_count")
            # Last, because the difference to what a session has put in before is needed until then.
            self.sessions.merge(new, batch_id, [PERSON, SESSION], "x")
        finally:
            new.unpersist()

    def _cells(self, sessions: DataFrame, sign: int) -> DataFrame:
        entries = F.array(
            *[F.struct(F.lit(f).alias("feature"), F.col("x")[i].alias("value")) for i, f in enumerate(self.features)],
            F.struct(F.lit(SESSIONS).alias("feature"), F.lit(0.0).alias("value")))
        cells = sessions.select(PERSON, F.explode(entries).alias("e")).select(PERSON, "e.*", F.lit(sign).cast("long").alias("n"))
        return cells.filter("value IS NOT NULL").withColumn("value", F.col("value") + 0.0)

    @staticmethod
    def _counted(values: DataFrame) -> DataFrame:
        return values.select(PERSON, "feature", "band", F.explode(F.arrays_zip("v", "n")).alias("e")).select(
            PERSON, "feature", "band", F.col("e.v").alias("value"), F.col("e.n").alias("n"))

    def _changed(self, new: DataFrame) -> DataFrame:
        """The new content of all bands that the batch changes."""
        change = self._cells(new, 1).unionByName(self._cells(self.sessions.lookup(new), -1)).groupBy(PERSON, "feature", "value").agg(
            F.sum("n").alias("n")).filter("n <> 0").withColumn("band", band_of(F.col("value")))
        bands = change.select(PERSON, "feature", "band").distinct()
        now = self._counted(self.values.lookup(bands)).unionByName(change.select(PERSON, "feature", "band", "value", "n"))
        left = now.groupBy(PERSON, "feature", "band", "value").agg(F.sum("n").alias("n"))
        held = F.filter(F.array_sort(F.collect_list(F.struct("value", "n"))), lambda e: e["n"] > 0)
        return left.groupBy(PERSON, "feature", "band").agg(held.alias("e")).select(
            PERSON, "feature", "band", F.transform("e", lambda e: e["value"]).alias("v"), F.transform("e", lambda e: e["n"]).alias("n"),
            F.size("e").cast("long").alias("rows"))

    def _statistics(self, new: DataFrame) -> DataFrame:
        """The baselines of the persons in a batch, from their value counts."""
        counted = self._counted(self.values.lookup(new.select(PERSON)))
        sessions = counted.filter(F.col("feature") == SESSIONS).groupBy(PERSON).agg(F.sum("n").alias("session_count")).filter(
            F.col("session_count") >= self.min_sessions)
        rows = counted.filter(F.col("feature") != SESSIONS).join(sessions.select(PERSON), PERSON, "left_semi")
        return statistics(rows, [PERSON, "feature"]).join(sessions, PERSON).select(*[f.split()[0] for f in _BASE.split(", ")])
