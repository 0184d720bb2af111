"""Ordered work and exact quantiles on groups of any size.

Most sessions and people are small, a few may hold a third of all rows.  ``over_groups`` counts the rows of each group
(partial counts are combined before the shuffle) and asks whether any group is above ``GROUP_ROWS``.

* Usually none is: the body runs on plain window functions, one exchange and one sort.
* Otherwise the large groups go to ``LargeGroups``, which cuts each of them into segments along the order column.  Windows
  then run per (group, segment), and what must cross a segment border (totals, the last few rows, the last value seen)
  travels in one small row per segment.

The limit is one constant at every size, so a task never sorts more than that.  Only the answer to "is there a large
group" reaches the driver.  Lists of large keys, their quantiles and cut points are joined by key: Spark broadcasts such
a side when it has measured that it is small, and shuffles it otherwise.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GROUP_ROWS = 250_000
#: Segments that one round cuts a group or a segment into, at most; and the step between the numbers of a round.
CUTS, STEP = 1024, 2048
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")

_SEG, _START = "_seg", "_start"


def large_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > limit)
        .select(*keys)
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.  Only a one-process session may use its own temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="keytempo-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that later steps reread it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def ordered_rank(df: DataFrame, order: Sequence[str], rank: str) -> DataFrame:
    """Number all rows from 0 in the order of ``order`` without gathering them.

    Rows are dealt to ranges and sorted there; a row's number is its place in its range plus the sizes of the ranges before,
    one number per partition.  Written once, as ranges may come out differently when they are computed again.
    """
    number = F.monotonically_increasing_id()
    placed = pin(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumns({"_part": F.shiftright(number, 33), "_at": number.bitwiseAND(F.lit((1 << 33) - 1))}))
    line = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_start"))
    return (placed.join(F.broadcast(starts), "_part")  # a row per partition
            .withColumn(rank, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"))


def over_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    body: Callable[["SmallGroups | LargeGroups"], DataFrame],
    limit: int | None = None,
    colocate: bool = False,
) -> DataFrame:
    """Run ``body`` over all groups of ``df``.

    ``order`` names the columns that order a group.  The first must be numeric, a date or a
    timestamp, the last ones break ties.  ``colocate`` shuffles small groups once by the group
    keys so that windows over finer keys need no second exchange.  Rows with a missing key
    belong to no group and are left out.
    """
    keys = list(keys)
    df = df.dropna(subset=keys)
    limit = GROUP_ROWS if limit is None else limit
    big = large_keys(df, keys, limit)
    if big.isEmpty():
        return body(SmallGroups(df.repartition(*keys) if colocate else df, keys, order))
    big = pin(big)
    small = df.join(big, keys, "left_anti")
    # Written once, so that no later step scans the whole input again for its large groups.
    large = pin(df.join(big, keys, "left_semi"))
    return body(SmallGroups(small.repartition(*keys) if colocate else small, keys, order))\
        .unionByName(body(LargeGroups(large, keys, order, limit)))


class SmallGroups:
    """Groups that fit a task: window functions and built-in exact percentiles."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()):
        self.rows, self.keys, self.order = rows, list(keys), list(order)

    def derive(
        self,
        df: DataFrame,
        within: Sequence[str] = (),
        number: str | None = None,
        rows: str | None = None,
        shift: Mapping[str, tuple[str, int]] | None = None,
        sums: Mapping[str, Column] | None = None,
        last: Mapping[str, Column] | None = None,
        first: Mapping[str, str] | None = None,
        stats: Mapping[str, str] | None = None,
    ) -> DataFrame:
        """Add columns that look at other rows of the same group.

        number  0-based position
        rows    number of rows of the group
        shift   value ``k`` rows earlier (later when ``k`` is negative)
        sums    running sum up to and including the row
        last    last non-null value on strictly earlier rows
        first   value on the first row of the group
        stats   ``<name>_n``, ``_mean`` and ``_std`` (sample) over strictly earlier rows
        ``within`` makes the groups finer.
        """
        part = Window.partitionBy(*self.keys, *within)
        w = part.orderBy(*self.order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        added: dict[str, Column] = {}
        if number:
            added[number] = F.row_number().over(w).cast("long") - 1
        if rows:
            added[rows] = F.count(F.lit(1)).over(part)
        for new, (col, k) in (shift or {}).items():
            added[new] = F.lag(col, k).over(w) if k > 0 else F.lead(col, -k).over(w)
        for new, expr in (sums or {}).items():
            added[new] = F.coalesce(F.sum(expr).over(upto), F.lit(0))
        for new, expr in (last or {}).items():
            added[new] = F.last(expr, ignorenulls=True).over(before)
        for new, col in (first or {}).items():
            added[new] = F.first(col).over(upto)
        for name, col in (stats or {}).items():
            added[f"{name}_n"] = F.count(col).over(before)
            added[f"{name}_mean"] = F.avg(col).over(before)
            added[f"{name}_std"] = F.stddev_samp(col).over(before)
        return df.withColumns(added)

    def aggregate(
        self,
        df: DataFrame,
        plain: Mapping[str, Column],
        quantiles: Mapping[str, tuple[str, float]] | None = None,
        mads: Mapping[str, str] | None = None,
    ) -> DataFrame:
        """One row per group: plain aggregates, exact quantiles, median absolute deviations."""
        quantiles, mads = dict(quantiles or {}), dict(mads or {})
        centred = {
            f"_centre_{col}": F.median(col).over(Window.partitionBy(*self.keys))
            for col in sorted(set(mads.values()))
        }
        if centred:
            df = df.withColumns(centred)
        by_column: dict[str, list[float]] = {}
        for col, p in quantiles.values():
            by_column.setdefault(col, [])
            if p not in by_column[col]:
                by_column[col].append(p)
        aggs = [expr.alias(name) for name, expr in plain.items()]
        aggs += [F.percentile(F.col(c), F.array(*map(F.lit, ps))).alias(f"_q_{c}")
                 for c, ps in by_column.items()]
        aggs += [F.median(F.abs(F.col(c) - F.col(f"_centre_{c}"))).alias(name)
                 for name, c in mads.items()]
        out = df.groupBy(*self.keys).agg(*aggs)
        picked = [F.col(f"_q_{c}")[by_column[c].index(p)].alias(name)
                  for name, (c, p) in quantiles.items()]
        return out.select(*self.keys, *plain, *picked, *mads)


class LargeGroups:
    """The same operations on groups too large for one task.

    ``rows`` carries a segment number that never decreases along the order.  ``derive`` builds
    one summary row per segment, sums or looks up over the summaries of a
    group, joins the result back as the carry of a segment and finishes inside the segment.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int):
        self.keys, self.order, self.limit = list(keys), list(order), limit
        self.rows = cut(rows, self.keys, self.order, limit) if self.order else rows
        self._derived = False

    def derive(
        self, df, within=(), number=None, rows=None, shift=None, sums=None, last=None,
        first=None, stats=None,
    ) -> DataFrame:
        if self._derived:
            df = pin(df)
        self._derived = True
        shift, sums, last = dict(shift or {}), dict(sums or {}), dict(last or {})
        first, stats = dict(first or {}), dict(stats or {})
        keys = [*self.keys, *within]
        part = Window.partitionBy(*keys, _SEG)
        w = part.orderBy(*self.order)
        at = F.struct(*self.order)
        back = max((k for _, k in shift.values() if k > 0), default=0)
        ahead = max((-k for _, k in shift.values() if k < 0), default=0)
        shifted = sorted({col for col, _ in shift.values()})
        df = df.withColumns({
            "_i": F.row_number().over(w) - 1,
            "_left": F.count(F.lit(1)).over(part) - F.row_number().over(w),
        })

        # One row per segment.
        near = F.struct(F.col("_i").alias("i"), *shifted) if shifted else None
        aggs = [F.count(F.lit(1)).alias("_n")]
        if back:
            aggs.append(F.array_sort(F.collect_list(F.when(F.col("_left") < back, near)))
                        .alias("_tail"))
        if ahead:
            aggs.append(F.array_sort(F.collect_list(F.when(F.col("_i") < ahead, near)))
                        .alias("_head"))
        aggs += [F.coalesce(F.sum(e), F.lit(0)).alias(f"_sum_{n}") for n, e in sums.items()]
        aggs += [F.max_by(e, F.when(e.isNotNull(), at)).alias(f"_last_{n}")
                 for n, e in last.items()]
        aggs += [F.min_by(F.struct(F.col(c).alias("v")), at).alias(f"_first_{n}")
                 for n, c in first.items()]
        for n, c in stats.items():
            aggs += [F.count(c).alias(f"_cnt_{n}"), F.avg(c).alias(f"_avg_{n}"),
                     (F.var_pop(c) * F.count(c)).alias(f"_m2_{n}")]
        summary = df.groupBy(*keys, _SEG).agg(*aggs)

        # What a segment inherits from its neighbours.
        line = Window.partitionBy(*keys).orderBy(_SEG)
        earlier = line.rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*keys)
        carry: dict[str, Column] = {
            "_c_n": F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
            "_c_rows": F.sum("_n").over(whole),
        }
        if back:
            carry["_c_tail"] = F.flatten(
                F.collect_list("_tail").over(line.rowsBetween(-back, -1)))
        if ahead:
            carry["_c_head"] = F.flatten(
                F.collect_list("_head").over(line.rowsBetween(1, ahead)))
        for n in sums:
            carry[f"_c_sum_{n}"] = F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0))
        for n in last:
            carry[f"_c_last_{n}"] = F.last(f"_last_{n}", ignorenulls=True).over(earlier)
        for n in first:
            carry[f"_c_first_{n}"] = F.first(f"_first_{n}").over(
                line.rowsBetween(Window.unboundedPreceding, 0))
        for n in stats:
            centre = (F.sum(F.col(f"_cnt_{n}") * F.col(f"_avg_{n}")).over(whole)
                      / F.sum(f"_cnt_{n}").over(whole))
            carry[f"_c_centre_{n}"] = centre
        carried = summary.withColumns(carry)
        more: dict[str, Column] = {}
        for n in stats:
            off = F.col(f"_avg_{n}") - F.col(f"_c_centre_{n}")
            cnt = F.col(f"_cnt_{n}")
            more[f"_c_cnt_{n}"] = F.coalesce(F.sum(cnt).over(earlier), F.lit(0))
            more[f"_c_off_{n}"] = F.coalesce(F.sum(cnt * off).over(earlier), F.lit(0.0))
            more[f"_c_sq_{n}"] = F.coalesce(
                F.sum(F.col(f"_m2_{n}") + cnt * off * off).over(earlier), F.lit(0.0))
        carried = carried.withColumns(more) if more else carried
        carries = [*carry, *more]
        out = df.join(carried.select(*keys, _SEG, *carries), [*keys, _SEG])

        # Finish inside the segment.
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        added: dict[str, Column] = {}
        if number:
            added[number] = F.col("_c_n") + F.col("_i")
        if rows:
            added[rows] = F.col("_c_rows")
        for new, (col, k) in shift.items():
            if k > 0:
                far = F.try_element_at("_c_tail", (F.col("_i") - k).cast("int"))[col]
                added[new] = F.when(F.col("_i") >= k, F.lag(col, k).over(w)).otherwise(far)
            else:
                far = F.try_element_at("_c_head", (F.lit(-k) - F.col("_left")).cast("int"))[col]
                added[new] = F.when(F.col("_left") >= -k, F.lead(col, -k).over(w)).otherwise(far)
        for new, expr in sums.items():
            added[new] = F.coalesce(F.sum(expr).over(upto), F.lit(0)) + F.col(f"_c_sum_{new}")
        for new, expr in last.items():
            added[new] = F.coalesce(
                F.last(expr, ignorenulls=True).over(before), F.col(f"_c_last_{new}"))
        for new in first:
            added[new] = F.col(f"_c_first_{new}.v")
        for n, col in stats.items():
            centre = F.col(f"_c_centre_{n}")
            off = F.col(col) - centre
            count = F.col(f"_c_cnt_{n}") + F.count(col).over(before)
            total = F.col(f"_c_off_{n}") + F.coalesce(F.sum(off).over(before), F.lit(0.0))
            square = F.col(f"_c_sq_{n}") + F.coalesce(F.sum(off * off).over(before), F.lit(0.0))
            spread = F.greatest(square - total * total / count, F.lit(0.0))
            added[f"{n}_n"] = count
            added[f"{n}_mean"] = F.when(count > 0, centre + total / count)
            added[f"{n}_std"] = F.when(count > 1, F.sqrt(spread / (count - 1)))
        return out.withColumns(added).drop("_i", "_left", *carries)

    def aggregate(self, df, plain, quantiles=None, mads=None) -> DataFrame:
        quantiles, mads = dict(quantiles or {}), dict(mads or {})
        if quantiles or mads:
            df = pin(df)
        out = df.groupBy(*self.keys).agg(*[e.alias(n) for n, e in plain.items()])
        centre = {f"_centre_{c}": (c, 0.5) for c in sorted(set(mads.values()))}
        if quantiles or centre:
            found = pin(exact_quantiles(df, self.keys, {**quantiles, **centre}, self.limit))
            out = out.join(found, self.keys, "left")
        if mads:
            centres = found.select(*self.keys, *centre)
            distances = df.join(centres, self.keys).select(
                *self.keys,
                *[F.abs(F.col(c) - F.col(f"_centre_{c}")).alias(f"_dist_{c}")
                  for c in sorted(set(mads.values()))],
            )
            spread = exact_quantiles(
                distances, self.keys, {n: (f"_dist_{c}", 0.5) for n, c in mads.items()}, self.limit
            )
            out = out.join(spread, self.keys, "left")
        return out.select(*self.keys, *plain, *quantiles, *mads)


def cut(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows_per_segment: int
) -> DataFrame:
    """Add a segment number that never decreases along ``order`` inside a group.

    Cut points come from a mergeable quantile sketch; any cut points give right results, good ones give even segments.  A
    round cuts what is above ``rows_per_segment`` into at most CUTS parts, and rounds go on until nothing is above it, so
    the number of segments follows the rows of a group.  A value of the first column that fills several steps of the sketch
    (many equal times) becomes a part of its own; the next round cuts it by the next column that is a number.
    """
    keys = list(keys)
    kinds = dict(df.dtypes)
    columns = [order[0], *[c for c in order[1:] if kinds[c] in NUMBERS]]
    df = df.withColumn(_SEG, F.lit(0).cast("long"))
    for _ in range(5):  # five rounds number 2**55 segments
        sizes = df.groupBy(*keys, _SEG).agg(
            F.count(F.lit(1)).alias("_rows"),
            *[(F.min(c) < F.max(c)).alias(f"_wide{i}") for i, c in enumerate(columns)])
        by = F.lit(None).cast("int")
        for i in reversed(range(len(columns))):
            by = F.when(F.coalesce(F.col(f"_wide{i}"), F.lit(False)), i).otherwise(by)
        crowded = pin(sizes.where(F.col("_rows") > rows_per_segment).withColumn("_by", by)
                      .where("_by is not null").select(*keys, _SEG, "_rows", "_by"))
        if crowded.isEmpty():
            break
        df = _recut(df, crowded, keys, columns, rows_per_segment)
    return df


def _recut(df, crowded, keys, columns, rows_per_segment) -> DataFrame:
    """One round: number the parts of crowded segments inside their segment's step."""
    at = [*keys, _SEG]
    marked = df.join(crowded, at, "left")
    number = F.lit(0)
    for i, column in enumerate(columns):
        chosen = F.col("_by") == i
        points = (marked.where(chosen).groupBy(*at)
                  .agg(F.first("_rows").alias("_total"), _points(column).alias("_points")))
        repeated = F.array_distinct(F.filter(
            F.col("_points"), lambda x, j: (j > 0) & (x == F.get(F.col("_points"), j - 1))))
        points = points.select(*at, repeated.alias(f"_ties{i}"), F.array_sort(F.array_distinct(F.concat(
            _thinned(F.col("_points"), F.col("_total"), rows_per_segment), repeated))).alias(f"_cuts{i}"))
        marked = marked.join(points, at, "left")
        tied = F.coalesce(F.array_contains(f"_ties{i}", F.col(column)), F.lit(False))
        number = F.when(chosen, _cuts_below(F.col(f"_cuts{i}"), F.col(column)) * 2 + tied.cast("int")).otherwise(number)
    number = F.coalesce(number, F.lit(0)).cast("long")
    # Written once: a sketch may give other cut points when it is computed again.
    return pin(marked.withColumn(_SEG, F.col(_SEG) * STEP + number).select(*df.columns))


def _points(column: str) -> Column:
    return F.percentile_approx(column, F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)]))


def _thinned(points: Column, rows: Column, rows_per_segment: int) -> Column:
    """Every n-th cut point, so that a segment has about ``rows_per_segment`` rows."""
    wanted = F.ceil(rows / F.lit(rows_per_segment)) + 1
    stride = F.greatest(F.lit(1), F.floor(F.lit(CUTS) / wanted)).cast("int")
    return F.array_distinct(F.filter(points, lambda _, i: (i + 1) % stride == 0))


def _cuts_below(cuts: Column, value: Column) -> Column:
    """How many of the ascending cut points lie below ``value`` (binary search)."""
    steps = F.array(*[F.lit(CUTS >> i) for i in range(CUTS.bit_length())])
    found = F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size(cuts)) & (F.try_element_at(cuts, at + step) < value), at + step
        ).otherwise(at),
    )
    return F.coalesce(found, F.lit(0))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    rows_per_segment: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group without gathering a group.

    Equal values are counted before and after the shuffle, distinct values are cut into
    segments, and only the segments that hold a wanted rank are ranked row by row.
    ``keys`` may be empty: then the result is one row for the whole input.  Meant for few large
    groups; the value counts are written to the checkpoint folder and reread.
    """
    columns = sorted({col for col, _ in wanted.values()})
    probabilities = {c: sorted({p for col, p in wanted.values() if col == c}) for c in columns}
    by = [*keys, "_metric"]
    long = df.select(
        *keys,
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("_metric"), F.col(c).cast("double").alias("_value"))
            for c in columns
        ])).alias("_m"),
    ).select(*keys, "_m.*").filter(F.col("_value").isNotNull())
    counted = pin(long.groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_w")))
    pieces = cut(counted, by, ["_value"], rows_per_segment or GROUP_ROWS)

    per_segment = pieces.groupBy(*by, _SEG).agg(F.sum("_w").alias("_t"))
    earlier = Window.partitionBy(*by).orderBy(_SEG).rowsBetween(Window.unboundedPreceding, -1)
    segments = per_segment.withColumns({
        _START: F.coalesce(F.sum("_t").over(earlier), F.lit(0)),
        "_total": F.sum("_t").over(Window.partitionBy(*by)),
    })

    every = sorted({p for ps in probabilities.values() for p in ps})
    low = {p: F.floor((F.col("_total") - 1) * F.lit(p)) for p in every}
    high = {p: F.ceil((F.col("_total") - 1) * F.lit(p)) for p in every}
    holds = F.lit(False)
    for p in every:
        holds |= (F.col(_START) <= high[p]) & (F.col(_START) + F.col("_t") > low[p])
    ranked = pieces.join(segments.filter(holds).drop("_t"), [*by, _SEG])
    upto = (Window.partitionBy(*by, _SEG).orderBy("_value")
            .rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("_to", F.sum("_w").over(upto) + F.col(_START))
    ranked = ranked.withColumn("_from", F.col("_to") - F.col("_w"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_value")))

    picks = ranked.groupBy(*by).agg(
        F.max("_total").alias("_total"),
        *[at(low[p]).alias(f"_lo{i}") for i, p in enumerate(every)],
        *[at(high[p]).alias(f"_hi{i}") for i, p in enumerate(every)],
    )
    position = {p: (F.col("_total") - 1) * F.lit(p) for p in every}
    values = picks.select(*by, *[
        (F.col(f"_lo{i}")
         + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (position[p] - F.floor(position[p])))
        .alias(f"_p{i}")
        for i, p in enumerate(every)
    ])
    return values.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_metric") == col, F.col(f"_p{every.index(p)}"))).alias(name)
        for name, (col, p) in wanted.items()
    ])
