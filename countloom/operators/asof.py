"""As-of, first-reaching and overlap joins without range joins: unions with windows, and equi-joins on days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, on: str, values: Sequence[str], by: Sequence[str] = (), bucket: str | None = None) -> DataFrame:
    """Each left row with the ``values`` of the last right row at or before it; null where there is none.

    Both sides go through one sort per ``by`` group; right rows come first at equal times. A group that is large, or the
    whole table where ``by`` is empty, should name a ``bucket`` of time, such as a day: then a sort holds one bucket, and the last values
    of the buckets before come by a window over buckets.
    """
    own = [c for c in left.columns if c not in (on, *by)]
    marked = left.select(*by, on, *own, *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values], F.lit(1).alias("__side"))
    other = right.select(*by, on, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own], *values, F.lit(0).alias("__side"))
    both = marked.unionByName(other)
    part = list(by)
    if bucket:
        both, part = both.withColumn("__bucket", F.date_trunc(bucket, on)), [*by, "__bucket"]
    w = Window.partitionBy(*part).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    done = both.select(*part, on, *own, *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values], "__side").where("__side = 1")
    if not bucket:
        return done.drop("__side")
    lasts = both.groupBy(*part).agg(*[F.max(F.when((F.col("__side") == 0) & F.col(v).isNotNull(), F.struct(on, v)))[v].alias(f"__{v}") for v in values])
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    carried = lasts.select(*part, *[F.last(f"__{v}", ignorenulls=True).over(before).alias(f"__{v}") for v in values])
    return done.join(carried, part).select(*by, on, *own, *[F.coalesce(v, f"__{v}").alias(v) for v in values])


def first_reaching(levels: DataFrame, series: DataFrame, level: str, value: str, ts: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """For each level the first time at which the non-decreasing ``value`` is at least as high; null if never."""
    own = [c for c in levels.columns if c not in by]
    marked = levels.select(*by, *own, F.col(level).alias("__v"), F.lit(None).cast(series.schema[ts].dataType).alias("__t"), F.lit(1).alias("__side"))
    other = series.select(*by, *[F.lit(None).cast(levels.schema[c].dataType).alias(c) for c in own], F.col(value).alias("__v"), F.col(ts).alias("__t"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*by).orderBy(F.desc("__v"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    return marked.unionByName(other).withColumn(out, F.min("__t").over(w)).where("__side = 1").select(*by, *own, out)


def nearest_snapshot(targets: DataFrame, snapshots: DataFrame, target: str, ts: str, by: Sequence[str]) -> DataFrame:
    """Per group and target time the latest snapshot at or before it, else the earliest after it."""
    both = snapshots.crossJoin(F.broadcast(targets))  # a handful of stated target times
    before = F.max(F.when(F.col(ts) <= F.col(target), F.col(ts)))
    return both.groupBy(*by, target).agg(F.coalesce(before, F.min(ts)).alias("chosen"))


def overlap_days(intervals: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Per group and day: overlapping intervals, their total and their longest overlap, in microseconds.

    An interval goes to each day it meets by a sequence, so the join with the days is an equality.
    """
    day = F.explode(F.sequence(F.to_date(start), F.to_date(end)))
    parts = intervals.select(*by, start, end, day.alias("day"))
    lo = F.greatest(F.unix_micros(F.col(start).cast("timestamp")), F.unix_micros(F.col("day").cast("timestamp")))
    hi = F.least(F.unix_micros(F.col(end).cast("timestamp")), F.unix_micros(F.date_add("day", 1).cast("timestamp")))
    parts = parts.withColumn("us", hi - lo).where("us > 0")
    return parts.groupBy(*by, "day").agg(F.count("*").alias("intervals"), F.sum("us").alias("total_us"), F.max("us").alias("longest_us"))
