"""Operators over ordered series: running sums, deltas, medians, valleys, runs, ranks, cuts and windows of equal volume.

A series has one row per time bucket, so a window over all of it is as large as the number of buckets, not
of events: aggregate first. Where there is a unit, windows are partitioned by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from countloom.functions.scalars import floor_time
from countloom.sources.storage import stage


def over(order: str, by: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``k``, their place from 0 by a total ``order``, and ``rows``, how many there are; without a window over all of them.

    Ranges of the order are numbered one by one, each shifted by the counts of those before it: the one window over everything
    has a row per range. The ranges are staged, so that a lost task finds the same ones.
    """
    ranged = stage(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("own"))
    so_far = F.sum("own").over(Window.orderBy("part"))
    starts = sizes.select("part", (so_far - F.col("own")).alias("start"), F.sum("own").over(Window.partitionBy()).alias("rows"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return ranged.withColumn("k", place).join(starts, "part").withColumn("k", F.col("start") + F.col("k")).drop("part", "start")


def cumulative(series: DataFrame, order: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Running sums that replace the columns."""
    w = over(order, by).rowsBetween(Window.unboundedPreceding, 0)
    return series.select(order, *by, *[F.sum(c).over(w).alias(c) for c in columns])


def deltas(series: DataFrame, order: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """d_x of each cumulative column and the seconds since the row before; null in the first row."""
    w = over(order, by)
    seconds = (F.unix_micros(F.col(order).cast("timestamp")) - F.unix_micros(F.lag(order).over(w).cast("timestamp"))) / 1_000_000
    return series.select("*", *[(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in columns], seconds.alias("seconds"))


def moving_median(series: DataFrame, order: str, value: str, half: int, by: Sequence[str] = ()) -> DataFrame:
    """Centred moving median over 2 x half + 1 rows, shorter at the ends, and the residual."""
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    median = F.expr(f"percentile({value}, 0.5) OVER ({part}ORDER BY {order} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)")
    return series.withColumn("median", median).withColumn("residual", F.col(value) - F.col("median"))


def valleys(series: DataFrame, order: str, value: str, reach: int, prominence: float, by: Sequence[str] = ()) -> DataFrame:
    """Local minima that lie ``prominence`` or more below the highest value on both sides within ``reach`` rows."""
    w = over(order, by)
    left, right = F.max(value).over(w.rowsBetween(-reach, -1)), F.max(value).over(w.rowsBetween(1, reach))
    low = (F.col(value) <= F.lag(value).over(w)) & (F.col(value) < F.lead(value).over(w))
    found = series.withColumn("prominence", F.least(left, right) - F.col(value)).withColumn("__low", low & left.isNotNull() & right.isNotNull())
    return found.where(F.col("__low") & (F.col("prominence") >= prominence)).drop("__low")


def longest_run(series: DataFrame, order: str, holds: Column, by: Sequence[str] = ()) -> DataFrame:
    """The longest stretch of rows for which ``holds``; the earliest on ties. (by, start, end, transitions)."""
    w = over(order, by)
    marked = series.select(*by, order, F.coalesce(holds, F.lit(False)).alias("ok"))
    island = marked.withColumn("island", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("ok")
    runs = island.groupBy(*by, "island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("transitions"))
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("transitions"), F.asc("start")))
    return runs.withColumn("__k", best).where("__k = 1").drop("__k", "island")


def bucket(feed: DataFrame, unit: str, ts: str = "ts", n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Events and counts per minute, second, ... ; events of one bucket are never ordered."""
    return feed.groupBy(*by, floor_time(unit, ts).alias("bucket")).agg(F.count("*").alias("events"), F.sum(n).alias("total"))


def cut_sums(rows: DataFrame, group: Sequence[str], ts: str, cuts: Sequence[str], measures: dict[str, Column]) -> DataFrame:
    """(group, cut, pre_x, all_x): sums strictly before each cut and in all, for all cuts in one scan."""
    pre = [F.sum(F.when(F.col(ts) < F.lit(c).cast("timestamp"), m).otherwise(0)).alias(f"pre_{k}_{name}") for k, c in enumerate(cuts) for name, m in measures.items()]
    wide = rows.groupBy(*group).agg(*pre, *[F.sum(m).alias(f"all_{name}") for name, m in measures.items()])
    one = lambda k, c: F.struct(F.lit(c).alias("cut"), *[F.col(f"pre_{k}_{name}").alias(f"pre_{name}") for name in measures])
    long = wide.select(*group, *[f"all_{name}" for name in measures], F.explode(F.array(*[one(k, c) for k, c in enumerate(cuts)])).alias("x"))
    return long.select(*group, "x.*", *[f"all_{name}" for name in measures])


def end_quarters(rows: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Marks the first and last max(1, n div 4) rows of a group as EARLY and LATE, others null."""
    w = Window.partitionBy(*group)
    size = F.greatest(F.lit(1), F.expr("__n div 4"))
    out = rows.withColumn("__n", F.count("*").over(w)).withColumn("__k", F.row_number().over(w.orderBy(*order)))
    return out.withColumn("quarter", F.when(F.col("__k") <= size, "EARLY").when(F.col("__k") > F.col("__n") - size, "LATE")).drop("__n", "__k")


def double_rank(value: str, by: Sequence[str] = ()) -> Column:
    """Twice the average rank, an integer, ties share theirs."""
    w = Window.partitionBy(*by)
    return 2 * F.rank().over(w.orderBy(value)) + F.count("*").over(Window.partitionBy(*by, value)) - 1


def percent_at_most(value: str, by: Sequence[str] = ()) -> Column:
    """Percentage of the rows with at most this value."""
    return F.lit(100.0) * F.cume_dist().over(Window.partitionBy(*by).orderBy(value))


def adverse_order(batches: DataFrame, share: Column, n: str, x: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Batches in the order that favours ``x`` most, with running totals: bounds any other order."""
    w = Window.partitionBy(*by).orderBy(share.desc(), *order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return batches.withColumn("place", F.row_number().over(w)).withColumn("cum_n", F.sum(n).over(running)).withColumn("cum_x", F.sum(x).over(running))


def pack_ties(series: DataFrame, by: str, order: str, size: str, sums: Sequence[str], at_least: int) -> DataFrame:
    """Blocks of whole rows, in order, each of ``at_least`` in ``size``; what is left joins the last block.

    The cut of a block depends on the one before: rows of a group come sorted and are read as a stream, which holds the open block
    and the one before it only. (by, block, start, end, buckets, size, sums).
    """
    import pandas as pd

    names = [by, "block", "start", "end", "buckets", size, *sums]

    def run(batches):
        key, number, done, now = None, 0, None, None

        def closed():
            """The last block of a group: what is left over joins the one before."""
            if done is not None and now is not None:
                return [[*done[:3], now[3], *(a + b for a, b in zip(done[4:], now[4:]))]]
            return [x for x in (done, now) if x is not None]

        for b in batches:
            out = []
            for k, at, *values in zip(*(b[c] for c in b.columns)):
                if k != key:
                    out += closed()
                    key, number, done, now = k, 0, None, None
                now = [k, number, at, at, 1, *values] if now is None else [*now[:3], at, now[4] + 1, *(a + v for a, v in zip(now[5:], values))]
                if now[5] >= at_least:
                    out += [] if done is None else [done]
                    done, now, number = now, None, number + 1
            if out:
                yield pd.DataFrame(out, columns=names)
        if left := closed():
            yield pd.DataFrame(left, columns=names)

    kinds = dict(series.dtypes)
    schema = f"{by} {kinds[by]}, block long, start {kinds[order]}, end {kinds[order]}, buckets long, " + ", ".join(f"{c} long" for c in [size, *sums])
    rows = series.select(by, order, *[F.col(c).cast("long").alias(c) for c in [size, *sums]]).repartition(by).sortWithinPartitions(by, order)
    return rows.mapInPandas(run, schema)


def stretches(series: DataFrame, order: str, breaks: Column, by: Sequence[str] = ()) -> DataFrame:
    """Numbers the stretches of a series; a row for which ``breaks`` holds begins one."""
    w = over(order, by).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("stretch", F.sum(F.when(breaks, 1).otherwise(0)).over(w))


def compared(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str], only: tuple[str, str] = ("ONLY_LEFT", "ONLY_RIGHT")) -> DataFrame:
    """(key, status): buckets of two series, EQUAL or DIFFERENT, or in one of them only."""
    pair = lambda df: df.select(key, F.struct(*columns).alias("x"))
    both = pair(left).withColumnRenamed("x", "l").join(pair(right).withColumnRenamed("x", "r"), key, "full_outer")
    status = F.when(F.col("l").isNull(), only[1]).when(F.col("r").isNull(), only[0]).when(F.col("l").eqNullSafe(F.col("r")), "EQUAL").otherwise("DIFFERENT")
    return both.select(key, status.alias("status"))
