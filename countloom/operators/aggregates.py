"""Aggregates over count facts: matrices, levels, bands, histograms, top lists, closure and rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matrix(facts: DataFrame, unit: Sequence[str], by: str, n: str, columns: Mapping[str, str]) -> DataFrame:
    """A row per unit, a nullable total per value of ``by``; one shuffle, absent stays null."""
    return facts.groupBy(*unit).agg(*[F.sum(F.when(F.col(by) == value, F.col(n))).alias(name) for value, name in columns.items()])


def presence(m: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P10: flags has_x beside nullable totals."""
    return m.select("*", *[F.col(c).isNotNull().cast("int").alias(f"has_{c}") for c in columns])


def levels(rows: DataFrame, sets: Sequence[Sequence[str]], measures: Mapping[str, Column]) -> DataFrame:
    """Aggregates at several levels in one pass; ``level`` is the number of the set."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    bits = F.grouping_id()
    of = {sum(1 << (len(every) - 1 - k) for k, c in enumerate(every) if c not in s): i for i, s in enumerate(sets)}
    level = F.create_map(*[F.lit(x) for k, v in of.items() for x in (k, v)])
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *every)
    return grouped.agg(bits.cast("int").alias("__id"), *[m.alias(name) for name, m in measures.items()]).select(level[F.col("__id")].alias("level"), *every, *measures)


def band(x: Column, upper: Sequence[int]) -> Column:
    """Label of the band of a positive integer: 1, 2, 3-5, ..., over the last."""
    out, low = None, 1
    for top in upper:
        label = str(top) if top == low else f"{low}-{top}"
        out = F.when(x <= top, label) if out is None else out.when(x <= top, label)
        low = top + 1
    return out.otherwise(f"{low}+")


def bin10(x: Column) -> Column:
    """Tenth of a share, the last one closed."""
    return F.least(F.lit(9), F.floor(F.lit(10) * x)).cast("int")


def top_k(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; ``order`` should be total."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def closure(rows: DataFrame, parent: Sequence[str], child: Sequence[str], totals: DataFrame, n: str = "n") -> DataFrame:
    """Published totals of ``parent`` against the sum of its children; a missing side counts as zero."""
    sums = rows.groupBy(*child).agg(F.sum(n).alias("part")).groupBy(*parent).agg(F.sum("part").alias("children"), F.count("*").alias("n_children"))
    both = totals.join(sums, list(parent), "full_outer")
    a, b = F.coalesce(F.col("total"), F.lit(0)), F.coalesce(F.col("children"), F.lit(0))
    return both.select(*parent, a.alias("total"), b.alias("children"), F.coalesce("n_children", F.lit(0)).alias("n_children"), (a - b).alias("difference"))


def violations(rows: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """(key, rule) of every broken rule; a rule that is null is not broken. One scan, no union."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return rows.select(*key, F.explode(broken).alias("rule"))


def sum_where(cond: Column, n: Column | int = 1) -> Column:
    return F.sum(F.when(cond, n).otherwise(0))


def weighted_errors(error: Column, weight: Column) -> dict[str, Column]:
    """Weighted mean, mean absolute and root mean square error; null where the weights are zero."""
    w = F.sum(weight)
    return {"bias": F.try_divide(F.sum(weight * error), w), "mae": F.try_divide(F.sum(weight * F.abs(error)), w), "rmse": F.sqrt(F.try_divide(F.sum(weight * error * error), w))}


def leave_one_out(rows: DataFrame, group: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """For each group the totals of all the others, without another scan: total less own sums."""
    own = rows.groupBy(*group).agg(*[F.sum(c).alias(c) for c in sums])
    total = own.agg(*[F.sum(c).alias(f"__{c}") for c in sums])  # one row
    return own.crossJoin(F.broadcast(total)).select(*group, *[(F.col(f"__{c}") - F.col(c)).alias(c) for c in sums])


def classify(rows: DataFrame, key: str, tables: Sequence[tuple[str, DataFrame]], default: str, name: str = "label") -> DataFrame:
    """Label from the first table (column, label) that knows the row: exceptions, then groups, then a default."""
    out, found = rows, []
    for k, (column, labels) in enumerate(tables):
        out = out.join(labels.select(F.col(column).alias(column if column != key else key), F.col("label").alias(f"__label{k}")), column, "left")
        found.append(F.col(f"__label{k}"))
    return out.withColumn(name, F.coalesce(*found, F.lit(default))).drop(*[f"__label{k}" for k in range(len(tables))])
