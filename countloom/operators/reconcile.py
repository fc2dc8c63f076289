"""Reconciliation of several publications of the same counts, and set comparisons of keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.sources.storage import stage

OK, MISSING_A, MISSING_B, DIFFERENT = "OK", "MISSING_A", "MISSING_B", "DIFFERENT"


def status(a: Column, b: Column) -> Column:
    """Presence first, then equality: a missing count is never a zero."""
    return F.when(a.isNull(), MISSING_A).when(b.isNull(), MISSING_B).when(a != b, DIFFERENT).otherwise(OK)


def reconcile(facts: DataFrame, keys: Sequence[str], n: str = "n", source: str = "source") -> DataFrame:
    """(keys, n_a, n_b, diff, status) of sources ``a`` and ``b``, the latter backed by ``fallback``.

    All sources are summed in one pass and one shuffle. The fallback counts only for keys that ``b`` has not
    published; the two are never added.
    """
    of = lambda s: F.sum(F.when(F.col(source) == s, F.col(n)))
    sums = facts.groupBy(*keys).agg(of("a").alias("n_a"), F.coalesce(of("b"), of("fallback")).alias("n_b"))
    return sums.select(*keys, "n_a", "n_b", (F.col("n_a") - F.col("n_b")).alias("diff"), status(F.col("n_a"), F.col("n_b")).alias("status"))


def reconcile_by_join(facts: DataFrame, keys: Sequence[str], n: str = "n", source: str = "source") -> DataFrame:
    """The same result from a full outer join, with the fallback appended where ``b`` has no row.

    The facts are summed by key and source once, into a staged table; the joins read that.
    """
    sums = stage(facts.groupBy(*keys, F.col(source).alias("source")).agg(F.sum(n).alias("n")), "sums")
    of = lambda s: sums.where(F.col("source") == s).select(*keys, F.col("n").alias(f"n_{'a' if s == 'a' else 'b'}"))
    b = of("b")
    b = b.unionByName(of("fallback").join(b, list(keys), "left_anti"))
    both = of("a").join(b, list(keys), "full_outer")
    return both.select(*keys, "n_a", "n_b", (F.col("n_a") - F.col("n_b")).alias("diff"), status(F.col("n_a"), F.col("n_b")).alias("status"))


def summary(reconciled: DataFrame) -> DataFrame:
    """One row of counters that add up to the keys compared."""
    of = lambda s: F.count_if(F.col("status") == s)
    return reconciled.agg(F.count("*").alias("keys_compared"), of(OK).alias("matches"), of(MISSING_A).alias("missing_a"), of(MISSING_B).alias("missing_b"), of(DIFFERENT).alias("different"))


def key_differences(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): keys of one side only, and those of both; each key once."""
    marked = a.select(*keys, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(b.select(*keys, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    seen = marked.groupBy(*keys).agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    side = F.when(F.col("in_b") == 0, "only_a").when(F.col("in_a") == 0, "only_b").otherwise("both")
    return seen.select(*keys, side.alias("side"))


def compare_versions(old: DataFrame, new: DataFrame, keys: Sequence[str], fixed: Sequence[str], adjusted: Sequence[str]) -> DataFrame:
    """Per key whether the ``fixed`` columns are equal and which of the ``adjusted`` ones changed."""
    both = old.alias("o").join(new.alias("n"), list(keys))
    same = reduce(lambda x, y: x & y, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in fixed], F.lit(True))
    changed = [(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))).alias(f"{c}_changed") for c in adjusted]
    return both.select(*keys, same.alias("fixed_equal"), *changed)


def lookup(rows: DataFrame, reference: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Left lookup with a match status; a key that the reference has twice is reported, not multiplied."""
    once = reference.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(value).alias(value))
    match = F.when(F.col("__n").isNull(), "UNMATCHED").when(F.col("__n") > 1, "AMBIGUOUS").otherwise("MATCHED")
    return rows.join(once, list(keys), "left").withColumn("match", match).drop("__n")


def fatal_if_any(violations: DataFrame, what: str) -> None:
    """The strict mode of every check: raises if there is a violation. Only one row is fetched."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{what}: {first[0]}")
