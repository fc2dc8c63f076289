"""Hold-out and hierarchical forecasts: rates of what is known, applied to what is not; no look-ahead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.functions.scalars import nearest_count


def fixed_share(rows: DataFrame, test: Column, levels: Sequence[Sequence[str]], n: str = "n", x: str = "x") -> DataFrame:
    """Integer predictions of ``x`` among ``n`` in test rows from training shares of ever finer levels.

    ``levels`` go from coarse to fine, the first empty; a level without training rows falls back to the one before.
    Rows (model, columns of ``rows``, predicted).
    """
    rows = rows.withColumn("__test", test)
    train = rows.where(~F.col("__test"))
    out = rows.where("__test")
    for k, level in enumerate(levels):
        rate = train.groupBy(*level).agg(F.sum(x).alias(f"__x{k}"), F.sum(n).alias(f"__n{k}"))
        out = out.join(rate, list(level), "left") if level else out.crossJoin(F.broadcast(rate))
    models = []
    for k in range(len(levels)):
        share = F.coalesce(*[F.when(F.col(f"__n{j}") > 0, F.struct(F.col(f"__x{j}").alias("x"), F.col(f"__n{j}").alias("n"))) for j in range(k, -1, -1)])
        models.append(F.struct(F.lit("_".join(levels[k]) or "all").alias("model"), nearest_count(share["x"], share["n"], F.col(n)).alias("predicted")))
    return out.select(*[c for c in rows.columns if c != "__test"], F.explode(F.array(*models)).alias("__m")).select("*", "__m.*").drop("__m")


def shrunk_rates(rows: DataFrame, levels: Sequence[Sequence[str]], n: str, x: str, prior: float = 1000.0) -> list[DataFrame]:
    """Rate of each level, pulled towards the rate of the level above by ``prior`` pseudo-counts."""
    out: list[DataFrame] = []
    for k, level in enumerate(levels):
        own = rows.groupBy(*level).agg(F.sum(x).alias("x"), F.sum(n).alias("n"))
        if not k:
            out.append(own.select((F.col("x") / F.col("n")).alias("rate0")))
            continue
        above = out[-1]
        own = own.join(above, list(levels[k - 1])) if levels[k - 1] else own.crossJoin(F.broadcast(above))
        up = F.col(f"rate{k - 1}")
        out.append(own.select(*level, ((F.col("x") + F.lit(prior) * up) / (F.col("n") + F.lit(prior))).alias(f"rate{k}")))
    return out


def with_rates(target: DataFrame, rates: Sequence[DataFrame], levels: Sequence[Sequence[str]]) -> DataFrame:
    """Rates of all levels beside the target rows; a place without history takes the rate above, and says so in ``category``."""
    out = target
    for rate, level in zip(rates, levels):
        out = out.join(rate, list(level), "left") if level else out.crossJoin(F.broadcast(rate))
    category = F.lit("comparable")
    for k in range(len(levels) - 1, 0, -1):
        category = F.when(F.col(f"rate{k}").isNull(), f"no_history_{levels[k][-1]}").otherwise(category)
    filled = out.withColumn("category", category)
    for k in range(1, len(levels)):
        filled = filled.withColumn(f"rate{k}", F.coalesce(f"rate{k}", f"rate{k - 1}"))
    return filled
