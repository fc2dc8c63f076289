"""Exact descriptive statistics: digits, moments, correlation within groups, outliers, bounds, periods and resampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.operators.series import numbered
from countloom.sources.storage import stage

#: A variance under this counts as none: the coefficient is null.
EPS = 1e-12
#: Scores of shuffles this near to the observed one count as equal to it.
TIE = 1e-9
#: Scale of the median absolute deviation for a normal distribution.
MAD_SCALE = 1.4826


def benford_share(digit: Column, second: bool = False) -> Column:
    """M1: expected share of a first digit (1-9) or of a second one (0-9)."""
    d = digit.cast("double")
    if not second:
        return F.log10(1 + 1 / d)
    return sum((F.log10(1 + 1 / (10 * k + d)) for k in range(2, 10)), F.log10(1 + 1 / (10 + d)))


def digit_table(values: DataFrame, digit: Column, expected: Column, applicable: Column) -> DataFrame:
    """M2/M3: count, share and expected share of each digit of ``values`` (n), where the test applies at all.

    ``applicable`` is an aggregate over all values, such as 100 of them and 30 distinct ones.
    """
    ok = values.agg(applicable.alias("ok"))  # one row
    counts = values.select(digit.cast("int").alias("digit")).where("digit is not null").groupBy("digit").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # ten rows at most
    out = counts.select("digit", "n", (F.col("n") / total).alias("share"), expected.alias("expected"))
    return out.crossJoin(F.broadcast(ok)).where("ok").drop("ok")


def moments(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """The six sums that everything below is made of; they add up over groups."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))


def add_moments(m: DataFrame, by: Sequence[str]) -> DataFrame:
    return m.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def pearson(xx: Column, yy: Column, xy: Column, n: Column, least: int = 30) -> Column:
    """M4/M9: coefficient from centred sums, null for few rows or no variance, within -1 and 1."""
    r = xy / F.sqrt(xx * yy)
    return F.when((n >= least) & (xx > EPS) & (yy > EPS), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def raw_and_within(m: DataFrame, by: Sequence[str], group: Sequence[str], least: int = 30) -> DataFrame:
    """Correlation of all rows, and of deviations from the group means, from moments per (by, group)."""
    centred = m.withColumns({"cxx": F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), "cyy": F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"), "cxy": F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")})
    s = centred.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "cxx", "cyy", "cxy")], F.count("*").alias("groups"))
    n = F.col("n")
    raw = pearson(F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n, F.col("sxy") - F.col("sx") * F.col("sy") / n, n, least)
    return s.select(*by, "n", "groups", raw.alias("r_raw"), pearson(F.col("cxx"), F.col("cyy"), F.col("cxy"), n, least).alias("r_within"))


def reversal(r_raw: Column, r_within: Column, shift: float = 0.2, sure: float = 0.1) -> Column:
    """Whether the sign turns, the coefficient moves by ``shift`` or more, or neither."""
    turned = (F.signum(r_raw) * F.signum(r_within) < 0) & (F.abs(r_raw) >= sure) & (F.abs(r_within) >= sure)
    return F.when(r_raw.isNull() | r_within.isNull(), "UNDEFINED").when(turned, "REVERSED").when(F.abs(r_raw - r_within) >= shift, "SHIFTED").otherwise("STABLE")


def robust_outliers(rows: DataFrame, by: Sequence[str], value: str, least: float, min_mad: float = 0.015) -> DataFrame:
    """M6: robust z from median and MAD of a group; groups with a MAD under ``min_mad`` are left out.

    The rows are staged once: median, deviations and their median each read them again.
    """
    rows = stage(rows, "values")
    centre = rows.groupBy(*by).agg(F.median(value).alias("median"))
    off = rows.join(centre, list(by)).withColumn("off", F.abs(F.col(value) - F.col("median")))
    mad = off.groupBy(*by).agg(F.median("off").alias("mad")).where(F.col("mad") >= min_mad)
    z = (F.col(value) - F.col("median")) / (F.lit(MAD_SCALE) * F.col("mad"))
    return off.drop("off").join(mad, list(by)).withColumn("z", z).where(F.abs("z") >= least)


def shape(rows: DataFrame, by: Sequence[str], value: str, least: int = 30, pivot: float = 0.0) -> DataFrame:
    """M5: population skewness and excess kurtosis from one pass of power sums about ``pivot``, null for few rows or no variance.

    ``pivot`` should lie near the values: the sums lose digits with the distance of the mean from it.
    """
    d = F.col(value) - F.lit(float(pivot))
    p = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("a"), F.avg(d * d).alias("b"), F.avg(d * d * d).alias("c"), F.avg(d * d * d * d).alias("d"))
    a, b2, c3, d4 = (F.col(x) for x in "abcd")
    c = p.select(*by, "n", (b2 - a * a).alias("m2"), (c3 - 3 * a * b2 + 2 * a * a * a).alias("m3"), (d4 - 4 * a * c3 + 6 * a * a * b2 - 3 * a * a * a * a).alias("m4"))
    ok = (F.col("n") >= least) & (F.col("m2") > EPS)
    return c.select(*by, "n", F.when(ok, F.col("m3") / F.pow("m2", F.lit(1.5))).alias("skew"), F.when(ok, F.col("m4") / (F.col("m2") * F.col("m2")) - 3).alias("excess"))


def frechet(p: Column, s: Column, n: Column) -> tuple[Column, Column, Column]:
    """Least and most that p and s can share among n, and the least of s outside p."""
    return F.greatest(F.lit(0), p + s - n), F.least(p, s), F.greatest(F.lit(0), s - p)


def line_fit(rows: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept, R2 and RMSE from moments about the first x."""
    m = moments(rows, by, x, y)
    n = F.col("n")
    xx, yy, xy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n, F.col("sxy") - F.col("sx") * F.col("sy") / n
    slope = F.try_divide(xy, xx)
    return m.select(*by, "n", slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / n).alias("intercept"), F.try_divide(xy * xy, xx * yy).alias("r2"), F.sqrt(F.greatest(F.lit(0.0), (yy - slope * xy) / n)).alias("rmse"))


def periodogram(series: DataFrame, axis: str, value: str, periods: DataFrame) -> DataFrame:
    """Share of the variance that a sine and a cosine of each period explain; null if they are collinear.

    ``series`` has a row per bucket and ``periods`` a stated grid, so their product is small.
    """
    angle = 2 * F.pi() * F.col(axis) / F.col("period")
    rows = series.select(F.col(axis).cast("double").alias(axis), F.col(value).cast("double").alias("z")).crossJoin(F.broadcast(periods)).select("period", F.cos(angle).alias("c"), F.sin(angle).alias("s"), "z")
    n = F.count("*")
    cov = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n
    sums = rows.groupBy("period").agg(*[cov(a, b).alias(a + b) for a, b in ("cc", "ss", "cs", "cz", "sz", "zz")])
    c = {k: F.col(k) for k in ("cc", "ss", "cs", "cz", "sz", "zz")}
    det = c["cc"] * c["ss"] - c["cs"] * c["cs"]
    top = c["ss"] * c["cz"] * c["cz"] - 2 * c["cs"] * c["cz"] * c["sz"] + c["cc"] * c["sz"] * c["sz"]
    return sums.select("period", F.when((det > EPS) & (c["zz"] > EPS), top / (det * c["zz"])).alias("r2"))


def log_grid(low: float, high: float, n: int) -> Column:
    """n periods from low to high, even in their logarithm."""
    step = F.lit((np.log(high) - np.log(low)) / (n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(low) * F.exp(k * step))


def shuffles(series: DataFrame, replicates: int, strata: int, block: int, seed: int) -> DataFrame:
    """The numbered ``series`` (k, rows, v) as (replicate, k, v): 0 as it is, the others with v shuffled within strata of the order.

    The order is by a hash of (seed, replicate, stratum, stretch of ``block`` rows), so it depends on neither partitions nor
    engine. A window sorts one stratum of one replicate.
    """
    g = F.least(F.lit(strata - 1), F.expr(f"k * {strata} div rows"))
    parts = series.select("k", "v", g.alias("g"), "rows").withColumn("from", F.expr(f"(g * rows + {strata - 1}) div {strata}"))
    parts = parts.withColumn("stretch", F.expr(f"(k - `from`) div {block}")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    drawn = F.md5(F.concat_ws("|", F.lit(seed), "replicate", "g", "stretch"))
    place = F.row_number().over(Window.partitionBy("replicate", "g").orderBy(F.when(F.col("replicate") > 0, drawn), "k"))
    return parts.select("replicate", (F.col("from") + place - 1).alias("k"), "v")


def permutation_p(series: DataFrame, order: str, value: str, periods: Sequence[float], replicates: int = 200, strata: int = 4, block: int = 1, seed: int = 11, axis: str | None = None) -> DataFrame:
    """(replicates, observed, hits, p): how often a shuffle within strata of time explains as much.

    ``series`` has a row per bucket, with distinct ``order``; ``periods`` is a stated grid. ``block`` shuffles stretches of so many rows
    instead of single ones. Shuffled values join the places of the series, and the fit of each replicate and period is made of sums.
    p = (hits + 1) / (replicates + 1); null without rows. What can't be fitted explains nothing.
    """
    s = series.select(F.col(order).alias("o"), F.col(axis or order).cast("double").alias("x"), F.col(value).cast("double").alias("v"))
    s = stage(numbered(s, ["o"]), "numbered")
    grid = series.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(p)) for p in periods])).alias("period"))
    waves = s.select("k", "x").join(shuffles(s, replicates, strata, block, seed), "k").crossJoin(F.broadcast(grid))
    angle = 2 * F.pi() * F.col("x") / F.col("period")
    n = F.count("*")
    cov = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n
    names = ("cc", "ss", "cs", "cz", "sz", "zz")
    sums = waves.select("replicate", "period", F.cos(angle).alias("c"), F.sin(angle).alias("s"), F.col("v").alias("z")).groupBy("replicate", "period").agg(*[cov(a, b).alias(a + b) for a, b in names])
    cc, ss, cs, cz, sz, zz = (F.col(k) for k in names)
    det = cc * ss - cs * cs
    r2 = F.when((det > EPS) & (zz > EPS), (ss * cz * cz - 2 * cs * cz * sz + cc * sz * sz) / (det * zz)).otherwise(0.0)
    best = sums.groupBy("replicate").agg(F.max(r2).alias("best"))
    observed = best.where("replicate = 0").select(F.col("best").alias("observed"))  # one row
    hits = F.count_if(F.col("best") >= F.col("observed") - TIE)
    out = best.where("replicate > 0").crossJoin(F.broadcast(observed)).agg(F.first("observed").alias("observed"), hits.alias("hits"))
    return out.select(F.lit(replicates).alias("replicates"), "observed", "hits", F.when(F.col("observed").isNotNull(), (F.col("hits") + 1) / F.lit(replicates + 1)).alias("p"))


def group_bootstrap(m: DataFrame, by: Sequence[str], group: Sequence[str], replicates: int = 400, seed: int = 3) -> DataFrame:
    """Within-group correlation of resampled groups: (by, replicates, low, median, high).

    Each replicate draws as many groups as there are, with replacement; a draw is a hash of (seed, replicate, place), so
    the result depends on neither partitions nor engine. Groups are numbered by ranges, draws join them by number; no group goes to one task.
    """
    every = stage(numbered(m, [*by, *group]).drop("rows"), "numbered")
    sizes = every.groupBy(*by).agg(F.min("k").alias("first"), F.count("*").alias("groups"))
    draws = sizes.select(*by, "first", "groups", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    draws = draws.repartition(*by, "replicate").select(*by, "first", "groups", "replicate", F.explode(F.sequence(F.lit(0), F.col("groups").cast("int") - 1)).alias("place"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "replicate", "place")), 1, 8), 16, 10).cast("long")
    draws = draws.select(*by, "replicate", (F.col("first") + F.pmod(number, F.col("groups"))).alias("k"))
    drawn = draws.join(every, [*by, "k"])
    r = raw_and_within(drawn, [*by, "replicate"], group, 2)
    q = lambda p: F.percentile("r_within", F.lit(p))
    return r.groupBy(*by).agg(F.count("*").alias("replicates"), q(0.025).alias("low"), q(0.5).alias("median"), q(0.975).alias("high"))


def leave_group_out(m: DataFrame, by: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Within-group correlation without each group, and its influence: totals less the group's own part."""
    sums = ("n", "cxx", "cyy", "cxy")
    centred = m.select(*by, *group, "n", (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")).alias("cxx"), (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")).alias("cyy"), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")).alias("cxy"))
    w = Window.partitionBy(*by)
    total = {c: F.sum(c).over(w) for c in sums}
    rest = {c: total[c] - F.col(c) for c in sums}
    out = centred.select(*by, *group, pearson(total["cxx"], total["cyy"], total["cxy"], total["n"]).alias("r_all"), pearson(rest["cxx"], rest["cyy"], rest["cxy"], rest["n"]).alias("r_without"))
    return out.withColumn("influence", F.col("r_all") - F.col("r_without"))


def hypergeometric_mix(batches: DataFrame, order: str, size: str, ones: str, replicates: int = 1000, seed: int = 5) -> DataFrame:
    """(replicate, spread): batches refilled at random from one urn, by sequential hypergeometric draws.

    ``spread`` is the mean absolute deviation of the batches' shares from the overall one. Replicate 0 is the observed order.
    """
    one = batches.agg(F.sort_array(F.collect_list(F.struct(order, F.col(size).cast("long").alias("n"), F.col(ones).cast("long").alias("x")))).alias("s")).select(F.col("s.n").alias("n"), F.col("s.x").alias("x"))
    rows = batches.sparkSession.range(0, replicates + 1).repartition(16).crossJoin(F.broadcast(one))

    def run(batches_):
        import pandas as pd

        for b in batches_:
            out = []
            for k, n, x in zip(b["id"], b["n"], b["x"]):
                n, x = np.asarray(n), np.asarray(x)
                if k and len(n):
                    x = np.random.default_rng([seed, int(k)]).multivariate_hypergeometric(n, int(x.sum()), method="marginals")
                out.append(float(np.abs(x / n - x.sum() / n.sum()).mean()) if len(n) else None)
            yield pd.DataFrame({"replicate": b["id"], "spread": out})

    return rows.mapInPandas(run, "replicate long, spread double")


def digit_verdicts(values: DataFrame, by: Sequence[str], n: str, least: int = 100) -> DataFrame:
    """M2/M3: per group and test (first, second, last digit): observations, distinct values, span, status, chi2, mad, ends_0_5.

    First digits take values from 1, second ones from 10, last ones from 30 on. A test with under ``least`` of them is
    INSUFFICIENT, and a test of the first two also where the largest value is under ten times the least or
    under 30 differ; its statistics are null then. One pass: each value is counted in up to three tests.
    """
    v = F.col(n)
    digit = {"first": F.when(v >= 1, F.substring(v.cast("string"), 1, 1).cast("int")), "second": F.when(v >= 10, F.substring(v.cast("string"), 2, 1).cast("int")), "last": F.when(v >= 30, F.pmod(v, F.lit(10)).cast("int"))}
    parts = F.array(*[F.struct(F.lit(t).alias("test"), d.alias("digit")) for t, d in digit.items()])
    rows = values.select(*by, v.alias("n"), F.explode(parts).alias("p")).select(*by, "n", "p.*").where("digit is not null")
    counts = F.array(*[F.count_if(F.col("digit") == d) for d in range(10)])
    g = rows.groupBy(*by, "test").agg(F.count("*").alias("observations"), F.count_distinct("n").alias("distinct_values"), (F.max("n") / F.min("n")).alias("span"), counts.alias("k"))
    shares = {"first": [None, *(np.log10(1 + 1 / d) for d in range(1, 10))], "second": [sum(np.log10(1 + 1 / (10 * k + d)) for k in range(1, 10)) for d in range(10)], "last": [0.1] * 10}
    expected = None
    for test, p in shares.items():
        array = F.array(*[F.lit(None if x is None else float(x)).cast("double") for x in p])
        expected = F.when(F.col("test") == test, array) if expected is None else expected.when(F.col("test") == test, array)
    total = F.col("observations").cast("double")
    off = lambda f: F.filter(F.zip_with("k", "p", f), lambda x: x.isNotNull())
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    g = g.withColumn("p", expected)
    chi2 = add(off(lambda k, p: (k - total * p) * (k - total * p) / (total * p)))
    deviations = off(lambda k, p: F.abs(k / total - p))
    ok = (F.col("observations") >= least) & ((F.col("test") == "last") | ((F.col("span") >= 10) & (F.col("distinct_values") >= 30)))
    ends = F.when(F.col("test") == "last", F.lit(100.0) * (F.get("k", F.lit(0)) + F.get("k", F.lit(5))) / total)
    return g.select(*by, "test", "observations", "distinct_values", "span", F.when(ok, "EXPLORATORY").otherwise("INSUFFICIENT").alias("status"), F.when(ok, chi2).alias("chi2"), F.when(ok, add(deviations) / F.size(deviations)).alias("mad"), ends.alias("ends_0_5"))


def group_influence(m: DataFrame, by: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Per group of two rows or more: its centred sums, r_zone, r_all, r_without, influence, ranks by influence and by absolute covariance, cov_share.

    ``m`` has moments per (by, group); its windows hold the groups of one ``by``, not their rows.
    """
    c = m.where("n >= 2").select(*by, *group, "n", *[(F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n")).alias(f"c{a}{b}") for a, b in ("xx", "yy", "xy")])
    w = Window.partitionBy(*by)
    c = c.select("*", F.sum("n").over(w).alias("tn"), *[F.sum(f"c{k}").over(w).alias(f"t{k}") for k in ("xx", "yy", "xy")])
    r = lambda x, y, xy: pearson(x, y, xy, F.lit(2), 2)
    rest = [F.col(f"t{k}") - F.col(f"c{k}") for k in ("xx", "yy", "xy")]
    c = c.withColumns({"r_zone": r(F.col("cxx"), F.col("cyy"), F.col("cxy")), "r_all": r(F.col("txx"), F.col("tyy"), F.col("txy")), "r_without": r(*rest)})
    c = c.withColumn("influence", F.col("r_without") - F.col("r_all"))
    rank = lambda e: F.row_number().over(w.orderBy(F.round(F.abs(e), 9).desc_nulls_last(), *group))
    return c.withColumns({"by_influence": rank(F.col("influence")), "by_cov": rank(F.col("cxy")), "cov_share": F.lit(100.0) * F.try_divide(F.abs("cxy"), F.sum(F.abs("cxy")).over(w))})


def _without(gone: Column) -> Column:
    """The coefficient without the groups for which ``gone`` holds, in an aggregate over rows of :func:`group_influence`."""
    left = [F.first(f"t{k}") - F.coalesce(F.sum(F.when(gone, F.col(f"c{k}"))), F.lit(0.0)) for k in ("xx", "yy", "xy")]
    return pearson(*left, F.lit(2), 2)


def group_stress(influences: DataFrame, by: Sequence[str], group: Sequence[str], draws: int = 400, removed: int = 5) -> DataFrame:
    """The coefficient without the top 1, 3 and 5 groups by covariance, without the most influential ones, and without ``removed`` drawn ones.

    A draw takes the groups with the least hash of (by, number of the draw, group), so it depends on neither order nor partitions; draws
    are dealt by (by, number). Only where there are two groups more than are removed.
    """
    tops = [e for n in (1, 3, 5) for e in (_without(F.col("by_cov") <= n).alias(f"without_top{n}"), (F.lit(100.0) * F.sum(F.when(F.col("by_cov") <= n, F.col("n"))) / F.first("tn")).alias(f"removed_top{n}"))]
    out = influences.groupBy(*by).agg(F.first("r_all").alias("r"), *tops, _without(F.col("by_influence") <= 5).alias("without_influential"), F.count("*").alias("groups")).where(F.col("groups") >= removed + 2)
    rows = influences.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    key = F.md5(F.concat_ws("|", *by, F.col("replicate").cast("string"), *[F.col(c).cast("string") for c in group]))
    place = F.row_number().over(Window.partitionBy(*by, "replicate").orderBy(key))
    drawn = rows.withColumn("place", place).groupBy(*by, "replicate").agg(_without(F.col("place") <= removed).alias("d"), F.first("r_all").alias("all"))
    q = lambda p: F.percentile("d", F.lit(p))
    spread = drawn.groupBy(*by).agg(F.count("d").alias("draws"), F.min("d").alias("low"), q(0.025).alias("p025"), F.median("d").alias("mid"), q(0.975).alias("p975"), F.max("d").alias("high"), F.try_divide(F.lit(100.0) * F.count_if(F.col("d") * F.col("all") > 0), F.count("d")).alias("same_sign"))
    return out.drop("groups").join(spread, list(by))


def with_shares(batches: DataFrame, ts: str) -> DataFrame:
    """Batches (ts, units, n, a) with ``seen`` units so far, the share of a in percent, and the change ``d_cum`` of the share so far; empty ones go."""
    w = Window.orderBy(ts)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    c = batches.withColumns({"seen": F.sum("units").over(running), "cum": F.lit(100.0) * F.try_divide(F.sum("a").over(running), F.sum("n").over(running))}).where("n > 0")
    return c.select(ts, "units", "n", "a", "seen", (F.lit(100.0) * F.col("a") / F.col("n")).alias("share"), (F.col("cum") - F.lag("cum").over(w)).alias("d_cum"))


def residual_sets(batches: DataFrame, configs: Sequence[tuple[int, int]]) -> DataFrame:
    """(least, half, ts, seen, minute, residual): the batches of ``least`` counts or more, less their moving median over 2 x half + 1 of them."""
    first = batches.agg(F.min("ts").alias("zero"))  # one row
    rows = batches.crossJoin(F.broadcast(first))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = rows.select("ts", "n", "seen", "share", ((us("ts") - us("zero")) / 60_000_000).alias("minute"))
    out = None
    for least, half in configs:
        median = F.expr(f"percentile(share, 0.5) OVER (ORDER BY ts ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)")
        part = rows.where(F.col("n") >= least).select(F.lit(least).alias("least"), F.lit(half).alias("half"), "ts", "seen", "minute", (F.col("share") - median).alias("residual"))
        out = part if out is None else out.unionAll(part)
    return out


def best_periods(sets: DataFrame, axes: dict[str, tuple[float, float, int]], least_rows: int = 30) -> DataFrame:
    """(least, half, axis, period, r2): the period of the grids that explains most of each set's residuals; null for under ``least_rows`` of them."""
    grids = F.array(*[F.struct(F.lit(axis).alias("axis"), p.alias("periods")) for axis, (lo, hi, n) in axes.items() for p in [log_grid(lo, hi, n)]])
    grid = sets.sparkSession.range(1).select(F.explode(grids).alias("g")).select("g.axis", F.explode("g.periods").alias("period"))
    place = F.when(F.col("axis") == "units", F.col("seen").cast("double")).otherwise(F.col("minute"))
    rows = sets.crossJoin(F.broadcast(grid))  # a stated grid
    angle = 2 * F.pi() * place / F.col("period")
    rows = rows.select("least", "half", "axis", "period", F.cos(angle).alias("c"), F.sin(angle).alias("s"), F.col("residual").alias("z"))
    n = F.count("*")
    cov = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n
    k = {x + y: F.col(x + y) for x, y in ("cc", "ss", "cs", "cz", "sz", "zz")}
    sums = rows.groupBy("least", "half", "axis", "period").agg(n.alias("m"), *[cov(x, y).alias(x + y) for x, y in ("cc", "ss", "cs", "cz", "sz", "zz")])
    det = k["cc"] * k["ss"] - k["cs"] * k["cs"]
    r = F.when((F.col("m") >= least_rows) & (det > EPS) & (k["zz"] > EPS), (k["ss"] * k["cz"] * k["cz"] - 2 * k["cs"] * k["cz"] * k["sz"] + k["cc"] * k["sz"] * k["sz"]) / (det * k["zz"]))
    return sums.withColumn("r2", r).groupBy("least", "half").agg(F.max_by("axis", "r2").alias("axis"), F.max_by("period", "r2").alias("period"), F.max("r2").alias("r2"))


def sensitivity(sets: DataFrame, best: DataFrame, levels: Sequence[float], reach: int = 5) -> DataFrame:
    """``best`` of each set with its size and, for each level of prominence, its valleys and the least and most units between them."""
    by = Window.partitionBy("least", "half").orderBy("ts")
    left, right = F.max("residual").over(by.rowsBetween(-reach, -1)), F.max("residual").over(by.rowsBetween(1, reach))
    low = (F.col("residual") <= F.lag("residual").over(by)) & (F.col("residual") < F.lead("residual").over(by))
    marked = sets.select("least", "half", "ts", "seen", low.alias("low"), (F.least(left, right) - F.col("residual")).alias("prominence"))
    marked = marked.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).where(F.col("low") & (F.col("prominence") >= F.col("level") - 1e-9))
    gap = F.col("seen") - F.lag("seen").over(Window.partitionBy("least", "half", "level").orderBy("ts"))
    valleys = marked.withColumn("gap", gap).groupBy("least", "half", "level").agg(F.count("*").alias("valleys"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"))
    sizes = sets.groupBy("least", "half").agg(F.count("*").alias("selected"))
    every = best.join(sizes, ["least", "half"]).withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    return every.join(valleys, ["least", "half", "level"], "left").withColumn("valleys", F.coalesce("valleys", F.lit(0)).cast("long"))


def joint_max_p(batches: DataFrame, configs: Sequence[tuple[int, int]], axes: dict[str, tuple[float, float, int]], replicates: int = 300, strata: int = 4, block: int = 5, seed: int = 17) -> DataFrame:
    """(mode, observed, hits, p): the largest r2 over all configurations and periods, against shuffles of the shares.

    One shuffle within quarters of time, of single batches or of stretches of ``block``, serves all configurations; medians and residuals are
    computed anew from it. The series, a row per batch, becomes one row; replicates are dealt over the tasks, each seeded by its number.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    one = batches.agg(F.sort_array(F.collect_list(F.struct(us.alias("t"), F.col("seen").cast("double").alias("seen"), F.col("n").cast("double").alias("n"), "share"))).alias("s"))
    one = one.select(*[F.col(f"s.{c}").cast("array<double>").alias(c) for c in ("t", "seen", "n", "share")])
    rows = batches.sparkSession.range(0, 2 * replicates + 1).repartition(16).crossJoin(F.broadcast(one))

    def run(parts):
        import pandas as pd

        designs = None
        for b in parts:
            out = []
            for k, t, seen, n, share in zip(b["id"], b["t"], b["seen"], b["n"], b["share"]):
                t, seen, n, share = (np.asarray(x) for x in (t, seen, n, share))
                if designs is None:
                    designs = _designs((t - t[:1]) / 6e7, seen, n, configs, axes)
                if k:
                    share = share[shuffled(len(share), np.random.default_rng([seed, int(k)]), strata, block if k > replicates else 1)]
                out.append(max((_peak(share, *d) for d in designs), default=0.0))
            yield pd.DataFrame({"id": b["id"], "best": out})

    best = rows.mapInPandas(run, "id long, best double")
    observed = best.where("id = 0").select(F.col("best").alias("observed"))  # one row
    others = best.where("id > 0").select(F.when(F.col("id") > replicates, "blocks").otherwise("single").alias("mode"), "best").crossJoin(F.broadcast(observed))
    hits = F.count_if(F.col("best") >= F.col("observed"))
    return others.groupBy("mode").agg(F.first("observed").alias("observed"), hits.alias("hits"), ((hits + 1) / (F.count("*") + 1)).alias("p"))


def shuffled(n: int, rng: np.random.Generator, strata: int, block: int) -> np.ndarray:
    """Places of a shuffle within quarters of the order, of stretches of ``block`` rows."""
    group = np.minimum(strata - 1, np.arange(n) * strata // max(n, 1))
    take = [np.zeros(0, np.int64)]
    for g in range(strata):
        at = np.flatnonzero(group == g)
        parts = [at[i : i + block] for i in range(0, len(at), block)]
        take += [parts[i] for i in rng.permutation(len(parts))]
    return np.concatenate(take)


def _designs(minute: np.ndarray, seen: np.ndarray, n: np.ndarray, configs, axes) -> list[tuple]:
    """Per configuration: which batches it has, the half of its median, and the centred waves of all periods on both axes."""
    out = []
    for least, half in configs:
        chosen = np.flatnonzero(n >= least)
        if len(chosen) < 3:
            continue
        waves = []
        for axis, (lo, hi, count) in axes.items():
            place = (seen if axis == "units" else minute)[chosen]
            angle = 2 * np.pi * place[None, :] / np.geomspace(lo, hi, count)[:, None]
            waves.append((np.cos(angle), np.sin(angle)))
        c, s = (np.concatenate(x) for x in zip(*waves))
        out.append((chosen, half, c - c.mean(axis=1, keepdims=True), s - s.mean(axis=1, keepdims=True)))
    return out


def _peak(share: np.ndarray, chosen: np.ndarray, half: int, c: np.ndarray, s: np.ndarray) -> float:
    """The largest r2 of the residuals of some batches."""
    y = share[chosen]
    padded = np.concatenate((np.full(half, np.nan), y, np.full(half, np.nan)))
    z = y - np.nanmedian(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)
    z = z - z.mean()
    cc, ss, cs, cz, sz, zz = (c * c).sum(1), (s * s).sum(1), (c * s).sum(1), c @ z, s @ z, z @ z
    det = cc * ss - cs * cs
    ok = (det > EPS) & (zz > EPS)
    return float(np.where(ok, (ss * cz * cz - 2 * cs * cz * sz + cc * sz * sz) / np.where(ok, det * zz, 1), 0).max(initial=0))


def published_tail(series: DataFrame, ts: str, units: str, total: str, a: str, keep_first: bool = False) -> DataFrame:
    """The second half of a published cumulative series against two curves between its ends.

    ``oracle_a``: whole counts at the tail's final rate, rounded cumulatively so that every batch is a possible one. ``line_target``: the share on a
    straight line over units; ``required_share`` is what a batch would need for it, ``unphysical`` where that isn't possible.
    ``series`` has d_ columns of :func:`countloom.operators.series.deltas`; one row per update. What would be divided by zero is null.
    """
    w = Window.orderBy(ts)
    k = F.row_number().over(w)
    tail = series.withColumn("k", k).withColumn("m", F.count("*").over(Window.partitionBy())).where(F.col("k") >= F.expr("m div 2"))
    ends = tail.agg(*[f(c, ts).alias(f"{c}{i}") for c in (total, a, units) for i, f in ((0, F.min_by), (1, F.max_by))])  # one row
    q = tail.crossJoin(F.broadcast(ends))
    n0, n1, a0, a1, u0, u1 = (F.col(f"{c}{i}") for c in (total, a, units) for i in (0, 1))
    x = F.col(units) - u0
    first, last = F.try_divide(a0, n0), F.try_divide(a1, n1)
    line = first + F.try_divide(last - first, u1 - u0) * x
    q = q.withColumns({"oracle_a": a0 + F.floor(F.try_divide(a1 - a0, n1 - n0) * (F.col(total) - n0) + 0.5), "line": line, "x": x})
    q = q.withColumns({"p_total": F.lag(total).over(w), "p_line": F.lag("line").over(w)})
    need = F.col("line") * F.col(total) - F.col("p_line") * F.col("p_total")
    out = q.select(ts, "x", F.col(total).alias("total"), f"d_{total}", f"d_{a}", "p_total", F.try_divide(F.lit(100.0) * F.col(a), F.col(total)).alias("actual"), "oracle_a", F.try_divide(F.lit(100.0) * (F.col(a) - F.col("oracle_a")), F.col(total)).alias("oracle_residual"),
        (F.lit(100.0) * F.col("line")).alias("line_target"), F.try_divide(F.lit(100.0) * need, F.col(f"d_{total}")).alias("required_share"), (F.col(f"d_{a}") - need).alias("deviation"), (~need.between(F.lit(0.0), F.col(f"d_{total}").cast("double"))).alias("unphysical"))
    return out if keep_first else out.where(F.col("p_total").isNotNull() & (F.col(f"d_{total}") > 0)).drop("x", "total", "p_total")
