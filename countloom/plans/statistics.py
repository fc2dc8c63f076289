"""Queries: digit tests, shapes, correlation within groups, bounds, fits, periods and resampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from countloom.functions import scalars
from countloom.operators import aggregates as A
from countloom.operators import series as S
from countloom.operators import stats as M
from countloom.plans.counts import _SHARES, unit_shares
from countloom.plans.registry import query
from countloom.plans.series import _DELTAS, _RESIDUALS, _deltas, residuals
from countloom.sources.driver import COUNTED, SNAPSHOTS, UNIT_MATRIX, counted, snapshots, unit_matrix

_TOTALS = f"{COUNTED}, t AS (SELECT unit, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY 1)"
_OK = "(SELECT count(*) >= 100 AND count(DISTINCT n) >= 30 AND max(n) >= 10 * min(n) FROM t)"


def _totals(spark, sf_dir):
    return counted(spark, sf_dir).groupBy("unit").agg(F.sum("n").alias("n"))


def _applies():
    return (F.count("*") >= 100) & (F.count_distinct("n") >= 30) & (F.max("n") >= 10 * F.min("n"))


def _rounded(df):
    return df.select("digit", "n", F.round("share", 6).alias("share"), F.round("expected", 6).alias("expected"))


@query(
    f"""WITH {_TOTALS}, d AS (SELECT CAST(substr(CAST(n AS VARCHAR), 1, 1) AS INT) AS digit, count(*) AS n FROM t GROUP BY 1)
    SELECT digit, n, round(n::DOUBLE / (SELECT sum(n) FROM d), 6) AS share, round(log10(1 + 1.0::DOUBLE / digit), 6) AS expected FROM d WHERE {_OK}"""
)
def benford_first(spark, sf_dir):
    """First digits of unit totals."""
    return _rounded(M.digit_table(_totals(spark, sf_dir), scalars.first_digit(F.col("n")), M.benford_share(F.col("digit")), _applies()))


@query(
    f"""WITH {_TOTALS}, d AS (SELECT CAST(substr(CAST(n AS VARCHAR), 2, 1) AS INT) AS digit, count(*) AS n FROM t WHERE n >= 10 GROUP BY 1)
    SELECT digit, n, round(n::DOUBLE / (SELECT sum(n) FROM d), 6) AS share,
    round((SELECT sum(log10(1 + 1.0::DOUBLE / (10 * k + digit))) FROM range(1, 10) AS r(k)), 6) AS expected FROM d WHERE {_OK}"""
)
def benford_second(spark, sf_dir):
    """Second digits of unit totals."""
    return _rounded(M.digit_table(_totals(spark, sf_dir), scalars.second_digit(F.col("n")), M.benford_share(F.col("digit"), True), _applies()))


@query(
    f"""WITH {_TOTALS}, d AS (SELECT CAST(n % 10 AS INT) AS digit, count(*) AS n FROM t WHERE n >= 30 GROUP BY 1)
    SELECT digit, n, round(n::DOUBLE / (SELECT sum(n) FROM d), 6) AS share, 0.1::DOUBLE AS expected FROM d"""
)
def last_digit(spark, sf_dir):
    """last digits of totals of 30 or more."""
    return _rounded(M.digit_table(_totals(spark, sf_dir).where("n >= 30"), scalars.last_digit(F.col("n")), F.lit(0.1), F.count("*") >= 0))


_RF = f"{_SHARES}, x AS (SELECT region, area, zone, unit, n::DOUBLE / valid::DOUBLE AS share FROM w WHERE category = 'RF')"


def _rf(spark, sf_dir):
    return unit_shares(spark, sf_dir).where("category = 'RF'").select("region", "area", "zone", "unit", (F.col("n") / F.col("valid")).alias("share"))


@query(
    f"""WITH {_RF}, c AS (SELECT region, median(share) AS median FROM x GROUP BY 1), o AS (SELECT x.*, c.median, abs(share - c.median) AS off FROM x JOIN c USING (region)),
    m AS (SELECT region, median(off) AS mad FROM o GROUP BY 1), z AS (SELECT region, unit, share, median, mad, (share - median) / (1.4826::DOUBLE * mad) AS z FROM o JOIN m USING (region) WHERE mad >= 0.015)
    SELECT region, unit, round(share, 6) AS share, round(median, 6) AS median, round(mad, 6) AS mad, round(z, 6) AS z, row_number() OVER (PARTITION BY region ORDER BY round(abs(z), 9) DESC, unit) AS rank
    FROM z WHERE abs(z) >= 2 QUALIFY rank <= 5"""
)
def robust_outliers(spark, sf_dir):
    """M6 T4: units whose share lies far from their region's median; the five farthest of each."""
    z = M.robust_outliers(_rf(spark, sf_dir), ["region"], "share", 2.0)
    top = A.top_k(z, ["region"], [F.round(F.abs("z"), 9).desc(), F.asc("unit")], 5)
    return top.select("region", "unit", *[F.round(c, 6).alias(c) for c in ("share", "median", "mad", "z")], "rank")


@query(
    f"""WITH {_RF}, m AS (SELECT region, avg(share) AS mean FROM x GROUP BY 1), c AS (SELECT region, count(*) AS n, avg(pow(share - mean, 2)) AS m2, avg(pow(share - mean, 3)) AS m3, avg(pow(share - mean, 4)) AS m4
    FROM x JOIN m USING (region) GROUP BY 1) SELECT region, n, CASE WHEN n >= 30 AND m2 > 1e-12 THEN round(m3 / pow(m2, 1.5), 6) END AS skew, CASE WHEN n >= 30 AND m2 > 1e-12 THEN round(m4 / (m2 * m2) - 3, 6) END AS excess FROM c"""
)
def shape_moments(spark, sf_dir):
    """M5: skewness and excess kurtosis of shares in a region."""
    return M.shape(_rf(spark, sf_dir), ["region"], "share").select("region", "n", F.round("skew", 6).alias("skew"), F.round("excess", 6).alias("excess"))


_PAIR = f"""{UNIT_MATRIX}, xy AS (SELECT region, area, zone, unit, p::DOUBLE / (p + g + s) AS x, g::DOUBLE / (p + g + s) AS y FROM matrix WHERE p IS NOT NULL AND g IS NOT NULL AND s IS NOT NULL),
  m AS (SELECT region, area, zone, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM xy GROUP BY 1, 2, 3),
  t AS (SELECT region, CAST(sum(n) AS BIGINT) AS n, count(*) AS groups, sum(sxx) - sum(sx) * sum(sx) / sum(n) AS rxx, sum(syy) - sum(sy) * sum(sy) / sum(n) AS ryy, sum(sxy) - sum(sx) * sum(sy) / sum(n) AS rxy,
    sum(sxx - sx * sx / n) AS cxx, sum(syy - sy * sy / n) AS cyy, sum(sxy - sx * sy / n) AS cxy FROM m GROUP BY 1),
  r AS (SELECT region, n, groups, CASE WHEN n >= 30 AND rxx > 1e-12 AND ryy > 1e-12 THEN greatest(-1, least(1, rxy / sqrt(rxx * ryy))) END AS r_raw,
    CASE WHEN n >= 30 AND cxx > 1e-12 AND cyy > 1e-12 THEN greatest(-1, least(1, cxy / sqrt(cxx * cyy))) END AS r_within FROM t)"""


def _pair_moments(spark, sf_dir):
    whole = F.col("p") + F.col("g") + F.col("s")
    xy = unit_matrix(spark, sf_dir).where(whole.isNotNull()).select("region", "area", "zone", (F.col("p") / whole).alias("x"), (F.col("g") / whole).alias("y"))
    return M.moments(xy, ["region", "area", "zone"], "x", "y")


@query(f"WITH {_PAIR} SELECT region, n, groups, round(r_raw, 6) AS r_raw, round(r_within, 6) AS r_within FROM r")
def pearson_raw_within(spark, sf_dir):
    """Correlation of two shares over units, and within zones."""
    r = M.raw_and_within(_pair_moments(spark, sf_dir), ["region"], ["area", "zone"])
    return r.select("region", "n", "groups", F.round("r_raw", 6).alias("r_raw"), F.round("r_within", 6).alias("r_within"))


@query(
    f"""WITH {_PAIR} SELECT region, n >= 30 AND groups >= 5 AS eligible, CASE WHEN r_raw IS NULL OR r_within IS NULL THEN 'UNDEFINED' WHEN sign(r_raw) * sign(r_within) < 0 AND abs(r_raw) >= 0.1 AND abs(r_within) >= 0.1 THEN 'REVERSED'
    WHEN abs(r_raw - r_within) >= 0.2 THEN 'SHIFTED' ELSE 'STABLE' END AS label FROM r"""
)
def reversal_flags(spark, sf_dir):
    """Whether the coefficient turns or moves within zones."""
    r = M.raw_and_within(_pair_moments(spark, sf_dir), ["region"], ["area", "zone"])
    return r.select("region", ((F.col("n") >= 30) & (F.col("groups") >= 5)).alias("eligible"), M.reversal(F.col("r_raw"), F.col("r_within")).alias("label"))


@query(
    f"""WITH {_PAIR}, c AS (SELECT region, area, zone, n, sxx - sx * sx / n AS cxx, syy - sy * sy / n AS cyy, sxy - sx * sy / n AS cxy FROM m),
    w AS (SELECT *, sum(n) OVER v - n AS rn, sum(cxx) OVER v - cxx AS rxx, sum(cyy) OVER v - cyy AS ryy, sum(cxy) OVER v - cxy AS rxy FROM c WINDOW v AS (PARTITION BY region))
    SELECT region, area, zone, CASE WHEN rn >= 30 AND rxx > 1e-12 AND ryy > 1e-12 THEN round(greatest(-1, least(1, rxy / sqrt(rxx * ryy))), 6) END AS r_without FROM w"""
)
def zone_loo(spark, sf_dir):
    """The coefficient without each zone, from one pass."""
    out = M.leave_group_out(_pair_moments(spark, sf_dir), ["region"], ["area", "zone"])
    return out.select("region", "area", "zone", F.round("r_without", 6).alias("r_without"))


@query(
    f"""WITH {_PAIR}, k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY area, zone) - 1 AS k, count(*) OVER (PARTITION BY region) AS groups FROM m),
    d AS (SELECT k.region, replicate, k.groups, k.k AS place FROM k, range(1, 401) AS r(replicate)),
    p AS (SELECT region, replicate, ('0x' || substr(md5('3|' || replicate || '|' || place), 1, 8))::BIGINT % groups AS k FROM d),
    b AS (SELECT region, replicate, sum(n) AS n, sum(sxx - sx * sx / n) AS cxx, sum(syy - sy * sy / n) AS cyy, sum(sxy - sx * sy / n) AS cxy FROM p JOIN k USING (region, k) GROUP BY 1, 2),
    c AS (SELECT region, replicate, CASE WHEN n >= 2 AND cxx > 1e-12 AND cyy > 1e-12 THEN greatest(-1, least(1, cxy / sqrt(cxx * cyy))) END AS r FROM b)
    SELECT region, count(*) AS replicates, round(quantile_cont(r, 0.025), 6) AS low, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.975), 6) AS high FROM c GROUP BY 1"""
)
def zone_bootstrap(spark, sf_dir):
    """Quantiles of the coefficient over resampled zones, drawn by a hash."""
    out = M.group_bootstrap(_pair_moments(spark, sf_dir), ["region"], ["area", "zone"])
    return out.select("region", "replicates", *[F.round(c, 6).alias(c) for c in ("low", "median", "high")])


@query(
    f"""WITH {COUNTED}, t AS (SELECT region, zone, CAST(sum(n) AS BIGINT) AS x, CAST(sum(n) FILTER (WHERE category = 'RF') AS BIGINT) AS y FROM counted GROUP BY 1, 2),
    r AS (SELECT region, 2 * rank() OVER (PARTITION BY region ORDER BY x) + count(*) OVER (PARTITION BY region, x) - 1 AS a, 2 * rank() OVER (PARTITION BY region ORDER BY y) + count(*) OVER (PARTITION BY region, y) - 1 AS b FROM t WHERE y IS NOT NULL),
    s AS (SELECT region, count(*) AS n, sum(a)::DOUBLE AS sa, sum(b)::DOUBLE AS sb, sum(a * a)::DOUBLE AS saa, sum(b * b)::DOUBLE AS sbb, sum(a * b)::DOUBLE AS sab FROM r GROUP BY 1)
    SELECT region, n, CASE WHEN n >= 5 AND saa - sa * sa / n > 1e-12 AND sbb - sb * sb / n > 1e-12 THEN round(greatest(-1, least(1, (sab - sa * sb / n) / sqrt((saa - sa * sa / n) * (sbb - sb * sb / n)))), 6) END AS rho FROM s"""
)
def spearman_units(spark, sf_dir):
    """Rank correlation of a zone's size and a category's count, with average ranks."""
    t = counted(spark, sf_dir).groupBy("region", "zone").agg(F.sum("n").alias("x"), F.sum(F.when(F.col("category") == "RF", F.col("n"))).alias("y")).where("y is not null")
    r = t.select("region", S.double_rank("x", ["region"]).alias("a"), S.double_rank("y", ["region"]).alias("b"))
    m, n = M.moments(r, ["region"], "a", "b"), F.col("n")
    rho = M.pearson(F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n, F.col("sxy") - F.col("sx") * F.col("sy") / n, n, 5)
    return m.select("region", "n", F.round(rho, 6).alias("rho"))


_BOUNDS = f"""{UNIT_MATRIX}, b AS (SELECT region, area, unit, p, g, coalesce(p, 0) + coalesce(g, 0) + coalesce(s, 0) AS n, (coalesce(p, 0) + coalesce(g, 0)) AS size FROM matrix WHERE p IS NOT NULL AND g IS NOT NULL)"""


def _bounded(spark, sf_dir):
    n = F.col("p") + F.col("g") + F.coalesce("s", F.lit(0))
    return unit_matrix(spark, sf_dir).where("p is not null and g is not null").withColumn("n", n)


@query(f"WITH {_BOUNDS} SELECT region, CAST(sum(greatest(0, p + g - n)) AS BIGINT) AS low, CAST(sum(least(p, g)) AS BIGINT) AS high, CAST(sum(greatest(0, g - p)) AS BIGINT) AS outside, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1")
def frechet_bounds(spark, sf_dir):
    """What two categories can have in common, per unit and summed."""
    low, high, outside = M.frechet(F.col("p"), F.col("g"), F.col("n"))
    return _bounded(spark, sf_dir).groupBy("region").agg(F.sum(low).alias("low"), F.sum(high).alias("high"), F.sum(outside).alias("outside"), F.sum("n").alias("n"))


@query(
    f"""WITH {_BOUNDS}, l AS (SELECT region, sum(least(p, g)) AS high, sum(greatest(0, g - p)) AS outside, sum(p) AS p, sum(g) AS g FROM b GROUP BY 1)
    SELECT region, CAST(high AS BIGINT) AS local_high, CAST(least(p, g) AS BIGINT) AS total_high, CAST(least(p, g) - high AS BIGINT) AS gain_high, CAST(outside - greatest(0, g - p) AS BIGINT) AS gain_outside FROM l"""
)
def bounds_localization_gain(spark, sf_dir):
    """Bounds summed over units are tighter than the bounds of the sums; the difference."""
    _, high, outside = M.frechet(F.col("p"), F.col("g"), F.col("n"))
    t = _bounded(spark, sf_dir).groupBy("region").agg(F.sum(high).alias("h"), F.sum(outside).alias("o"), F.sum("p").alias("p"), F.sum("g").alias("g"), F.sum("n").alias("n"))
    _, total, out = M.frechet(F.col("p"), F.col("g"), F.col("n"))
    return t.select("region", F.col("h").alias("local_high"), total.alias("total_high"), (total - F.col("h")).alias("gain_high"), (F.col("o") - out).alias("gain_outside"))


_SCENARIOS = [("narrow", ["RF"]), ("wide", ["RF", "AF"]), ("all", ["RF", "AF", "NF", "NO"])]


@query(
    f"""WITH {COUNTED}, sc(scenario, category) AS (VALUES {", ".join(f"('{s}', '{c}')" for s, cs in _SCENARIOS for c in cs)}), t AS (SELECT region, contest, category, sum(n) AS n FROM counted GROUP BY ALL),
    v AS (SELECT scenario, region, contest, sum(n) AS block FROM t JOIN sc USING (category) GROUP BY ALL), w AS (SELECT region, contest, sum(n) AS turnout FROM t GROUP BY ALL),
    p AS (SELECT scenario, region, sum(block) FILTER (WHERE contest = '1') AS g, sum(block) FILTER (WHERE contest = '2') AS h FROM v GROUP BY ALL), q AS (SELECT region, min(turnout) FILTER (WHERE contest = '1') AS turnout FROM w GROUP BY 1)
    SELECT scenario, region, CAST(g AS BIGINT) AS g, CAST(h AS BIGINT) AS h, CAST(greatest(0, g - h) AS BIGINT) AS outside, CAST(least(turnout, g + h) AS BIGINT) AS either, g > h AS positive,
    bool_and(g > h) OVER (PARTITION BY region) AS positive_in_all FROM p JOIN q USING (region)"""
)
def scenario_bounds(spark, sf_dir):
    """Bounds under several definitions of a block, and whether all of them agree."""
    from pyspark.sql import Window

    t = counted(spark, sf_dir).groupBy("region", "contest", "category").agg(F.sum("n").alias("n"))
    scenarios = spark.createDataFrame([(s, c) for s, cs in _SCENARIOS for c in cs], "scenario string, category string")
    of = lambda c: F.sum(F.when(F.col("contest") == c, F.col("n")))
    p = t.join(F.broadcast(scenarios), "category").groupBy("scenario", "region").agg(of("1").alias("g"), of("2").alias("h"))
    p = p.join(t.groupBy("region").agg(of("1").alias("turnout")), "region")
    positive = F.col("g") > F.col("h")
    return p.select("scenario", "region", "g", "h", F.greatest(F.lit(0), F.col("g") - F.col("h")).alias("outside"), F.least(F.col("turnout"), F.col("g") + F.col("h")).alias("either"), positive.alias("positive"), F.bool_and(positive).over(Window.partitionBy("region")).alias("positive_in_all"))


@query(
    f"""WITH {SNAPSHOTS}, h AS (SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM snapshots)) / 3600000000.0::DOUBLE AS x, total::DOUBLE AS y FROM snapshots),
    m AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM h),
    c AS (SELECT n, sx, sy, sxx - sx * sx / n AS xx, syy - sy * sy / n AS yy, sxy - sx * sy / n AS xy FROM m)
    SELECT n, round(xy / xx, 4) AS slope, round((sy - xy / xx * sx) / n, 3) AS intercept, round(xy * xy / (xx * yy), 9) AS r2, round(sqrt((yy - xy / xx * xy) / n), 3) AS rmse FROM c"""
)
def line_fit(spark, sf_dir):
    """A line through the cumulative series, on its real time axis."""
    s = snapshots(spark, sf_dir).select("total", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    first = s.agg(F.min("us").alias("zero"))  # one row
    rows = s.crossJoin(F.broadcast(first)).select(((F.col("us") - F.col("zero")) / 3_600_000_000).alias("x"), F.col("total").alias("y"))
    return M.line_fit(rows, "x", "y").select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 9).alias("r2"), F.round("rmse", 3).alias("rmse"))


_LOW, _HIGH, _N = 3.0, 168.0, 48
_GRID = f"(SELECT {_LOW}::DOUBLE * exp(k * (ln({_HIGH}::DOUBLE) - ln({_LOW}::DOUBLE)) / {_N - 1}) AS period FROM range({_N}) AS r(k))"


def _hours(spark, sf_dir):
    return residuals(spark, sf_dir).select((F.unix_seconds(F.col("ts").cast("timestamp")) / 3600 - 473352).alias("hour"), "ts", "residual")


@query(
    f"""WITH {_RESIDUALS}, v AS (SELECT period, cos(2 * pi() * (epoch(ts) / 3600.0::DOUBLE - 473352) / period) AS c, sin(2 * pi() * (epoch(ts) / 3600.0::DOUBLE - 473352) / period) AS s, residual::DOUBLE AS z FROM residuals, {_GRID} g),
    k AS (SELECT period, sum(c * c) - sum(c) * sum(c) / count(*) AS cc, sum(s * s) - sum(s) * sum(s) / count(*) AS ss, sum(c * s) - sum(c) * sum(s) / count(*) AS cs, sum(c * z) - sum(c) * sum(z) / count(*) AS cz,
    sum(s * z) - sum(s) * sum(z) / count(*) AS sz, sum(z * z) - sum(z) * sum(z) / count(*) AS zz FROM v GROUP BY 1)
    SELECT round(period, 6) AS period, round((ss * cz * cz - 2 * cs * cz * sz + cc * sz * sz) / ((cc * ss - cs * cs) * zz), 6) AS r2 FROM k"""
)
def periodogram(spark, sf_dir):
    """Variance of the residuals that each period of a grid explains."""
    grid = spark.range(1).select(F.explode(M.log_grid(_LOW, _HIGH, _N)).alias("period"))
    return M.periodogram(_hours(spark, sf_dir), "hour", "residual", grid).select(F.round("period", 6).alias("period"), F.round("r2", 6).alias("r2"))


@query(
    f"""WITH {_RESIDUALS}, o AS (SELECT epoch(ts) / 3600.0::DOUBLE - 473352 AS x, residual::DOUBLE AS v, row_number() OVER (ORDER BY ts) - 1 AS k, count(*) OVER () AS n FROM residuals),
    h AS (SELECT *, (g * n + 3) // 4 AS k0 FROM (SELECT *, least(3, k * 4 // n) AS g FROM o)),
    d AS (SELECT 0 AS replicate, k AS slot, v FROM h UNION ALL SELECT replicate, k0 + row_number() OVER (PARTITION BY replicate, g ORDER BY md5('11|' || replicate || '|' || g || '|' || (k - k0)), k) - 1, v FROM h, range(1, 201) AS r(replicate)),
    w AS (SELECT replicate, period, cos(2 * pi() * x / period) AS c, sin(2 * pi() * x / period) AS s, d.v AS z FROM d JOIN h ON slot = k, {_GRID} q),
    k AS (SELECT replicate, period, sum(c * c) - sum(c) * sum(c) / count(*) AS cc, sum(s * s) - sum(s) * sum(s) / count(*) AS ss, sum(c * s) - sum(c) * sum(s) / count(*) AS cs, sum(c * z) - sum(c) * sum(z) / count(*) AS cz,
    sum(s * z) - sum(s) * sum(z) / count(*) AS sz, sum(z * z) - sum(z) * sum(z) / count(*) AS zz FROM w GROUP BY 1, 2),
    b AS (SELECT replicate, max(CASE WHEN cc * ss - cs * cs > 1e-12 AND zz > 1e-12 THEN (ss * cz * cz - 2 * cs * cz * sz + cc * sz * sz) / ((cc * ss - cs * cs) * zz) ELSE 0 END) AS best FROM k GROUP BY 1),
    a AS (SELECT any_value(o.best) AS observed, count(*) FILTER (WHERE b.best >= o.best - 1e-9) AS hits FROM b, (SELECT best FROM b WHERE replicate = 0) o WHERE replicate > 0)
    SELECT 200 AS replicates, round(observed, 6) AS observed, hits, round((hits + 1) / 201.0::DOUBLE, 6) AS p FROM a"""
)
def permutation_p(spark, sf_dir):
    """How often a shuffle within quarters of the time, drawn by a hash, explains as much as the observed order."""
    periods = np.geomspace(_LOW, _HIGH, _N).tolist()
    out = M.permutation_p(_hours(spark, sf_dir), "ts", "residual", periods, axis="hour")
    return out.select("replicates", F.round("observed", 6).alias("observed"), "hits", F.round("p", 6).alias("p"))


@query()
def hypergeometric_mix(spark, sf_dir):
    """The spread of shares over batches against random refills of the batches."""
    d = _deltas(spark, sf_dir).where("d_total > 0").select("ts", "d_total", F.least("d_a", "d_total").alias("d_a"))
    return M.hypergeometric_mix(d, "ts", "d_total", "d_a", 500)


@query(f"WITH {_DELTAS} SELECT count(*) AS n, round(sqrt(avg(pow((d_a - d_b)::DOUBLE, 2))), 6) AS rmse, round(avg(abs(d_a - d_b)), 6) AS mae FROM deltas WHERE d_a IS NOT NULL")
def series_rmse(spark, sf_dir):
    """Distance of two series."""
    e = F.col("d_a") - F.col("d_b")
    return _deltas(spark, sf_dir).where("d_a is not null").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(e.cast("double"), F.lit(2)))), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"))
