"""Queries: exports, fixed reports, pairwise correlations, coverage, spreads and audits of single claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from countloom.functions import scalars
from countloom.operators import aggregates as A
from countloom.operators import reconcile as R
from countloom.operators import series as S
from countloom.operators import stats as M
from countloom.plans.counts import _SHARES, unit_shares
from countloom.plans.registry import query
from countloom.plans.series import _DELTAS, _deltas
from countloom.sources.driver import COUNTED, FEED, THREE_SOURCES, UNIT_MATRIX, counted, feed, table, three_sources, unit_matrix


@query(f"WITH {COUNTED} SELECT region, zone, unit, category, CAST(sum(n) AS BIGINT) AS n FROM counted WHERE region IN ('NATION_3', 'NATION_7', 'NATION_12') AND zone IN (7, 21, 35, 60) AND category NOT IN ('NO') GROUP BY ALL ORDER BY region, zone, unit, category")
def filtered_export(spark, sf_dir):
    """Optional predicates joined to one filter, in a numeric-aware order."""
    wanted = {"region": ["NATION_3", "NATION_7", "NATION_12"], "zone": [7, 21, 35, 60], "contest": None}
    conditions = [F.col(c).isin(*v) for c, v in wanted.items() if v is not None] + [~F.col("category").isin("NO")]
    rows = counted(spark, sf_dir).where(reduce(lambda a, b: a & b, conditions))
    return rows.groupBy("region", "zone", "unit", "category").agg(F.sum("n").alias("n")).orderBy("region", "zone", "unit", "category")


@query(
    f"""WITH {COUNTED} SELECT region, contest, CAST(sum(n) AS BIGINT) AS n, count(*) AS lines, count(DISTINCT zone) AS zones, CAST(sum(CASE WHEN category = 'RF' THEN n ELSE 0 END) AS BIGINT) AS rf,
    count(*) FILTER (WHERE n >= 40) AS large FROM counted GROUP BY 1, 2"""
)
def fixed_report(spark, sf_dir):
    """The standing report of a region and contest."""
    return counted(spark, sf_dir).groupBy("region", "contest").agg(F.sum("n").alias("n"), F.count("*").alias("lines"), F.count_distinct("zone").alias("zones"), A.sum_where(F.col("category") == "RF", F.col("n")).alias("rf"), F.count_if(F.col("n") >= 40).alias("large"))


@query(
    f"""WITH {THREE_SOURCES}, s AS (SELECT region, zone, category, CAST(sum(n) FILTER (WHERE source = 'a') AS BIGINT) AS n_a, CAST(sum(n) FILTER (WHERE source = 'b') AS BIGINT) AS n_b FROM published GROUP BY 1, 2, 3)
    SELECT *, CASE WHEN n_a IS NULL THEN 'MISSING_A' WHEN n_b IS NULL THEN 'MISSING_B' WHEN n_a <> n_b THEN 'DIFFERENT' ELSE 'OK' END AS status FROM s"""
)
def two_source_status(spark, sf_dir):
    """Candidate totals of two sources, without a fallback."""
    of = lambda s: F.sum(F.when(F.col("source") == s, F.col("n")))
    sums = three_sources(spark, sf_dir).groupBy("region", "zone", "category").agg(of("a").alias("n_a"), of("b").alias("n_b"))
    return sums.withColumn("status", R.status(F.col("n_a"), F.col("n_b")))


@query(
    f"""WITH {_SHARES}, s AS (SELECT region, area, zone, unit, category, n::DOUBLE / valid::DOUBLE AS share FROM w),
    p AS (SELECT a.region, a.category AS a, b.category AS b, a.share AS x, b.share AS y FROM s a JOIN s b ON a.region = b.region AND a.area = b.area AND a.zone = b.zone AND a.unit = b.unit AND a.category < b.category),
    m AS (SELECT region, a, b, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM p GROUP BY 1, 2, 3),
    r AS (SELECT region, a, b, n, CASE WHEN n >= 30 AND sxx - sx * sx / n > 1e-12 AND syy - sy * sy / n > 1e-12 THEN greatest(-1, least(1, (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)))) END AS r FROM m)
    SELECT region, a, b, n, round(r, 6) AS r, CASE WHEN r IS NULL THEN 'UNDEFINED' WHEN r > 0.1 THEN 'UP' WHEN r < -0.1 THEN 'DOWN' ELSE 'FLAT' END AS direction FROM r"""
)
def pair_correlations(spark, sf_dir):
    """Correlation of every pair of categories over the units that have both, with its direction.

    A unit's few categories become an array once and the pairs come from it; there is no self-join.
    """
    units = unit_shares(spark, sf_dir).groupBy("region", "area", "zone", "unit").agg(F.sort_array(F.collect_list(F.struct("category", (F.col("n") / F.col("valid")).alias("share")))).alias("c"))
    pairs = units.select("region", F.posexplode("c").alias("k", "x"), "c").select("region", "x", F.explode(F.slice("c", F.col("k") + 2, F.size("c"))).alias("y"))
    m = M.moments(pairs.select("region", F.col("x.category").alias("a"), F.col("y.category").alias("b"), F.col("x.share").alias("x"), F.col("y.share").alias("y")), ["region", "a", "b"], "x", "y")
    n = F.col("n")
    r = M.pearson(F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n, F.col("sxy") - F.col("sx") * F.col("sy") / n, n)
    direction = F.when(F.col("r").isNull(), "UNDEFINED").when(F.col("r") > 0.1, "UP").when(F.col("r") < -0.1, "DOWN").otherwise("FLAT")
    return m.select("region", "a", "b", "n", r.alias("r")).select("region", "a", "b", "n", F.round("r", 6).alias("r"), direction.alias("direction"))


@query(
    f"""WITH {COUNTED}, t AS (SELECT region, sum(n) FILTER (WHERE l_partkey % 83 <> 0) AS a, sum(n + CASE WHEN l_partkey % 89 = 0 THEN 1 ELSE 0 END) FILTER (WHERE l_partkey % 97 <> 0) AS b,
    sum(n) FILTER (WHERE l_partkey % 83 = 0) AS left_out, sum(n) FILTER (WHERE l_partkey % 97 = 0) AS held_back, count(*) FILTER (WHERE l_partkey % 89 = 0 AND l_partkey % 97 <> 0) AS added FROM counted GROUP BY 1),
    d AS (SELECT region, CAST(b - a AS BIGINT) AS excess, CAST(coalesce(left_out, 0) - coalesce(held_back, 0) + added AS BIGINT) AS explained FROM t)
    SELECT region, excess, explained, excess - explained AS corrected, CASE WHEN excess = explained THEN 'EXPLAINED' ELSE 'OPEN' END AS status FROM d"""
)
def excess_explained(spark, sf_dir):
    """Whether the excess of one source equals what known reclassifications account for, and the corrected rest."""
    k = F.col("l_partkey")
    n = F.col("n")
    t = counted(spark, sf_dir).groupBy("region").agg(
        A.sum_where(k % 83 != 0, n).alias("a"), A.sum_where(k % 97 != 0, n + F.when(k % 89 == 0, 1).otherwise(0)).alias("b"), A.sum_where(k % 83 == 0, n).alias("left_out"), A.sum_where(k % 97 == 0, n).alias("held_back"), F.count_if((k % 89 == 0) & (k % 97 != 0)).alias("added")
    )
    d = t.select("region", (F.col("b") - F.col("a")).alias("excess"), (F.col("left_out") - F.col("held_back") + F.col("added")).alias("explained"))
    return d.select("*", (F.col("excess") - F.col("explained")).alias("corrected"), F.when(F.col("excess") == F.col("explained"), "EXPLAINED").otherwise("OPEN").alias("status"))


@query(
    f"""WITH {COUNTED}, u AS (SELECT region, unit, max(received) AS done FROM counted GROUP BY 1, 2)
    SELECT region, count(*) AS units, count(DISTINCT done) AS moments, min(done) AS first, max(done) AS last, round(count(DISTINCT done)::DOUBLE / count(*), 6) AS ratio FROM u GROUP BY 1"""
)
def burst_quality(spark, sf_dir):
    """How many distinct moments the completions of a region have: a low ratio shows bursts."""
    u = counted(spark, sf_dir).groupBy("region", "unit").agg(F.max("received").alias("done"))
    return u.groupBy("region").agg(F.count("*").alias("units"), F.count_distinct("done").alias("moments"), F.min("done").alias("first"), F.max("done").alias("last"), F.round(F.count_distinct("done") / F.count("*"), 6).alias("ratio"))


@query(
    f"""WITH {_DELTAS}, p AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 'before' ELSE 'after' END AS period, d_a, d_b, d_total FROM deltas WHERE d_total IS NOT NULL)
    SELECT period, count(*) AS batches, count(*) FILTER (WHERE NOT d_a >= d_b) AS broken, CAST(min(d_total) AS BIGINT) AS least, CAST(max(d_total) AS BIGINT) AS most FROM p GROUP BY 1"""
)
def period_flags(spark, sf_dir):
    """Batches before and after a moment: how many break a relation, and their range."""
    d = _deltas(spark, sf_dir).where("d_total is not null")
    period = F.when(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), "before").otherwise("after")
    return d.groupBy(period.alias("period")).agg(F.count("*").alias("batches"), F.count_if(~(F.col("d_a") >= F.col("d_b"))).alias("broken"), F.min("d_total").alias("least"), F.max("d_total").alias("most"))


@query(
    f"""WITH {COUNTED}, u AS (SELECT region, contest, unit, min(received) FILTER (WHERE l_suppkey % 9 <> 0) AS arrived FROM counted GROUP BY 1, 2, 3)
    SELECT region, contest, count(*) AS units, count(arrived) AS with_time, count(*) - count(arrived) AS without_time, count(*) FILTER (WHERE arrived < TIMESTAMP '1996-01-01 00:00:00') AS early, round(100.0::DOUBLE * count(arrived) / count(*), 6) AS percent FROM u GROUP BY 1, 2"""
)
def arrival_coverage(spark, sf_dir):
    """Units with a time of arrival, without one, and early ones."""
    arrived = F.min(F.when(F.col("l_suppkey") % 9 != 0, F.col("received")))
    u = counted(spark, sf_dir).groupBy("region", "contest", "unit").agg(arrived.alias("arrived"))
    early = F.count_if(F.col("arrived") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))
    return u.groupBy("region", "contest").agg(F.count("*").alias("units"), F.count("arrived").alias("with_time"), (F.count("*") - F.count("arrived")).alias("without_time"), early.alias("early"), F.round(F.lit(100.0) * F.count("arrived") / F.count("*"), 6).alias("percent"))


@query(f"WITH {FEED} SELECT date_trunc('minute', ts) AS bucket, count(*) AS events, CAST(sum(n) AS BIGINT) AS total FROM feed GROUP BY 1 ORDER BY events DESC, bucket LIMIT 30")
def peak_minutes(spark, sf_dir):
    """T5: the thirty busiest minutes, ties by time."""
    return S.bucket(feed(spark, sf_dir), "minute").orderBy(F.desc("events"), "bucket").limit(30)


@query(
    f"""WITH {_SHARES}, x AS (SELECT region, n::DOUBLE / valid::DOUBLE AS share FROM w WHERE category = 'RF')
    SELECT region, count(*) AS n, round(quantile_cont(share, 0.05), 6) AS p05, round(quantile_cont(share, 0.25), 6) AS p25, round(quantile_cont(share, 0.5), 6) AS p50, round(quantile_cont(share, 0.75), 6) AS p75, round(quantile_cont(share, 0.95), 6) AS p95 FROM x GROUP BY 1"""
)
def share_quantiles(spark, sf_dir):
    """Exact quantiles by linear interpolation."""
    x = unit_shares(spark, sf_dir).where("category = 'RF'").select("region", (F.col("n") / F.col("valid")).alias("share"))
    q = F.percentile("share", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    names = ("p05", "p25", "p50", "p75", "p95")
    return x.groupBy("region").agg(F.count("*").alias("n"), q.alias("q")).select("region", "n", *[F.round(F.col("q")[k], 6).alias(name) for k, name in enumerate(names)])


@query(
    f"""WITH {FEED}, h AS (SELECT date_trunc('hour', ts) AS ts, category, sum(n) AS n FROM feed GROUP BY 1, 2), c AS (SELECT ts, category, sum(n) OVER (PARTITION BY category ORDER BY ts) AS cum FROM h)
    SELECT ts, count(*) AS categories, CAST(min(cum) AS BIGINT) AS least, CAST(max(cum) AS BIGINT) AS most, median(cum)::DOUBLE AS median, CAST(max(cum) - min(cum) AS BIGINT) AS spread FROM c GROUP BY 1"""
)
def alignment_spread(spark, sf_dir):
    """How far several cumulative series lie apart at the same time."""
    hours = feed(spark, sf_dir).groupBy(scalars.floor_time("hour", "ts").alias("ts"), "category").agg(F.sum("n").alias("n"))
    c = S.cumulative(hours, "ts", ["n"], ["category"])
    return c.groupBy("ts").agg(F.count("*").alias("categories"), F.min("n").alias("least"), F.max("n").alias("most"), F.median("n").alias("median"), (F.max("n") - F.min("n")).alias("spread"))


@query(f"WITH {UNIT_MATRIX} SELECT region, area, zone, unit, p, g FROM matrix WHERE p > g + 50 ORDER BY region, area, zone, unit LIMIT 100")
def first_violations(spark, sf_dir):
    """The first hundred unexpected units, in key order."""
    return unit_matrix(spark, sf_dir).where("p > g + 50").select("region", "area", "zone", "unit", "p", "g").orderBy("region", "area", "zone", "unit").limit(100)


@query(
    """WITH t AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%d/%m/%Y') AS day FROM orders)
    SELECT o_orderkey, day, row_number() OVER (PARTITION BY o_custkey ORDER BY strptime(day, '%d/%m/%Y'), o_orderkey) AS place FROM t"""
)
def chronological(spark, sf_dir):
    """Rows in the order of dates that are written day first."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").withColumn("day", F.date_format("o_orderdate", "dd/MM/yyyy"))
    w = Window.partitionBy("o_custkey").orderBy(F.try_to_timestamp("day", F.lit("dd/MM/yyyy")), "o_orderkey")
    return rows.select("o_orderkey", "day", F.row_number().over(w).alias("place"))


@query(
    f"""WITH {THREE_SOURCES}, z AS (SELECT region, zone, count(DISTINCT unit) FILTER (WHERE source = 'a') AS received, count(DISTINCT unit) FILTER (WHERE source = 'b') AS published, count(DISTINCT unit) FILTER (WHERE source = 'fallback') AS back FROM published GROUP BY 1, 2)
    SELECT *, CASE WHEN received = published THEN 'CLOSED' WHEN received > published AND back > 0 THEN 'IN_FALLBACK' WHEN received > published THEN 'NOT_PUBLISHED' ELSE 'NOT_RECEIVED' END AS gap FROM z"""
)
def locality_gap(spark, sf_dir):
    """Units received and published in a zone, and where the gap sits."""
    of = lambda s: F.count_distinct(F.when(F.col("source") == s, F.col("unit")))
    z = three_sources(spark, sf_dir).groupBy("region", "zone").agg(of("a").alias("received"), of("b").alias("published"), of("fallback").alias("back"))
    gap = F.when(F.col("received") == F.col("published"), "CLOSED").when((F.col("received") > F.col("published")) & (F.col("back") > 0), "IN_FALLBACK").when(F.col("received") > F.col("published"), "NOT_PUBLISHED").otherwise("NOT_RECEIVED")
    return z.withColumn("gap", gap)


@query(
    """WITH p AS (SELECT p_brand, lower(p_type || ' ' || p_name) AS t, p_size FROM part)
    SELECT p_brand, count(*) AS parts, count(*) FILTER (WHERE t LIKE '%steel%' OR t LIKE '%brass%') AS metal, count(*) FILTER (WHERE t LIKE '%promo%') AS promo, bool_or(p_size > 45) AS large, count(*) FILTER (WHERE NOT regexp_matches(t, '[0-9]')) AS without_digits FROM p GROUP BY 1"""
)
def text_flags(spark, sf_dir):
    """Flags from words in a text, counted per group."""
    t = F.lower(F.concat_ws(" ", "p_type", "p_name"))
    p = table(spark, sf_dir, "part", "p_brand", "p_type", "p_name", "p_size").select("p_brand", t.alias("t"), "p_size")
    return p.groupBy("p_brand").agg(
        F.count("*").alias("parts"), F.count_if(F.col("t").contains("steel") | F.col("t").contains("brass")).alias("metal"), F.count_if(F.col("t").contains("promo")).alias("promo"), F.bool_or(F.col("p_size") > 45).alias("large"), F.count_if(~F.col("t").rlike("[0-9]")).alias("without_digits")
    )


@query(
    f"""WITH {UNIT_MATRIX}, xy AS (SELECT region, p::DOUBLE AS x, g::DOUBLE AS y FROM matrix WHERE p IS NOT NULL AND g IS NOT NULL),
    m AS (SELECT region, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM xy GROUP BY 1), r AS (SELECT n, (sxy - sx * sy / n) / nullif(sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)), 0) AS r FROM m)
    SELECT count(*) AS coefficients, count(*) FILTER (WHERE r IS NULL OR isnan(r)) AS undefined, count(*) FILTER (WHERE abs(r) > 1.000001) AS invalid, count(*) FILTER (WHERE n < 30) AS small FROM r"""
)
def coefficient_check(spark, sf_dir):
    """Stored coefficients recomputed: how many are undefined or out of range."""
    m = M.moments(unit_matrix(spark, sf_dir).where("p is not null and g is not null"), ["region"], "p", "g")
    n = F.col("n")
    xx, yy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    r = m.select("n", F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / n, F.sqrt(xx * yy)).alias("r"))
    return r.agg(F.count("*").alias("coefficients"), F.count_if(F.col("r").isNull()).alias("undefined"), F.count_if(F.abs("r") > 1.000001).alias("invalid"), F.count_if(n < 30).alias("small"))
