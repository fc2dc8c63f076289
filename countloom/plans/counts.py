"""Queries: reconciliation, matrices, levels, histograms, top lists, closure and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from countloom.operators import aggregates as A
from countloom.operators import reconcile as R
from countloom.plans.registry import query
from countloom.sources.driver import COUNTED, KEYS, THREE_SOURCES, UNIT, UNIT_MATRIX, counted, table, three_sources, unit_matrix

_K = ", ".join(KEYS)
_RECONCILED = f"""{THREE_SOURCES}, sums AS (
  SELECT {_K}, sum(n) FILTER (WHERE source = 'a') AS n_a, sum(n) FILTER (WHERE source = 'b') AS n_main,
         sum(n) FILTER (WHERE source = 'fallback') AS n_back FROM published GROUP BY {_K}), reconciled AS (
  SELECT {_K}, CAST(n_a AS BIGINT) AS n_a, CAST(coalesce(n_main, n_back) AS BIGINT) AS n_b,
         CAST(n_a - coalesce(n_main, n_back) AS BIGINT) AS diff,
         CASE WHEN n_a IS NULL THEN 'MISSING_A' WHEN coalesce(n_main, n_back) IS NULL THEN 'MISSING_B'
              WHEN n_a <> coalesce(n_main, n_back) THEN 'DIFFERENT' ELSE 'OK' END AS status FROM sums)"""
_JOINED = f"""{THREE_SOURCES}, a AS (SELECT {_K}, sum(n) AS n_a FROM published WHERE source = 'a' GROUP BY {_K}),
  main AS (SELECT {_K}, sum(n) AS n_b FROM published WHERE source = 'b' GROUP BY {_K}),
  back AS (SELECT {_K}, sum(n) AS n_b FROM published WHERE source = 'fallback' GROUP BY {_K}),
  b AS (SELECT * FROM main UNION ALL SELECT * FROM back WHERE NOT EXISTS (
    SELECT 1 FROM main WHERE {" AND ".join(f"main.{k} = back.{k}" for k in KEYS)}))"""


@query(f"WITH {_RECONCILED} SELECT * FROM reconciled WHERE status <> 'OK'")
def reconcile_status(spark, sf_dir):
    return R.reconcile(three_sources(spark, sf_dir), KEYS).where(F.col("status") != R.OK)


@query(
    f"""WITH {_RECONCILED} SELECT count(*) AS keys_compared, count(*) FILTER (WHERE status = 'OK') AS matches,
    count(*) FILTER (WHERE status = 'MISSING_A') AS missing_a, count(*) FILTER (WHERE status = 'MISSING_B') AS missing_b,
    count(*) FILTER (WHERE status = 'DIFFERENT') AS different FROM reconciled"""
)
def reconcile_summary(spark, sf_dir):
    return R.summary(R.reconcile(three_sources(spark, sf_dir), KEYS))


@query(
    f"""WITH {_JOINED}, j AS (SELECT {", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in KEYS)}, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b
    FROM a FULL OUTER JOIN b ON {" AND ".join(f"a.{k} = b.{k}" for k in KEYS)})
    SELECT *, n_a - n_b AS diff, CASE WHEN n_a IS NULL THEN 'MISSING_A' WHEN n_b IS NULL THEN 'MISSING_B' ELSE 'DIFFERENT' END AS status
    FROM j WHERE n_a IS NULL OR n_b IS NULL OR n_a <> n_b"""
)
def reconcile_fulljoin(spark, sf_dir):
    return R.reconcile_by_join(three_sources(spark, sf_dir), KEYS).where(F.col("status") != R.OK)


@query(
    f"""WITH {_RECONCILED} SELECT CASE WHEN grouping(contest) = 0 THEN 2 WHEN grouping(region) = 0 THEN 1 ELSE 0 END AS level,
    region, contest, status, count(*) AS n FROM reconciled WHERE status <> 'OK'
    GROUP BY GROUPING SETS ((status), (region, status), (region, contest, status))"""
)
def status_by_unit(spark, sf_dir):
    bad = R.reconcile(three_sources(spark, sf_dir), KEYS).where(F.col("status") != R.OK)
    out = A.levels(bad, [["status"], ["region", "status"], ["region", "contest", "status"]], {"n": F.count("*")})
    return out.select("level", "region", "contest", "status", "n")


@query(
    f"""WITH {THREE_SOURCES}, x AS (SELECT DISTINCT region, zone, unit FROM published WHERE source = 'a' AND category <> 'NO'),
    y AS (SELECT DISTINCT region, zone, unit FROM published WHERE source = 'fallback'),
    j AS (SELECT coalesce(x.region, y.region) AS region, CASE WHEN y.unit IS NULL THEN 'only_a' WHEN x.unit IS NULL THEN 'only_b' ELSE 'both' END AS side
    FROM x FULL OUTER JOIN y ON x.region = y.region AND x.zone = y.zone AND x.unit = y.unit) SELECT region, side, count(*) AS n FROM j GROUP BY region, side"""
)
def key_certification(spark, sf_dir):
    """Which units each of two publications has."""
    rows = three_sources(spark, sf_dir)
    keys = ["region", "zone", "unit"]
    sides = R.key_differences(rows.where("source = 'a' and category <> 'NO'"), rows.where("source = 'fallback'"), keys)
    return sides.groupBy("region", "side").agg(F.count("*").alias("n"))


@query(
    f"""WITH {THREE_SOURCES}, v AS (SELECT region, category, source, sum(n) AS n, count(*) AS rows_published FROM published GROUP BY 1, 2, 3)
    SELECT o.region, o.category, o.n = w.n AND o.rows_published = w.rows_published AS fixed_equal, o.n <> w.n AS n_changed, o.rows_published <> w.rows_published AS rows_published_changed
    FROM v o JOIN v w ON o.region = w.region AND o.category = w.category WHERE o.source = 'a' AND w.source = 'b'"""
)
def version_comparison(spark, sf_dir):
    """Two versions of a table of totals, column by column."""
    v = three_sources(spark, sf_dir).groupBy("region", "category", "source").agg(F.sum("n").alias("n"), F.count("*").alias("rows_published"))
    old, new = v.where("source = 'a'"), v.where("source = 'b'")
    return R.compare_versions(old, new, ["region", "category"], ["n", "rows_published"], ["n", "rows_published"])


@query(f"WITH {UNIT_MATRIX} SELECT *, CAST(p IS NOT NULL AS INT) AS has_p, CAST(g IS NOT NULL AS INT) AS has_g, CAST(s IS NOT NULL AS INT) AS has_s, p - g AS delta FROM matrix")
def section_matrix(spark, sf_dir):
    return A.presence(unit_matrix(spark, sf_dir), ["p", "g", "s"]).withColumn("delta", F.col("p") - F.col("g"))


def _pairs():
    return {
        "units": F.count("*"),
        "pairs": F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()),
        "unequal": F.count_if(F.col("p") != F.col("g")),
        "p_over_g": F.count_if(F.col("p") > F.col("g")),
        "excess": A.sum_where(F.col("p") > F.col("g"), F.col("p") - F.col("g")),
        "p_without_g": F.count_if(F.col("p").isNotNull() & F.col("g").isNull()),
        "p_without_g_n": A.sum_where(F.col("p").isNotNull() & F.col("g").isNull(), F.col("p")),
        "s_is_double": F.count_if(F.col("s") == 2 * F.col("g")),
        "s_is_not_double": F.count_if(F.col("s") != 2 * F.col("g")),
        "signed": F.coalesce(F.sum(F.col("s") - 2 * F.col("g")), F.lit(0)),
    }


@query(
    f"""WITH {UNIT_MATRIX} SELECT CASE WHEN grouping(region) = 0 THEN 1 ELSE 0 END AS level, region, count(*) AS units,
    count(*) FILTER (WHERE p IS NOT NULL AND g IS NOT NULL) AS pairs, count(*) FILTER (WHERE p <> g) AS unequal, count(*) FILTER (WHERE p > g) AS p_over_g,
    CAST(coalesce(sum(p - g) FILTER (WHERE p > g), 0) AS BIGINT) AS excess, count(*) FILTER (WHERE p IS NOT NULL AND g IS NULL) AS p_without_g,
    CAST(coalesce(sum(p) FILTER (WHERE p IS NOT NULL AND g IS NULL), 0) AS BIGINT) AS p_without_g_n, count(*) FILTER (WHERE s = 2 * g) AS s_is_double,
    count(*) FILTER (WHERE s <> 2 * g) AS s_is_not_double, CAST(coalesce(sum(s - 2 * g), 0) AS BIGINT) AS signed FROM matrix GROUP BY GROUPING SETS ((), (region))"""
)
def pair_invariants(spark, sf_dir):
    """Counters of expected relations between offices, with signed sums."""
    return A.levels(unit_matrix(spark, sf_dir), [[], ["region"]], _pairs())


_BANDS = [1, 2, 5, 10, 20, 50, 100]
_BAND_SQL = """CASE WHEN d <= 1 THEN '1' WHEN d <= 2 THEN '2' WHEN d <= 5 THEN '3-5' WHEN d <= 10 THEN '6-10' WHEN d <= 20 THEN '11-20'
    WHEN d <= 50 THEN '21-50' WHEN d <= 100 THEN '51-100' ELSE '101+' END"""


@query(f"WITH {UNIT_MATRIX}, d AS (SELECT abs(p - g) AS d FROM matrix WHERE p <> g) SELECT {_BAND_SQL} AS band, count(*) AS n, CAST(sum(d) AS BIGINT) AS total FROM d GROUP BY 1")
def delta_bands(spark, sf_dir):
    """Histogram of the absolute difference of two totals in bands."""
    d = F.abs(F.col("p") - F.col("g"))
    return unit_matrix(spark, sf_dir).where(d > 0).groupBy(A.band(d, _BANDS).alias("band")).agg(F.count("*").alias("n"), F.sum(d).alias("total"))


@query(f"WITH {UNIT_MATRIX} SELECT region, area, zone, unit, p, g, p - g AS delta FROM matrix WHERE p <> g ORDER BY abs(p - g) DESC, region, unit LIMIT 50")
def top_abs_delta(spark, sf_dir):
    """The 50 largest differences, in a total order."""
    m = unit_matrix(spark, sf_dir).where("p <> g").select("region", "area", "zone", "unit", "p", "g", (F.col("p") - F.col("g")).alias("delta"))
    return m.orderBy(F.abs("delta").desc(), "region", "unit").limit(50)


@query(
    f"""WITH {UNIT_MATRIX} SELECT CASE WHEN grouping(area) = 0 THEN 2 WHEN grouping(region) = 0 THEN 1 ELSE 0 END AS level, region, area, count(*) AS units,
    CAST(sum(p) AS BIGINT) AS p, CAST(sum(g) AS BIGINT) AS g, CAST(sum(s) AS BIGINT) AS s, count(DISTINCT zone) AS zones FROM matrix GROUP BY GROUPING SETS ((), (region), (region, area))"""
)
def multi_level_totals(spark, sf_dir):
    """Totals and distinct zones at three levels."""
    m = {"units": F.count("*"), "p": F.sum("p"), "g": F.sum("g"), "s": F.sum("s"), "zones": F.count_distinct("zone")}
    return A.levels(unit_matrix(spark, sf_dir), [[], ["region"], ["region", "area"]], m)


@query(
    f"""WITH {COUNTED}, t AS (SELECT region, category, sum(n) AS total FROM counted WHERE l_partkey % 61 <> 0 GROUP BY 1, 2),
    c AS (SELECT region, category, sum(n) AS children, count(DISTINCT area * 1000 + zone) AS n_children FROM counted GROUP BY 1, 2)
    SELECT region, category, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(children, 0) AS BIGINT) AS children, coalesce(n_children, 0) AS n_children,
    CAST(coalesce(total, 0) - coalesce(children, 0) AS BIGINT) AS difference FROM t FULL OUTER JOIN c USING (region, category)"""
)
def hierarchy_closure(spark, sf_dir):
    """Totals of a region against the sum of its zones."""
    rows = counted(spark, sf_dir)
    totals = rows.where("l_partkey % 61 <> 0").groupBy("region", "category").agg(F.sum("n").alias("total"))
    return A.closure(rows, ["region", "category"], ["region", "category", "area", "zone"], totals)


_SHARES = f"""{COUNTED}, u AS (SELECT region, area, zone, unit, category, sum(n) AS n FROM counted GROUP BY ALL),
    w AS (SELECT *, sum(n) OVER (PARTITION BY region, area, zone, unit) AS valid, count(*) OVER (PARTITION BY region, area, zone, unit) AS kinds FROM u)"""


def unit_shares(spark, sf_dir):
    """Counts of a category in a unit with the unit's valid total."""
    from pyspark.sql import Window

    unit = ["region", "area", "zone", "unit"]
    sums = counted(spark, sf_dir).groupBy(*unit, "category").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*unit)
    return sums.withColumn("valid", F.sum("n").over(w)).withColumn("kinds", F.count("*").over(w))


@query(
    f"""WITH {_SHARES} SELECT category, CAST(least(9, 10 * n // valid) AS INT) AS bin_x, CAST(least(9, 10 * valid // 300) AS INT) AS bin_y, count(*) AS n
    FROM w GROUP BY 1, 2, 3"""
)
def candidate_share_hist2d(spark, sf_dir):
    """Units by tenth of a category's share and of their size."""
    x = F.least(F.lit(9), F.expr("10 * n div valid")).cast("int")
    y = F.least(F.lit(9), F.expr("10 * valid div 300")).cast("int")
    return unit_shares(spark, sf_dir).groupBy("category", x.alias("bin_x"), y.alias("bin_y")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {COUNTED}, t AS (SELECT region, zone, category, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY ALL)
    SELECT region, zone, category, n, row_number() OVER (PARTITION BY region, zone ORDER BY n DESC, category) AS rank FROM t
    QUALIFY rank <= 2"""
)
def top_k_by_unit(spark, sf_dir):
    """The two leading categories of each zone; ties by category."""
    sums = counted(spark, sf_dir).groupBy("region", "zone", "category").agg(F.sum("n").alias("n"))
    return A.top_k(sums, ["region", "zone"], [F.desc("n"), F.asc("category")], 2)


@query(
    f"""WITH {_SHARES}, t AS (SELECT region, area, zone, unit, CAST(any_value(valid) AS BIGINT) AS valid, any_value(kinds) AS kinds, CAST(sum(n) FILTER (WHERE category = 'RF') AS BIGINT) AS rf, CAST(max(n) AS BIGINT) AS top FROM w GROUP BY ALL)
    SELECT region, unit, 'ONE_CATEGORY' AS rule FROM t WHERE kinds = 1 UNION ALL SELECT region, unit, 'OVER_CAPACITY' FROM t WHERE valid > 200
    UNION ALL SELECT region, unit, 'MISSING_CATEGORY' FROM t WHERE rf IS NULL UNION ALL SELECT region, unit, 'DOMINATED' FROM t WHERE kinds > 1 AND 10 * top > 9 * valid"""
)
def rule_violations(spark, sf_dir):
    """Consistency rules of a unit; every broken one is a row."""
    units = unit_shares(spark, sf_dir).groupBy("region", "area", "zone", "unit").agg(F.first("valid").alias("valid"), F.first("kinds").alias("kinds"), F.sum(F.when(F.col("category") == "RF", F.col("n"))).alias("rf"), F.max("n").alias("top"))
    rules = {"ONE_CATEGORY": F.col("kinds") == 1, "OVER_CAPACITY": F.col("valid") > 200, "MISSING_CATEGORY": F.col("rf").isNull(), "DOMINATED": (F.col("kinds") > 1) & (10 * F.col("top") > 9 * F.col("valid"))}
    return A.violations(units, ["region", "unit"], rules)


@query(
    f"""WITH {UNIT_MATRIX} SELECT region, unit, CASE WHEN p IS NULL THEN 'NO_P' WHEN g IS NULL THEN 'NO_G' WHEN p > g THEN 'P_LEADS' WHEN g > p THEN 'G_LEADS' ELSE 'TIE' END AS label,
    CASE WHEN s IS NULL THEN 'UNKNOWN' WHEN s > 0 THEN 'REGISTERED' ELSE 'ZERO' END AS s_status FROM matrix"""
)
def unit_labels(spark, sf_dir):
    """Leader with ties, and presence: a missing field is never a zero."""
    p, g, s = F.col("p"), F.col("g"), F.col("s")
    label = F.when(p.isNull(), "NO_P").when(g.isNull(), "NO_G").when(p > g, "P_LEADS").when(g > p, "G_LEADS").otherwise("TIE")
    status = F.when(s.isNull(), "UNKNOWN").when(s > 0, "REGISTERED").otherwise("ZERO")
    return unit_matrix(spark, sf_dir).select("region", "unit", label.alias("label"), status.alias("s_status"))


@query(
    f"""WITH {COUNTED}, t AS (SELECT region, zone, category, sum(n) AS n FROM counted GROUP BY ALL), x(zone, label) AS (VALUES (7, 'special'), (11, 'special')),
    y(category, label) AS (VALUES ('AF', 'left'), ('RF', 'right'), ('NO', 'centre')) SELECT region, coalesce(x.label, y.label, 'other') AS label, CAST(sum(n) AS BIGINT) AS n, count(*) AS groups
    FROM t LEFT JOIN x USING (zone) LEFT JOIN y USING (category) GROUP BY 1, 2"""
)
def classified_totals(spark, sf_dir):
    """Labels from exceptions, then from a group table, then a default."""
    sums = counted(spark, sf_dir).groupBy("region", "zone", "category").agg(F.sum("n").alias("n"))
    special = spark.createDataFrame([(7, "special"), (11, "special")], "zone long, label string")
    groups = spark.createDataFrame([("AF", "left"), ("RF", "right"), ("NO", "centre")], "category string, label string")
    out = A.classify(sums, "zone", [("zone", special), ("category", groups)], "other")
    return out.groupBy("region", "label").agg(F.sum("n").alias("n"), F.count("*").alias("groups"))


@query(
    f"""WITH {COUNTED}, t AS (SELECT region, sum(n) AS n, count(*) AS lines FROM counted GROUP BY 1)
    SELECT region, CAST((SELECT sum(n) FROM t) - n AS BIGINT) AS n, CAST((SELECT sum(lines) FROM t) - lines AS BIGINT) AS lines FROM t"""
)
def leave_one_region_out(spark, sf_dir):
    """Totals without each region, from one scan."""
    return A.leave_one_out(counted(spark, sf_dir).select("region", "n", F.lit(1).alias("lines")), ["region"], ["n", "lines"])


@query(
    f"""WITH {COUNTED}, nr AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), t AS (
    SELECT region, sum(n) AS n, sum(n) FILTER (WHERE category = 'RF') AS rf FROM counted GROUP BY 1)
    SELECT r_name AS macro, count(*) AS regions, CAST(sum(n) AS BIGINT) AS n, round(100.0::DOUBLE * sum(rf)::DOUBLE / sum(n)::DOUBLE, 6) AS share FROM t JOIN nr ON n_name = t.region GROUP BY 1"""
)
def macro_regions(spark, sf_dir):
    """Regions gathered to larger ones, shares weighted by volume."""
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("region"), F.col("r_name").alias("macro"))
    sums = counted(spark, sf_dir).groupBy("region").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("category") == "RF", F.col("n"))).alias("rf"))
    share = F.round(F.lit(100.0) * F.sum("rf").cast("double") / F.sum("n").cast("double"), 6)
    return sums.join(names, "region").groupBy("macro").agg(F.count("*").alias("regions"), F.sum("n").alias("n"), share.alias("share"))


@query(
    f"""WITH {COUNTED}, s AS (SELECT region, area, zone, unit, contest, sum(n) AS n FROM counted WHERE l_partkey % 50 <> 0 GROUP BY ALL),
    c AS (SELECT zone, contest, count(DISTINCT unit) AS known, min(region) AS region FROM counted WHERE unit % 3 <> 0 GROUP BY 1, 2)
    SELECT s.region, s.unit, s.contest, CAST(s.n AS BIGINT) AS n, CASE WHEN c.known IS NULL THEN 'UNMATCHED' ELSE 'MATCHED' END AS match
    FROM s LEFT JOIN c USING (zone, contest)"""
)
def section_lookup(spark, sf_dir):
    """Units looked up in a reference by zone and contest, with a status."""
    rows = counted(spark, sf_dir)
    units = rows.where("l_partkey % 50 <> 0").groupBy(*UNIT).agg(F.sum("n").alias("n"))
    reference = rows.where("unit % 3 <> 0").groupBy("zone", "contest").agg(F.count_distinct("unit").alias("known"))
    return R.lookup(units, reference, ["zone", "contest"], "known").select("region", "unit", "contest", "n", "match")
