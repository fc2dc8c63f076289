"""Queries: hold-out shares, shrunken rates, a geography-only curve, early-train forecasts and what remains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from countloom.functions.scalars import hash_fold
from countloom.operators import aggregates as A
from countloom.operators import forecast as P
from countloom.plans.registry import query
from countloom.plans.series import _DELTAS, _deltas
from countloom.sources.driver import COUNTED, counted

_UNITS = f"{COUNTED}, units AS (SELECT region, zone, unit, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE category = 'RF'), 0) AS BIGINT) AS x FROM counted GROUP BY 1, 2, 3)"


def _units(spark, sf_dir):
    return counted(spark, sf_dir).groupBy("region", "zone", "unit").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("category") == "RF", F.col("n")).otherwise(0)).alias("x"))


@query(
    f"""WITH {_UNITS}, f AS (SELECT *, ('0x' || substr(sha256(region || '|' || CAST(unit AS VARCHAR)), 1, 2))::INT % 5 = 0 AS test FROM units),
    r0 AS (SELECT sum(x) AS x, sum(n) AS n FROM f WHERE NOT test), r1 AS (SELECT region, sum(x) AS x, sum(n) AS n FROM f WHERE NOT test GROUP BY 1), r2 AS (SELECT region, zone, sum(x) AS x, sum(n) AS n FROM f WHERE NOT test GROUP BY 1, 2),
    p AS (SELECT f.x, f.n, r0.x AS x0, r0.n AS n0, coalesce(r1.x, r0.x) AS x1, coalesce(r1.n, r0.n) AS n1, coalesce(r2.x, r1.x, r0.x) AS x2, coalesce(r2.n, r1.n, r0.n) AS n2 FROM f, r0 LEFT JOIN r1 ON r1.region = f.region LEFT JOIN r2 ON r2.region = f.region AND r2.zone = f.zone WHERE f.test),
    q AS (SELECT 'all' AS model, x, greatest(0, least(n, (2 * x0 * n + n0) // (2 * n0))) AS y FROM p UNION ALL SELECT 'region', x, greatest(0, least(n, (2 * x1 * n + n1) // (2 * n1))) FROM p
    UNION ALL SELECT 'region_zone', x, greatest(0, least(n, (2 * x2 * n + n2) // (2 * n2))) FROM p)
    SELECT model, count(*) AS n, count(*) FILTER (WHERE x = y) AS exact, count(*) FILTER (WHERE abs(x - y) <= 1) AS within1, round(sum(abs(x - y))::DOUBLE / count(*), 6) AS mae, round(sqrt(sum((x - y) * (x - y))::DOUBLE / count(*)), 6) AS rmse FROM q GROUP BY 1"""
)
def holdout_fixed_share(spark, sf_dir):
    """Units held out by hash, predicted from shares of three levels."""
    out = P.fixed_share(_units(spark, sf_dir), hash_fold(5, "region", "unit") == 0, [[], ["region"], ["region", "zone"]])
    e = F.col("x") - F.col("predicted")
    return out.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(e == 0).alias("exact"), F.count_if(F.abs(e) <= 1).alias("within1"), F.round(F.sum(F.abs(e)) / F.count("*"), 6).alias("mae"), F.round(F.sqrt(F.sum(e * e) / F.count("*")), 6).alias("rmse")
    )


_CUT = "1996-06-15 00:00:00"
_SPLIT = f"""{COUNTED}, pre AS (SELECT * FROM counted WHERE received < TIMESTAMP '{_CUT}' AND (region <> 'NATION_3' OR zone % 7 <> 0)), post AS (SELECT region, zone, sum(n) AS n, coalesce(sum(n) FILTER (WHERE category = 'RF'), 0) AS x FROM counted WHERE received >= TIMESTAMP '{_CUT}' GROUP BY 1, 2),
  r0 AS (SELECT sum(n) FILTER (WHERE category = 'RF')::DOUBLE / sum(n) AS rate FROM pre),
  r1 AS (SELECT region, (coalesce(sum(n) FILTER (WHERE category = 'RF'), 0) + 1000.0::DOUBLE * any_value(rate)) / (sum(n) + 1000.0::DOUBLE) AS rate FROM pre, r0 GROUP BY 1),
  r2 AS (SELECT pre.region, zone, (coalesce(sum(n) FILTER (WHERE category = 'RF'), 0) + 1000.0::DOUBLE * any_value(rate)) / (sum(n) + 1000.0::DOUBLE) AS rate FROM pre JOIN r1 ON r1.region = pre.region GROUP BY 1, 2),
  f AS (SELECT post.*, r0.rate AS rate0, coalesce(r1.rate, r0.rate) AS rate1, coalesce(r2.rate, r1.rate, r0.rate) AS rate2, CASE WHEN r1.rate IS NULL THEN 'no_history_region' WHEN r2.rate IS NULL THEN 'no_history_zone' ELSE 'comparable' END AS category
    FROM post, r0 LEFT JOIN r1 ON r1.region = post.region LEFT JOIN r2 ON r2.region = post.region AND r2.zone = post.zone)"""


@query(
    f"""WITH {_SPLIT} SELECT category, count(*) AS places, CAST(sum(n) AS BIGINT) AS n, CAST(sum(x) AS BIGINT) AS actual, round(sum(n * rate0)::DOUBLE, 4) AS by_all, round(sum(n * rate1)::DOUBLE, 4) AS by_region, round(sum(n * rate2)::DOUBLE, 4) AS by_zone,
    round(sum(abs(x - n * rate2)) / count(*), 4) AS mae, round(sqrt(sum(n * (x / n - rate2) * (x / n - rate2)) / sum(n)), 6) AS rmse FROM f GROUP BY 1"""
)
def shrinkage_forecast(spark, sf_dir):
    """Later counts of zones from rates of what came before, shrunken level by level."""
    rows = counted(spark, sf_dir).withColumn("x", F.when(F.col("category") == "RF", F.col("n")).otherwise(0))
    cut = F.lit(_CUT).cast("timestamp_ntz")
    pre = rows.where((F.col("received") < cut) & ((F.col("region") != "NATION_3") | (F.col("zone") % 7 != 0)))
    levels = [[], ["region"], ["region", "zone"]]
    post = rows.where(F.col("received") >= cut).groupBy("region", "zone").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    f = P.with_rates(post, P.shrunk_rates(pre, levels, "n", "x"), levels)
    by = lambda k: F.round(F.sum(F.col("n") * F.col(f"rate{k}")), 4)
    e = F.col("x") / F.col("n") - F.col("rate2")
    return f.groupBy("category").agg(
        F.count("*").alias("places"), F.sum("n").alias("n"), F.sum("x").alias("actual"), by(0).alias("by_all"), by(1).alias("by_region"), by(2).alias("by_zone"),
        F.round(F.sum(F.abs(F.col("x") - F.col("n") * F.col("rate2"))) / F.count("*"), 4).alias("mae"), F.round(A.weighted_errors(e, F.col("n"))["rmse"], 6).alias("rmse"),
    )


@query(
    f"""WITH {COUNTED}, r AS (SELECT region, zone, sum(n) FILTER (WHERE category = 'RF')::DOUBLE / sum(n) AS rate FROM counted GROUP BY 1, 2),
    m AS (SELECT date_trunc('month', received) AS ts, region, zone, sum(n) AS n, coalesce(sum(n) FILTER (WHERE category = 'RF'), 0) AS x FROM counted GROUP BY 1, 2, 3),
    t AS (SELECT ts, sum(m.n) AS n, sum(x) AS x, sum(m.n * coalesce(rate, 0)) AS y FROM m JOIN r ON m.region = r.region AND m.zone = r.zone GROUP BY 1)
    SELECT ts, CAST(sum(n) OVER w AS BIGINT) AS n, round(100.0::DOUBLE * (sum(x) OVER w)::DOUBLE / (sum(n) OVER w)::DOUBLE, 6) AS observed, round(100.0::DOUBLE * sum(y) OVER w / (sum(n) OVER w)::DOUBLE, 6) AS by_place FROM t WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)"""
)
def geo_counterfactual(spark, sf_dir):
    """The curve that only the order of places would give, beside the observed one."""
    rows = counted(spark, sf_dir).withColumn("x", F.when(F.col("category") == "RF", F.col("n")).otherwise(0))
    m = rows.groupBy(F.date_trunc("month", "received").cast("timestamp_ntz").alias("ts"), "region", "zone").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    rate = m.groupBy("region", "zone").agg((F.sum("x") / F.sum("n")).alias("rate"))
    t = m.join(rate, ["region", "zone"]).groupBy("ts").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum(F.col("n") * F.col("rate")).alias("y"))
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)  # a row per month
    run = lambda c: F.sum(c).over(w)
    return t.select("ts", run("n").alias("n"), F.round(F.lit(100.0) * run("x") / run("n"), 6).alias("observed"), F.round(F.lit(100.0) * run("y") / run("n"), 6).alias("by_place"))


@query(
    f"""WITH {_DELTAS}, d AS (SELECT ts, d_total, d_a, row_number() OVER (ORDER BY ts) AS k, count(*) OVER () AS m FROM deltas WHERE d_total > 0),
    s AS (SELECT sum(d_a) FILTER (WHERE k <= m // 2) AS train_a, sum(d_total) FILTER (WHERE k <= m // 2) AS train_n, sum(d_total) FILTER (WHERE k > m // 2) AS later_n, sum(d_a) AS a, sum(d_total) AS n FROM d)
    SELECT CAST(train_n AS BIGINT) AS train_n, CAST(later_n AS BIGINT) AS later_n, round(100.0::DOUBLE * train_a::DOUBLE / train_n::DOUBLE, 6) AS train_share, round(100.0::DOUBLE * (train_a + later_n * (train_a::DOUBLE / train_n::DOUBLE)) / n::DOUBLE, 6) AS forecast,
    round(100.0::DOUBLE * a::DOUBLE / n::DOUBLE, 6) AS final_share FROM s"""
)
def early_forecast(spark, sf_dir):
    """The final share from the first half of the batches."""
    d = _deltas(spark, sf_dir).where("d_total > 0").select("ts", "d_total", "d_a")
    whole = Window.partitionBy()  # a row per batch
    d = d.withColumn("k", F.row_number().over(Window.orderBy("ts"))).withColumn("m", F.count("*").over(whole))
    early = F.col("k") <= F.expr("m div 2")
    s = d.agg(F.sum(F.when(early, F.col("d_a"))).alias("ta"), F.sum(F.when(early, F.col("d_total"))).alias("tn"), F.sum(F.when(~early, F.col("d_total"))).alias("ln"), F.sum("d_a").alias("a"), F.sum("d_total").alias("n"))
    share = F.col("ta") / F.col("tn")
    return s.select(F.col("tn").alias("train_n"), F.col("ln").alias("later_n"), F.round(F.lit(100.0) * F.col("ta") / F.col("tn"), 6).alias("train_share"), F.round(F.lit(100.0) * (F.col("ta") + F.col("ln") * share) / F.col("n"), 6).alias("forecast"), F.round(F.lit(100.0) * F.col("a") / F.col("n"), 6).alias("final_share"))


@query(
    f"""WITH {_DELTAS}, d AS (SELECT ts, d_total, d_a, a - d_a AS before_a, total - d_total AS before_n FROM deltas WHERE d_total > 0)
    SELECT ts, round(100.0::DOUBLE * d_a / d_total - 100.0::DOUBLE * before_a / before_n, 6) AS change_pp, round(d_total * (1.0::DOUBLE * before_a / before_n), 4) AS expected, d_a AS observed FROM d WHERE before_n > 0"""
)
def batch_composition(spark, sf_dir):
    """Each batch's share against what had been counted before it."""
    d = _deltas(spark, sf_dir).where("d_total > 0").withColumn("ba", F.col("a") - F.col("d_a")).withColumn("bn", F.col("total") - F.col("d_total")).where("bn > 0")
    change = F.lit(100.0) * F.col("d_a") / F.col("d_total") - F.lit(100.0) * F.col("ba") / F.col("bn")
    return d.select("ts", F.round(change, 6).alias("change_pp"), F.round(F.col("d_total") * (F.col("ba") / F.col("bn")), 4).alias("expected"), F.col("d_a").alias("observed"))


@query(
    f"""WITH {COUNTED}, t AS (SELECT region, sum(n) AS n, sum(n) FILTER (WHERE received < TIMESTAMP '{_CUT}') AS seen, coalesce(sum(n) FILTER (WHERE category = 'RF'), 0) AS a, coalesce(sum(n) FILTER (WHERE category = 'RF' AND received < TIMESTAMP '{_CUT}'), 0) AS seen_a FROM counted GROUP BY 1),
    p AS (SELECT *, n - seen AS left_n, a - seen_a AS left_a, CASE WHEN 4 * seen_a > seen THEN 'ABOVE' WHEN 4 * seen_a < seen THEN 'BELOW' ELSE 'TIE' END AS leader FROM t)
    SELECT leader, count(*) AS regions, CAST(sum(left_n) AS BIGINT) AS left_n, CAST(sum(left_a) AS BIGINT) AS left_a, round(sum(left_n * (seen_a::DOUBLE / seen)), 4) AS projected, round(avg(100.0::DOUBLE * left_a / left_n - 100.0::DOUBLE * seen_a / seen), 6) AS mean_change, round(median(100.0::DOUBLE * left_a / left_n - 100.0::DOUBLE * seen_a / seen), 6) AS median_change
    FROM p GROUP BY 1"""
)
def remaining_by_leader(spark, sf_dir):
    """What came after a cut by who led before it, and a projection's error."""
    a = F.when(F.col("category") == "RF", F.col("n")).otherwise(0)
    before = F.col("received") < F.lit(_CUT).cast("timestamp_ntz")
    t = counted(spark, sf_dir).groupBy("region").agg(F.sum("n").alias("n"), F.sum(F.when(before, F.col("n"))).alias("seen"), F.sum(a).alias("a"), F.sum(F.when(before, a).otherwise(0)).alias("seen_a"))
    leader = F.when(4 * F.col("seen_a") > F.col("seen"), "ABOVE").when(4 * F.col("seen_a") < F.col("seen"), "BELOW").otherwise("TIE")
    p = t.select(leader.alias("leader"), (F.col("n") - F.col("seen")).alias("left_n"), (F.col("a") - F.col("seen_a")).alias("left_a"), (F.col("seen_a") / F.col("seen")).alias("rate"), (F.lit(100.0) * F.col("seen_a") / F.col("seen")).alias("share"))
    change = F.lit(100.0) * F.col("left_a") / F.col("left_n") - F.col("share")
    return p.groupBy("leader").agg(F.count("*").alias("regions"), F.sum("left_n").alias("left_n"), F.sum("left_a").alias("left_a"), F.round(F.sum(F.col("left_n") * F.col("rate")), 4).alias("projected"), F.round(F.avg(change), 6).alias("mean_change"), F.round(F.median(change), 6).alias("median_change"))
