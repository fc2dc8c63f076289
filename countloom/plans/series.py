"""Queries over the hourly series and arrival buckets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from countloom.operators import series as S
from countloom.operators.asof import first_reaching
from countloom.plans.registry import query
from countloom.sources.driver import COUNTED, FEED, SNAPSHOTS, counted, feed, snapshots

_DELTAS = f"""{SNAPSHOTS}, deltas AS (
  SELECT *, units - lag(units) OVER w AS d_units, total - lag(total) OVER w AS d_total, a - lag(a) OVER w AS d_a, b - lag(b) OVER w AS d_b,
    (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0::DOUBLE AS seconds FROM snapshots WINDOW w AS (ORDER BY ts))"""


def _deltas(spark, sf_dir):
    return S.deltas(snapshots(spark, sf_dir), "ts", ["units", "total", "a", "b"])


@query(f"WITH {_DELTAS} SELECT ts, d_units, d_total, d_a, seconds, round(100.0::DOUBLE * d_a / nullif(d_total, 0), 6) AS share, round(100.0::DOUBLE * a / nullif(total, 0), 6) AS cum_share FROM deltas")
def batch_deltas(spark, sf_dir):
    """Batches of a cumulative series, their share and the share so far."""
    share = lambda x, n: F.round(F.try_divide(F.lit(100.0) * F.col(x), F.col(n)), 6)
    return _deltas(spark, sf_dir).select("ts", "d_units", "d_total", "d_a", "seconds", share("d_a", "d_total").alias("share"), share("a", "total").alias("cum_share"))


_RESIDUALS = f"""{_DELTAS}, residuals AS (SELECT ts, d_a AS v, median(d_a) OVER w AS median, d_a - median(d_a) OVER w AS residual FROM deltas WHERE d_a IS NOT NULL
  WINDOW w AS (ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))"""


def residuals(spark, sf_dir):
    v = _deltas(spark, sf_dir).where("d_a is not null").select("ts", F.col("d_a").alias("v"))
    return S.moving_median(v, "ts", "v", 7)


@query(f"WITH {_RESIDUALS} SELECT * FROM residuals")
def moving_median_residual(spark, sf_dir):
    """Residuals of the centred moving median over 15 batches."""
    return residuals(spark, sf_dir)


@query(
    f"""WITH {_RESIDUALS}, m AS (SELECT ts, residual, least(max(residual) OVER (ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), max(residual) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) - residual AS prominence,
    lag(residual) OVER (ORDER BY ts) AS l, lead(residual) OVER (ORDER BY ts) AS r FROM residuals) SELECT ts, residual, prominence FROM m WHERE residual <= l AND residual < r AND prominence >= 100"""
)
def valleys(spark, sf_dir):
    """Local minima with a prominence over both sides."""
    return S.valleys(residuals(spark, sf_dir).select("ts", "residual"), "ts", "residual", 5, 100.0)


@query(
    f"""WITH {_DELTAS}, m AS (SELECT ts, coalesce(d_a >= d_b, false) AS ok FROM deltas), i AS (SELECT ts, ok, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS island FROM m),
    r AS (SELECT min(ts) AS "start", max(ts) AS "end", count(*) AS transitions FROM i WHERE ok GROUP BY island) SELECT * FROM r ORDER BY transitions DESC, "start" LIMIT 1"""
)
def longest_monotone_run(spark, sf_dir):
    """The longest stretch of batches in which one category does not lose ground to another."""
    return S.longest_run(_deltas(spark, sf_dir), "ts", F.col("d_a") >= F.col("d_b"))


@query(
    f"""WITH {_DELTAS} SELECT count(*) FILTER (WHERE d_total IS NOT NULL) AS batches, count(*) FILTER (WHERE d_total < 0) AS regressions, min(seconds) AS min_seconds, max(seconds) AS max_seconds,
    median(seconds) AS median_seconds, count(*) FILTER (WHERE seconds > 3600) AS gaps FROM deltas"""
)
def cadence(spark, sf_dir):
    """Regressions of a series that must not fall, and its rhythm."""
    return _deltas(spark, sf_dir).agg(
        F.count("d_total").alias("batches"), F.count_if(F.col("d_total") < 0).alias("regressions"), F.min("seconds").alias("min_seconds"), F.max("seconds").alias("max_seconds"), F.median("seconds").alias("median_seconds"), F.count_if(F.col("seconds") > 3600).alias("gaps")
    )


_BUCKETS = f"""{FEED}, buckets AS (SELECT date_trunc('%s', ts) AS bucket, count(*) AS events, sum(n) AS total FROM feed GROUP BY 1)
  SELECT bucket, events, CAST(total AS BIGINT) AS total, CAST(sum(events) OVER w AS BIGINT) AS cum_events, CAST(sum(total) OVER w AS BIGINT) AS cum_total FROM buckets WINDOW w AS (ORDER BY bucket ROWS UNBOUNDED PRECEDING)"""


def _arrivals(spark, sf_dir, unit):
    """Running totals within a day, then the days before: no window holds more than a day's buckets."""
    buckets = S.bucket(feed(spark, sf_dir), unit).withColumn("day", F.to_date("bucket"))
    inner = Window.partitionBy("day").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    days = buckets.groupBy("day").agg(F.sum("events").alias("e"), F.sum("total").alias("t"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("day", F.coalesce(F.sum("e").over(before), F.lit(0)).alias("e"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t"))
    out = buckets.withColumns({"ce": F.sum("events").over(inner), "ct": F.sum("total").over(inner)}).join(days, "day")
    return out.select("bucket", "events", "total", (F.col("ce") + F.col("e")).alias("cum_events"), (F.col("ct") + F.col("t")).alias("cum_total"))


@query("WITH " + _BUCKETS % "minute")
def arrivals_by_minute(spark, sf_dir):
    """Arrivals per minute with running totals."""
    return _arrivals(spark, sf_dir, "minute")


@query("WITH " + _BUCKETS % "second")
def arrivals_by_second(spark, sf_dir):
    """Arrivals per second with running totals."""
    return _arrivals(spark, sf_dir, "second")


CUTS = ["1995-01-01 00:00:00", "1996-06-15 00:00:00", "1997-01-01 00:00:00"]
_CUT_SQL = f"""{COUNTED}, cuts(cut) AS (VALUES {", ".join(f"('{c}')" for c in CUTS)}), z AS (
  SELECT region, zone, cut, CAST(sum(CASE WHEN received < CAST(cut AS TIMESTAMP) THEN n ELSE 0 END) AS BIGINT) AS pre_n,
    CAST(sum(CASE WHEN received < CAST(cut AS TIMESTAMP) AND category = 'RF' THEN n ELSE 0 END) AS BIGINT) AS pre_a, CAST(sum(n) AS BIGINT) AS all_n,
    CAST(sum(CASE WHEN category = 'RF' THEN n ELSE 0 END) AS BIGINT) AS all_a FROM counted, cuts GROUP BY 1, 2, 3), e AS (
  SELECT cut, all_n - pre_n AS post_n, 100.0::DOUBLE * (all_a - pre_a) / (all_n - pre_n) - 100.0::DOUBLE * pre_a / pre_n AS shift FROM z WHERE pre_n >= 100 AND all_n - pre_n >= 100)"""


@query(f"WITH {_CUT_SQL} SELECT cut, count(*) AS pairs, CAST(sum(post_n) AS BIGINT) AS post_n, round(sum(post_n * shift) / sum(post_n), 6) AS weighted_shift, round(median(shift), 6) AS median_shift FROM e GROUP BY 1")
def cut_placebos(spark, sf_dir):
    """The shift of a share at several cuts, in zones with enough on both sides."""
    n, a = F.col("n"), F.when(F.col("category") == "RF", F.col("n")).otherwise(0)
    z = S.cut_sums(counted(spark, sf_dir), ["region", "zone"], "received", CUTS, {"n": n, "a": a})
    post_n, post_a = F.col("all_n") - F.col("pre_n"), F.col("all_a") - F.col("pre_a")
    z = z.where((F.col("pre_n") >= 100) & (post_n >= 100)).select("cut", post_n.alias("post_n"), (F.lit(100.0) * post_a / post_n - F.lit(100.0) * F.col("pre_a") / F.col("pre_n")).alias("shift"))
    return z.groupBy("cut").agg(F.count("*").alias("pairs"), F.sum("post_n").alias("post_n"), F.round(F.sum(F.col("post_n") * F.col("shift")) / F.sum("post_n"), 6).alias("weighted_shift"), F.round(F.median("shift"), 6).alias("median_shift"))


@query(
    f"""WITH {COUNTED}, u AS (SELECT region, unit, max(received) AS done, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE category = 'RF'), 0) AS BIGINT) AS a FROM counted GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY done, unit) AS k, count(*) OVER (PARTITION BY region) AS m FROM u),
    q AS (SELECT *, CASE WHEN k <= greatest(1, m // 4) THEN 'EARLY' WHEN k > m - greatest(1, m // 4) THEN 'LATE' END AS quarter FROM k),
    g AS (SELECT region, count(*) FILTER (WHERE quarter = 'EARLY') AS units, 100.0::DOUBLE * sum(a) FILTER (WHERE quarter = 'EARLY')::DOUBLE / sum(n) FILTER (WHERE quarter = 'EARLY')::DOUBLE AS early,
    100.0::DOUBLE * sum(a) FILTER (WHERE quarter = 'LATE')::DOUBLE / sum(n) FILTER (WHERE quarter = 'LATE')::DOUBLE AS late FROM q GROUP BY 1)
    SELECT region, units, round(early, 6) AS early, round(late, 6) AS late, round(late - early, 6) AS gradient FROM g"""
)
def quartile_gradient(spark, sf_dir):
    """A share in the first and the last quarter of a region's units by completion."""
    u = counted(spark, sf_dir).groupBy("region", "unit").agg(F.max("received").alias("done"), F.sum("n").alias("n"), F.sum(F.when(F.col("category") == "RF", F.col("n")).otherwise(0)).alias("a"))
    q = S.end_quarters(u, ["region"], [F.col("done"), F.col("unit")])
    share = lambda s: F.lit(100.0) * F.sum(F.when(F.col("quarter") == s, F.col("a"))) / F.sum(F.when(F.col("quarter") == s, F.col("n")))
    g = q.groupBy("region").agg(F.count_if(F.col("quarter") == "EARLY").alias("units"), share("EARLY").alias("early"), share("LATE").alias("late"))
    return g.select("region", "units", F.round("early", 6).alias("early"), F.round("late", 6).alias("late"), F.round(F.col("late") - F.col("early"), 6).alias("gradient"))


@query(
    f"""WITH {_DELTAS}, d AS (SELECT ts, d_total, d_a, row_number() OVER (ORDER BY 1.0::DOUBLE * d_a / d_total DESC, ts) AS place FROM deltas WHERE d_total > 0)
    SELECT ts, place, CAST(sum(d_total) OVER w AS BIGINT) AS cum_n, CAST(sum(d_a) OVER w AS BIGINT) AS cum_x FROM d WINDOW w AS (ORDER BY place ROWS UNBOUNDED PRECEDING)"""
)
def adverse_order(spark, sf_dir):
    """The order of batches that favours one category most."""
    d = _deltas(spark, sf_dir).where("d_total > 0").select("ts", "d_total", "d_a")
    out = S.adverse_order(d, F.col("d_a").cast("double") / F.col("d_total"), "d_total", "d_a", ["ts"])
    return out.select("ts", "place", "cum_n", "cum_x")


_TARGET = 20_000


@query(
    f"""WITH {_DELTAS}, s AS (SELECT ts, total - d_total AS before FROM deltas WHERE d_total > 0), e AS (
    SELECT s.ts AS "start", min(d.ts) AS "end", any_value(s.before) AS before FROM s JOIN deltas d ON d.total >= s.before + {_TARGET * 8 // 10} GROUP BY 1),
    m AS (SELECT "start", "end", d.total - before AS volume, d.a FROM e JOIN deltas d ON d.ts = e."end")
    SELECT "start", "end", CAST(volume AS BIGINT) AS volume, round(100.0::DOUBLE * cume_dist() OVER (ORDER BY volume), 6) AS percent FROM m WHERE volume <= {_TARGET * 12 // 10}"""
)
def matched_windows(spark, sf_dir):
    """From each batch the first end with 80 % of a target volume, kept up to 120 % of it."""
    d = _deltas(spark, sf_dir)
    starts = d.where("d_total > 0").select(F.col("ts").alias("start"), (F.col("total") - F.col("d_total")).alias("before"), (F.col("total") - F.col("d_total") + _TARGET * 8 // 10).alias("level"))
    ends = first_reaching(starts, d, "level", "total", "ts", "end").where("end is not null")
    out = ends.join(d.select(F.col("ts").alias("end"), "total"), "end").withColumn("volume", F.col("total") - F.col("before")).where(F.col("volume") <= _TARGET * 12 // 10)
    return out.select("start", "end", "volume", F.round(S.percent_at_most("volume"), 6).alias("percent"))


@query()
def tie_atomic_blocks(spark, sf_dir):
    """Whole seconds packed to blocks of 50 events or more, per category; sequential, so tested by brute force."""
    seconds = S.bucket(feed(spark, sf_dir), "second", by=["category"])
    return S.pack_ties(seconds, "category", "bucket", "events", ["total"], 50)
