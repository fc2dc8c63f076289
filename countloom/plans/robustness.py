"""Queries: verdicts of digit tests, robustness of coefficients, periodicity as a whole, published curves and matched windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from countloom.operators import series as S
from countloom.operators import stats as M
from countloom.operators.asof import first_reaching
from countloom.plans.registry import query
from countloom.plans.series import _DELTAS, _deltas
from countloom.plans.statistics import _PAIR, _pair_moments
from countloom.sources.driver import COUNTED, FEED, counted, feed


def _r(name: str, places: int = 6, alias: str | None = None):
    return F.round(name, places).alias(alias or name)


@query(
    f"""WITH {COUNTED}, t AS (SELECT region, unit, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY 1, 2),
    v AS (SELECT region, 'first' AS test, n, CAST(substr(CAST(n AS VARCHAR), 1, 1) AS INT) AS digit FROM t WHERE n >= 1 UNION ALL
      SELECT region, 'second', n, CAST(substr(CAST(n AS VARCHAR), 2, 1) AS INT) FROM t WHERE n >= 10 UNION ALL SELECT region, 'last', n, CAST(n % 10 AS INT) FROM t WHERE n >= 30),
    e AS (SELECT 'first' AS test, CAST(d AS INT) AS digit, log10(1 + 1.0::DOUBLE / d) AS p FROM range(1, 10) AS r(d) UNION ALL
      SELECT 'second', CAST(d AS INT), (SELECT sum(log10(1 + 1.0::DOUBLE / (10 * k + d))) FROM range(1, 10) AS s(k)) FROM range(10) AS r(d) UNION ALL SELECT 'last', CAST(d AS INT), 0.1::DOUBLE FROM range(10) AS r(d)),
    g AS (SELECT region, test, count(*) AS observations, count(DISTINCT n) AS distinct_values, max(n)::DOUBLE / min(n) AS span FROM v GROUP BY 1, 2),
    c AS (SELECT g.region, g.test, g.observations AS m, e.digit, e.p, count(v.digit) AS k FROM g JOIN e ON g.test = e.test LEFT JOIN v ON v.region = g.region AND v.test = g.test AND v.digit = e.digit GROUP BY ALL),
    s AS (SELECT region, test, sum(pow(k - m * p, 2) / (m * p)) AS chi2, avg(abs(k::DOUBLE / m - p)) AS mad, 100.0::DOUBLE * sum(k) FILTER (WHERE digit IN (0, 5)) / any_value(m) AS ends FROM c GROUP BY 1, 2),
    f AS (SELECT *, observations >= 100 AND (test = 'last' OR (span >= 10 AND distinct_values >= 30)) AS ok FROM g JOIN s USING (region, test))
    SELECT region, test, observations, distinct_values, round(span, 5) AS span, CASE WHEN ok THEN 'EXPLORATORY' ELSE 'INSUFFICIENT' END AS status, CASE WHEN ok THEN round(chi2, 5) END AS chi2, CASE WHEN ok THEN round(mad, 7) END AS mad,
    CASE WHEN test = 'last' THEN round(ends, 4) END AS ends_0_5 FROM f"""
)
def digit_verdicts(spark, sf_dir):
    """M2 M3: chi-square, mean absolute deviation and share ending in 0 or 5 of a region's unit totals, with a status where a test doesn't apply."""
    totals = counted(spark, sf_dir).groupBy("region", "unit").agg(F.sum("n").alias("n"))
    v = M.digit_verdicts(totals, ["region"], "n")
    return v.select("region", "test", "observations", "distinct_values", _r("span", 5), "status", _r("chi2", 5), _r("mad", 7), _r("ends_0_5", 4))


_CENTRED = f"""{_PAIR}, c AS (SELECT region, area, zone, n, sxx - sx * sx / n AS cxx, syy - sy * sy / n AS cyy, sxy - sx * sy / n AS cxy FROM m WHERE n >= 2),
  w AS (SELECT *, sum(n) OVER v AS tn, sum(cxx) OVER v AS txx, sum(cyy) OVER v AS tyy, sum(cxy) OVER v AS txy FROM c WINDOW v AS (PARTITION BY region)),
  i AS (SELECT *, CASE WHEN txx > 1e-12 AND tyy > 1e-12 THEN greatest(-1, least(1, txy / sqrt(txx * tyy))) END AS r_all,
    CASE WHEN txx - cxx > 1e-12 AND tyy - cyy > 1e-12 THEN greatest(-1, least(1, (txy - cxy) / sqrt((txx - cxx) * (tyy - cyy)))) END AS r_without,
    CASE WHEN cxx > 1e-12 AND cyy > 1e-12 THEN greatest(-1, least(1, cxy / sqrt(cxx * cyy))) END AS r_zone FROM w),
  k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(abs(r_without - r_all), 9) DESC NULLS LAST, area, zone) AS by_influence, row_number() OVER (PARTITION BY region ORDER BY round(abs(cxy), 9) DESC, area, zone) AS by_cov FROM i)"""


@query(
    f"""WITH {_CENTRED} SELECT region, area, zone, n, round(r_zone, 6) AS r_zone, round(r_without, 6) AS r_without, round(r_without - r_all, 6) AS influence, by_influence, by_cov,
    round(100.0::DOUBLE * abs(cxy) / sum(abs(cxy)) OVER (PARTITION BY region), 3) AS cov_share FROM k QUALIFY by_influence <= 5 OR by_cov <= 5"""
)
def zone_drivers(spark, sf_dir):
    """The zones that drive a coefficient: their own one, their influence, and their share of the absolute covariance."""
    k = M.group_influence(_pair_moments(spark, sf_dir), ["region"], ["area", "zone"])
    return k.where("by_influence <= 5 or by_cov <= 5").select("region", "area", "zone", "n", _r("r_zone"), _r("r_without"), _r("influence"), "by_influence", "by_cov", _r("cov_share", 3))


@query(
    f"""WITH {_CENTRED} SELECT region, count(*) AS zones, round(any_value(r_all), 6) AS r, count(*) FILTER (WHERE cxy > 1e-12) AS positive, count(*) FILTER (WHERE cxy < -1e-12) AS negative, count(*) FILTER (WHERE cxy * sign(r_all) > 1e-12) AS aligned,
    round(100.0::DOUBLE * sum(abs(cxy)) FILTER (WHERE by_cov <= 1) / sum(abs(cxy)), 3) AS top1_share, round(100.0::DOUBLE * sum(abs(cxy)) FILTER (WHERE by_cov <= 5) / sum(abs(cxy)), 3) AS top5_share FROM k GROUP BY region"""
)
def zone_alignment(spark, sf_dir):
    """How many zones point the way of the whole, and the top zones' share of the absolute covariance."""
    k, part = M.group_influence(_pair_moments(spark, sf_dir), ["region"], ["area", "zone"]), F.abs("cxy")
    top = lambda n: F.round(F.lit(100.0) * F.sum(F.when(F.col("by_cov") <= n, part)) / F.sum(part), 3).alias(f"top{n}_share")
    return k.groupBy("region").agg(
        F.count("*").alias("zones"), F.round(F.first("r_all"), 6).alias("r"), F.count_if(F.col("cxy") > M.EPS).alias("positive"), F.count_if(F.col("cxy") < -M.EPS).alias("negative"), F.count_if(F.col("cxy") * F.signum("r_all") > M.EPS).alias("aligned"), top(1), top(5)
    )


def _rest(cond: str) -> str:
    s = lambda c: f"(any_value(t{c}) - sum(c{c}) FILTER (WHERE {cond}))"
    return f"CASE WHEN {s('xx')} > 1e-12 AND {s('yy')} > 1e-12 THEN greatest(-1, least(1, {s('xy')} / sqrt({s('xx')} * {s('yy')}))) END"


_DRAWS = 100


@query(
    f"""WITH {_CENTRED}, o AS (SELECT region, round(any_value(r_all), 6) AS r, {", ".join(f"round({_rest(f'by_cov <= {n}')}, 6) AS without_top{n}, round(100.0::DOUBLE * sum(n) FILTER (WHERE by_cov <= {n})::DOUBLE / any_value(tn)::DOUBLE, 3) AS removed_top{n}" for n in (1, 3, 5))},
      round({_rest("by_influence <= 5")}, 6) AS without_influential, any_value(r_all) AS ra FROM k GROUP BY region HAVING count(*) >= 7),
    d AS (SELECT k.*, replicate, row_number() OVER (PARTITION BY region, replicate ORDER BY md5(region || '|' || replicate || '|' || area || '|' || zone)) AS place FROM k, range(1, {_DRAWS + 1}) AS r(replicate)),
    q AS (SELECT region, replicate, {_rest("place <= 5")} AS r5 FROM d GROUP BY 1, 2),
    s AS (SELECT region, count(r5) AS draws, round(min(r5), 6) AS low, round(quantile_cont(r5, 0.025), 6) AS p025, round(median(r5), 6) AS mid, round(quantile_cont(r5, 0.975), 6) AS p975, round(max(r5), 6) AS high, round(100.0::DOUBLE * count(*) FILTER (WHERE r5 * ra > 0) / count(r5), 3) AS same_sign
      FROM q JOIN o USING (region) GROUP BY region)
    SELECT o.* EXCLUDE (ra), s.* EXCLUDE (region) FROM o JOIN s USING (region)"""
)
def zone_stress(spark, sf_dir):
    """The coefficient without its top 1, 3 and 5 zones and without 5 zones at random, drawn by a hash."""
    out = M.group_stress(M.group_influence(_pair_moments(spark, sf_dir), ["region"], ["area", "zone"]), ["region"], ["area", "zone"], _DRAWS)
    return out.select("region", *[_r(c, 3 if c.startswith("removed") or c == "same_sign" else 6) if c != "draws" else c for c in out.columns if c != "region"])


_SHARES = """{feed}, b AS (SELECT date_trunc('{unit}', ts) AS ts, count(*) AS units, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE category = 'click'), 0) AS BIGINT) AS a FROM feed GROUP BY 1),
  c AS (SELECT *, CAST(sum(units) OVER w AS BIGINT) AS seen, 100.0::DOUBLE * (sum(a) OVER w)::DOUBLE / (sum(n) OVER w)::DOUBLE AS cum FROM b WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING)),
  s AS (SELECT *, 100.0::DOUBLE * a / n AS share, cum - lag(cum) OVER (ORDER BY ts) AS d_cum FROM c WHERE n > 0)"""


def batch_shares(spark, sf_dir, unit):
    """(ts, units, n, a, seen, share, d_cum): batches of arrivals with a share, their place among all units and the change of the share so far."""
    a = F.sum(F.when(F.col("category") == "click", F.col("n")).otherwise(0))
    b = feed(spark, sf_dir).groupBy(F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("units"), F.sum("n").alias("n"), a.alias("a"))
    return M.with_shares(b, "ts")


_PERIODS = {"minutes": (120.0, 20160.0, 24), "units": (20.0, 4000.0, 24)}
#: Least count of a batch and width of the moving median, and prominences of valleys in percentage points.
CONFIGS = [(n, half) for n in (1, 400) for half in (3, 7, 10)]
LEVELS = [4, 8, 12]


def _sql_periods() -> str:
    return " UNION ALL ".join(f"SELECT '{axis}' AS axis, {lo}::DOUBLE * exp(k * (ln({hi}::DOUBLE) - ln({lo}::DOUBLE)) / {n - 1}) AS period FROM range({n}) AS r(k)" for axis, (lo, hi, n) in _PERIODS.items())


_GRID = f"""{_SHARES.format(feed=FEED, unit="{unit}")}, cfg(least, half) AS (VALUES {", ".join(map(str, CONFIGS))}),
  x AS ({" UNION ALL ".join(f"SELECT {n} AS least, {h} AS half, s.*, share - median(share) OVER (ORDER BY ts ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING) AS residual FROM s WHERE n >= {n}" for n, h in CONFIGS)}),
  p AS ({_sql_periods()}), v AS (SELECT least, half, axis, period, cos(2 * pi() * place / period) AS c, sin(2 * pi() * place / period) AS s, residual AS z
    FROM (SELECT *, CASE WHEN axis = 'units' THEN seen ELSE (epoch(ts) - (SELECT min(epoch(ts)) FROM s)) / 60.0::DOUBLE END AS place FROM x, p)),
  k AS (SELECT least, half, axis, period, count(*) AS m, sum(c * c) - sum(c) * sum(c) / count(*) AS cc, sum(s * s) - sum(s) * sum(s) / count(*) AS ss, sum(c * s) - sum(c) * sum(s) / count(*) AS cs, sum(c * z) - sum(c) * sum(z) / count(*) AS cz,
    sum(s * z) - sum(s) * sum(z) / count(*) AS sz, sum(z * z) - sum(z) * sum(z) / count(*) AS zz FROM v GROUP BY 1, 2, 3, 4),
  r AS (SELECT least, half, axis, period, CASE WHEN m >= 30 AND cc * ss - cs * cs > 1e-12 AND zz > 1e-12 THEN (ss * cz * cz - 2 * cs * cz * sz + cc * sz * sz) / ((cc * ss - cs * cs) * zz) END AS r2 FROM k),
  best AS (SELECT least, half, max_by(axis, r2) AS axis, max_by(period, r2) AS period, max(r2) AS r2 FROM r GROUP BY 1, 2),
  y AS (SELECT *, least(max(residual) OVER (PARTITION BY least, half ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), max(residual) OVER (PARTITION BY least, half ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) - residual AS prominence,
    lag(residual) OVER (PARTITION BY least, half ORDER BY ts) AS l, lead(residual) OVER (PARTITION BY least, half ORDER BY ts) AS h FROM x),
  z AS (SELECT level, y.*, seen - lag(seen) OVER (PARTITION BY least, half, level ORDER BY ts) AS gap FROM y, (VALUES {", ".join(f"({k})" for k in LEVELS)}) AS lv(level) WHERE residual <= l AND residual < h AND prominence >= level - 1e-9),
  n AS (SELECT least, half, count(*) AS selected FROM x GROUP BY 1, 2)"""


def _residual_sets(spark, sf_dir, unit, configs=CONFIGS):
    return M.residual_sets(batch_shares(spark, sf_dir, unit), configs)


def _best(sets):
    return M.best_periods(sets, _PERIODS)


@query(f"WITH {_GRID.replace('{unit}', 'hour')} SELECT least, half, selected, axis, round(period, 4) AS period, round(r2, 6) AS r2, level, coalesce(valleys, 0) AS valleys, min_gap, max_gap FROM best JOIN n USING (least, half) CROSS JOIN (VALUES {', '.join(f'({k})' for k in LEVELS)}) AS lv(level) LEFT JOIN (SELECT least, half, level, count(*) AS valleys, min(gap) AS min_gap, max(gap) AS max_gap FROM z GROUP BY 1, 2, 3) USING (least, half, level)")
def periodicity_grid(spark, sf_dir):
    """Best period and valleys with their gaps for six ways to choose and smooth the batches and three prominences."""
    sets = _residual_sets(spark, sf_dir, "hour")
    return M.sensitivity(sets, _best(sets), LEVELS).select("least", "half", "selected", "axis", _r("period", 4), _r("r2"), "level", "valleys", "min_gap", "max_gap")


_REPORT = """SELECT (SELECT count(*) FROM s) AS batches, selected, axis, round(period, 4) AS period, round(r2, 6) AS r2, (SELECT count(*) FROM z WHERE least = 1 AND half = 7 AND level = 8) AS valleys,
  (SELECT count(*) FROM s WHERE d_cum < 0) AS falls, (SELECT count(*) FROM s WHERE d_cum > 0) AS rises FROM best JOIN n USING (least, half) WHERE least = 1 AND half = 7"""


def _report(spark, sf_dir, unit):
    batches = batch_shares(spark, sf_dir, unit)
    sets = M.residual_sets(batches, [(1, 7)])
    moves = batches.agg(F.count("*").alias("batches"), F.count_if(F.col("d_cum") < 0).alias("falls"), F.count_if(F.col("d_cum") > 0).alias("rises"))
    one = M.sensitivity(sets, _best(sets), [8]).crossJoin(moves)  # a row each
    return one.select("batches", "selected", "axis", _r("period", 4), _r("r2"), "valleys", "falls", "rises")


@query(f"WITH {_GRID.replace('{unit}', 'hour')} {_REPORT}")
def periodicity_report(spark, sf_dir):
    """The best period over two axes, valleys and the direction of the share so far, on hourly batches."""
    return _report(spark, sf_dir, "hour")


@query(f"WITH {_GRID.replace('{unit}', 'minute')} {_REPORT}")
def periodicity_minutes(spark, sf_dir):
    """The same report on the minutes of receipt."""
    return _report(spark, sf_dir, "minute")


@query()
def periodicity_blocks(spark, sf_dir):
    """The same search on tie-atomic blocks of whole seconds; packing is sequential, so there is no twin."""
    rows = feed(spark, sf_dir).withColumn("a", F.when(F.col("category") == "click", F.col("n")).otherwise(0)).withColumn("all", F.lit("all"))
    seconds = rows.groupBy("all", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("units"), F.sum("n").alias("n"), F.sum("a").alias("a"))
    blocks = S.pack_ties(seconds, "all", "bucket", "units", ["n", "a"], 40).select(F.col("end").alias("ts"), "units", "n", "a")
    sets = M.residual_sets(M.with_shares(blocks, "ts"), [(1, 7)])
    return M.sensitivity(sets, _best(sets), [8]).select("selected", "axis", _r("period", 4), _r("r2"), "valleys")


@query()
def joint_periodicity(spark, sf_dir):
    """One shuffle of the shares serves all configurations; residuals are computed anew, and the maximum over all is compared. Random, so no twin."""
    return M.joint_max_p(batch_shares(spark, sf_dir, "hour"), CONFIGS, _PERIODS, 100)


_TAIL = f"""{_DELTAS}, o AS (SELECT *, row_number() OVER (ORDER BY ts) AS k, count(*) OVER () AS m FROM deltas), t AS (SELECT * FROM o WHERE k >= m // 2),
  e AS (SELECT min_by(total, ts) AS n0, min_by(a, ts) AS a0, min_by(units, ts) AS u0, max_by(total, ts) AS n1, max_by(a, ts) AS a1, max_by(units, ts) AS u1 FROM t),
  q AS (SELECT ts, k, units, total, a, d_total, d_a, lag(total) OVER w AS p_total, lag(units) OVER w AS p_units, n0, a0, u0, n1, a1, u1, a0 + CAST(floor((a1 - a0)::DOUBLE / (n1 - n0)::DOUBLE * (total - n0) + 0.5) AS BIGINT) AS oracle_a,
    a0::DOUBLE / n0 + (a1::DOUBLE / n1 - a0::DOUBLE / n0) / (u1 - u0) * (units - u0) AS line, a0::DOUBLE / n0 + (a1::DOUBLE / n1 - a0::DOUBLE / n0) / (u1 - u0) * (lag(units) OVER w - u0) AS p_line FROM t, e WINDOW w AS (ORDER BY ts))"""


@query(
    f"""WITH {_TAIL} SELECT ts, d_total, d_a, round(100.0::DOUBLE * a / total, 6) AS actual, oracle_a, round(100.0::DOUBLE * (a - oracle_a) / total, 6) AS oracle_residual, round(100.0::DOUBLE * line, 6) AS line_target,
    round(100.0::DOUBLE * (line * total - p_line * p_total) / d_total, 5) AS required_share, round(d_a - (line * total - p_line * p_total), 3) AS deviation, (line * total - p_line * p_total) NOT BETWEEN 0 AND d_total AS unphysical FROM q WHERE p_total IS NOT NULL AND d_total > 0"""
)
def publication_mechanics(spark, sf_dir):
    """Whole counts under the tail's final rate, and what each batch would have to be for a straight line between the ends."""
    q = M.published_tail(_deltas(spark, sf_dir), "ts", "units", "total", "a")
    return q.select("ts", "d_total", "d_a", _r("actual"), "oracle_a", _r("oracle_residual"), _r("line_target"), _r("required_share", 5), _r("deviation", 3), "unphysical")


@query(
    f"""WITH {_TAIL}, f AS (SELECT 100.0::DOUBLE * a / total AS y, 100.0::DOUBLE * oracle_a / total AS z, (units - u0)::DOUBLE AS x FROM q),
    m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) - sum(x) * sum(x) / count(*) AS xx, sum(x * y) - sum(x) * sum(y) / count(*) AS xy FROM f)
    SELECT any_value(n) AS n, round(any_value(xy / xx), 8) AS slope, round(sqrt(avg(pow(y - z, 2))), 6) AS oracle_rmse, round(max(abs(y - z)), 6) AS oracle_max, round(max(abs(y - (my + xy / xx * (x - mx)))), 6) AS max_deviation FROM f, m"""
)
def line_deviation(spark, sf_dir):
    """The largest deviation of a curve from its fitted line, and its distance from the curve of a constant rate."""
    q = M.published_tail(_deltas(spark, sf_dir), "ts", "units", "total", "a", keep_first=True)
    f = q.select("ts", F.col("actual").alias("y"), (F.lit(100.0) * F.col("oracle_a") / F.col("total")).alias("z"), F.col("x").cast("double").alias("x"))
    fit = M.line_fit(f, "x", "y").select("n", "slope", "intercept")
    off = F.abs(F.col("y") - (F.col("intercept") + F.col("slope") * F.col("x")))
    e = F.col("y") - F.col("z")
    out = f.crossJoin(F.broadcast(fit)).agg(F.first("n").alias("n"), F.first("slope").alias("slope"), F.sqrt(F.avg(e * e)).alias("oracle_rmse"), F.max(F.abs(e)).alias("oracle_max"), F.max(off).alias("max_deviation"))
    return out.select("n", _r("slope", 8), _r("oracle_rmse"), _r("oracle_max"), _r("max_deviation"))


_TARGET, _LEAST_UNITS = 4_000, 6


@query(
    f"""WITH {_DELTAS}, x AS (SELECT ts, total, d_total, d_units < {_LEAST_UNITS} OR d_total <= 0 AS excluded, coalesce(seconds > 3600, false) AS gap FROM deltas WHERE d_total IS NOT NULL),
    g AS (SELECT *, sum(CASE WHEN excluded OR gap THEN 1 ELSE 0 END) OVER (ORDER BY ts) AS stretch FROM x), ok AS (SELECT ts, total, total - d_total AS before, stretch FROM g WHERE NOT excluded),
    e AS (SELECT s.ts AS "start", min(d.ts) AS "end", any_value(s.before) AS before FROM ok s JOIN ok d ON d.stretch = s.stretch AND d.ts >= s.ts AND d.total >= s.before + {_TARGET * 8 // 10} GROUP BY 1)
    SELECT "start", "end", CAST(d.total - e.before AS BIGINT) AS volume FROM e JOIN ok d ON d.ts = e."end" WHERE d.total - e.before <= {_TARGET * 12 // 10}"""
)
def matched_windows_stopped(spark, sf_dir):
    """Windows of a target volume that end at a gap in time or at an excluded batch, and then don't count."""
    d = _deltas(spark, sf_dir).where("d_total is not null")
    excluded = (F.col("d_units") < _LEAST_UNITS) | (F.col("d_total") <= 0)
    g = S.stretches(d, "ts", excluded | F.coalesce(F.col("seconds") > 3600, F.lit(False))).where(~excluded)
    starts = g.select("stretch", F.col("ts").alias("start"), (F.col("total") - F.col("d_total")).alias("before"), (F.col("total") - F.col("d_total") + _TARGET * 8 // 10).alias("level"))
    ends = first_reaching(starts, g.select("stretch", "ts", "total"), "level", "total", "ts", "end", ["stretch"]).where("end is not null")
    out = ends.join(g.select(F.col("ts").alias("end"), "total"), "end").withColumn("volume", F.col("total") - F.col("before"))
    return out.where(F.col("volume") <= _TARGET * 12 // 10).select("start", "end", "volume")


@query(
    f"""WITH {COUNTED}, k AS (SELECT region, zone, count(DISTINCT unit) AS every, count(DISTINCT unit) FILTER (WHERE unit % 5 <> 0) AS principal, count(DISTINCT unit) FILTER (WHERE unit % 5 <> 0 OR area % 3 = 0) AS counted_units FROM counted GROUP BY 1, 2),
    s AS (SELECT region, CAST(sum(abs(every - counted_units)) AS BIGINT) AS off_every, CAST(sum(abs(principal - counted_units)) AS BIGINT) AS off_principal FROM k GROUP BY 1)
    SELECT region, off_every, off_principal, CASE WHEN off_every <= off_principal THEN 'EVERY' ELSE 'PRINCIPAL' END AS model, least(off_every, off_principal) AS off FROM s"""
)
def reference_model(spark, sf_dir):
    """Of two ways to count a reference's units, the one with the lesser summed difference by region; the first on ties."""
    unit, principal = F.col("unit"), F.col("unit") % 5 != 0
    of = lambda c: F.count_distinct(F.when(c, unit))
    k = counted(spark, sf_dir).groupBy("region", "zone").agg(F.count_distinct(unit).alias("every"), of(principal).alias("principal"), of(principal | (F.col("area") % 3 == 0)).alias("n"))
    off = lambda c: F.sum(F.abs(F.col(c) - F.col("n"))).alias(f"off_{c}")
    s = k.groupBy("region").agg(off("every"), off("principal"))
    return s.select("region", "off_every", "off_principal", F.when(F.col("off_every") <= F.col("off_principal"), "EVERY").otherwise("PRINCIPAL").alias("model"), F.least("off_every", "off_principal").alias("off"))


@query(
    f"""WITH {_DELTAS}, h AS (SELECT date_trunc('hour', ts) AS ts, count(*) AS units, CAST(sum(n) AS BIGINT) AS total FROM feed WHERE event_id % 500 <> 0 GROUP BY 1), d AS (SELECT ts, d_units, d_total FROM deltas WHERE d_total IS NOT NULL)
    SELECT CASE WHEN d.ts IS NULL THEN 'ONLY_LATER' WHEN h.ts IS NULL THEN 'ONLY_EARLIER' WHEN d_units = units AND d_total = total THEN 'EQUAL' ELSE 'DIFFERENT' END AS status, count(*) AS buckets FROM d FULL JOIN h ON d.ts = h.ts GROUP BY 1"""
)
def series_equality(spark, sf_dir):
    """Two series of one phenomenon, bucket by bucket and both ways."""
    d = _deltas(spark, sf_dir).where("d_total is not null").select("ts", "d_units", "d_total")
    h = feed(spark, sf_dir).where("event_id % 500 <> 0").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("d_units"), F.sum("n").alias("d_total"))
    return S.compared(d, h, "ts", ["d_units", "d_total"], ("ONLY_EARLIER", "ONLY_LATER")).groupBy("status").agg(F.count("*").alias("buckets"))


@query(
    f"""WITH {COUNTED}, u AS (SELECT region, contest, unit, max(received) AS done, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE category = 'RF'), 0) AS BIGINT) AS a FROM counted WHERE contest IN ('1', '2') GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY region, contest ORDER BY done, unit) AS k, count(*) OVER (PARTITION BY region, contest) AS m FROM u),
    g AS (SELECT region, contest, 100.0::DOUBLE * sum(a) FILTER (WHERE k > m - greatest(1, m // 4))::DOUBLE / sum(n) FILTER (WHERE k > m - greatest(1, m // 4))::DOUBLE - 100.0::DOUBLE * sum(a) FILTER (WHERE k <= greatest(1, m // 4))::DOUBLE / sum(n) FILTER (WHERE k <= greatest(1, m // 4))::DOUBLE AS gradient FROM k GROUP BY 1, 2)
    SELECT region, round(max(gradient) FILTER (WHERE contest = '1'), 6) AS gradient, round(max(gradient) FILTER (WHERE contest = '2'), 6) AS control, round(max(gradient) FILTER (WHERE contest = '1') - max(gradient) FILTER (WHERE contest = '2'), 6) AS difference FROM g GROUP BY 1"""
)
def gradient_control(spark, sf_dir):
    """The gradient of one contest less that of a control contest, by region."""
    u = counted(spark, sf_dir).where("contest in ('1', '2')").groupBy("region", "contest", "unit").agg(F.max("received").alias("done"), F.sum("n").alias("n"), F.sum(F.when(F.col("category") == "RF", F.col("n")).otherwise(0)).alias("a"))
    q = S.end_quarters(u, ["region", "contest"], [F.col("done"), F.col("unit")])
    share = lambda s: F.lit(100.0) * F.sum(F.when(F.col("quarter") == s, F.col("a"))) / F.sum(F.when(F.col("quarter") == s, F.col("n")))
    g = q.groupBy("region", "contest").agg((share("LATE") - share("EARLY")).alias("g"))
    of = lambda c: F.max(F.when(F.col("contest") == c, F.col("g")))
    return g.groupBy("region").agg(F.round(of("1"), 6).alias("gradient"), F.round(of("2"), 6).alias("control"), F.round(of("1") - of("2"), 6).alias("difference"))


@query(
    f"""WITH {_DELTAS}, d AS (SELECT 100.0::DOUBLE * d_a / d_total - 100.0::DOUBLE * (a - d_a) / (total - d_total) AS ca, 100.0::DOUBLE * d_b / d_total - 100.0::DOUBLE * (b - d_b) / (total - d_total) AS cb,
      100.0::DOUBLE * (d_total - d_a - d_b) / d_total - 100.0::DOUBLE * (total - d_total - a + d_a - b + d_b) / (total - d_total) AS cm FROM deltas WHERE d_total > 0 AND total > d_total)
    SELECT count(*) AS batches, round(sqrt(avg(ca * ca)), 6) AS rms_a, round(sqrt(avg(cb * cb)), 6) AS rms_b, round(sqrt(avg((ca * ca + cb * cb) / 2)), 6) AS rms_top2, round(sqrt(avg(cm * cm)), 6) AS rms_minor, round(max(abs(ca)), 6) AS largest_a FROM d"""
)
def composition_rms(spark, sf_dir):
    """Root mean square of the batches' change of composition, for the top two and for the minor categories together."""
    d = _deltas(spark, sf_dir).where("d_total > 0 and total > d_total")
    minor, d_minor = F.col("total") - F.col("a") - F.col("b"), F.col("d_total") - F.col("d_a") - F.col("d_b")
    change = lambda whole, part: F.lit(100.0) * part / F.col("d_total") - F.lit(100.0) * (whole - part) / (F.col("total") - F.col("d_total"))
    d = d.select(change(F.col("a"), F.col("d_a")).alias("ca"), change(F.col("b"), F.col("d_b")).alias("cb"), change(minor, d_minor).alias("cm"))
    rms = lambda e: F.round(F.sqrt(F.avg(e)), 6)
    ca, cb, cm = F.col("ca"), F.col("cb"), F.col("cm")
    return d.agg(F.count("*").alias("batches"), rms(ca * ca).alias("rms_a"), rms(cb * cb).alias("rms_b"), rms((ca * ca + cb * cb) / 2).alias("rms_top2"), rms(cm * cm).alias("rms_minor"), F.round(F.max(F.abs(ca)), 6).alias("largest_a"))
