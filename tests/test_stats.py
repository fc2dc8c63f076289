"""Statistics: reversal within groups, guards, closed forms, injected periods, reproducible resampling, no look-ahead."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.functions.scalars import nearest_count
from countloom.operators import forecast as P
from countloom.operators import stats as M
from countloom.operators.series import numbered


def simpson(spark):
    rows = []
    for copy in range(10):
        rows += [("r", z, p + copy * 1e-6, g + copy * 1e-6) for z, p, g in [(1, 0.10, 0.70), (1, 0.20, 0.80), (2, 0.70, 0.10), (2, 0.80, 0.20)]]
    return spark.createDataFrame(rows, "region string, zone int, x double, y double")


def test_correlation_turns_within_groups(spark):
    r = M.raw_and_within(M.moments(simpson(spark), ["region", "zone"], "x", "y"), ["region"], ["zone"]).first()
    assert r.r_raw < -0.8 and r.r_within == pytest.approx(1.0) and r.groups == 2
    flag = spark.createDataFrame([(r.r_raw, r.r_within), (0.5, 0.2), (0.5, 0.45), (None, 0.1)], "a double, b double").select(M.reversal(F.col("a"), F.col("b")).alias("f"))
    assert [x.f for x in flag.collect()] == ["REVERSED", "SHIFTED", "STABLE", "UNDEFINED"]


def test_moments_do_not_depend_on_how_they_are_added(spark):
    m = M.moments(simpson(spark).repartition(7), ["region", "zone"], "x", "y")
    whole = M.add_moments(m, ["region"]).first()
    direct = M.moments(simpson(spark), ["region"], "x", "y").first()
    assert [whole[c] for c in ("n", "sx", "sxx", "sxy")] == pytest.approx([direct[c] for c in ("n", "sx", "sxx", "sxy")])


@pytest.mark.parametrize(("rows", "want"), [([(k, k / 100) for k in range(40)], 1.0), ([(1.0, float(k)) for k in range(80)], None), ([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], None)])
def test_pearson_guards(spark, rows, want):
    df = spark.createDataFrame([(1, 1, float(a), float(b)) for a, b in rows], "g int, z int, x double, y double")
    got = M.raw_and_within(M.moments(df, ["g", "z"], "x", "y"), ["g"], ["z"]).first().r_raw
    assert got == (None if want is None else pytest.approx(want))


def test_leave_out_and_bootstrap(spark):
    m = M.moments(simpson(spark), ["region", "zone"], "x", "y")
    out = M.leave_group_out(m, ["region"], ["zone"]).collect()
    assert all(r.r_all == pytest.approx(1.0) for r in out) and len(out) == 2
    a, b = M.group_bootstrap(m, ["region"], ["zone"], 50).first(), M.group_bootstrap(m.repartition(5), ["region"], ["zone"], 50).first()
    assert a == b and a.replicates == 50 and a.low <= a.median <= a.high


def test_bounds(spark):
    rows = spark.createDataFrame([(8, 5, 10), (2, 5, 10), (3, 5, 8)], "p int, s int, n int")
    got = [tuple(r) for r in rows.select(*M.frechet(F.col("p"), F.col("s"), F.col("n"))).collect()]
    assert got == [(3, 5, 0), (0, 2, 3), (0, 3, 2)]


def test_digit_guards(spark):
    same = spark.createDataFrame([(12,)] * 150, "n long")
    applies = (F.count("*") >= 100) & (F.count_distinct("n") >= 30)
    assert M.digit_table(same, F.substring(F.col("n").cast("string"), 1, 1), M.benford_share(F.col("digit")), applies).count() == 0
    wide = spark.range(1, 2000).select(F.col("id").alias("n"))
    got = M.digit_table(wide, F.substring(F.col("n").cast("string"), 1, 1), M.benford_share(F.col("digit")), applies).collect()
    assert len(got) == 9 and sum(r.expected for r in got) == pytest.approx(1.0) and sum(r.share for r in got) == pytest.approx(1.0)
    second = spark.range(10).select(F.sum(M.benford_share(F.col("id"), True)).alias("s")).first().s
    assert second == pytest.approx(1.0)


def test_outliers(spark):
    rows = [("g", k, 0.5 + 0.02 * ((k % 7) - 3)) for k in range(65)] + [("g", 99, 0.05)] + [("flat", k, 0.3) for k in range(9)]
    got = M.robust_outliers(spark.createDataFrame(rows, "g string, k int, v double"), ["g"], "v", 5.0).collect()
    assert [r.k for r in got] == [99] and got[0].z < -5


def test_shape(spark):
    v = np.random.default_rng(1).gamma(2.0, size=500)
    r = M.shape(spark.createDataFrame([("g", float(x)) for x in v], "g string, v double"), ["g"], "v").first()
    d = v - v.mean()
    assert r["skew"] == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5) and r.excess == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)


def test_line_depends_on_spacing(spark):
    fit = lambda x: M.line_fit(spark.createDataFrame([(float(a), b) for a, b in zip(x, [43.0, 43.4, 43.5])], "x double, y double"), "x", "y").first()
    assert fit([0, 377, 436]).rmse != pytest.approx(fit([0, 1, 2]).rmse)
    exact = M.line_fit(spark.createDataFrame([(float(k), 3.0 + 2 * k) for k in range(9)], "x double, y double"), "x", "y").first()
    assert (exact.slope, exact.intercept, exact.r2) == pytest.approx((2.0, 3.0, 1.0))


def wave(spark, noise):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(k, float(np.sin(2 * np.pi * k / 24) + noise * rng.normal())) for k in range(240)], "x int, v double")


def test_a_period_is_found(spark):
    grid = spark.createDataFrame([(p,) for p in (7.0, 12.0, 24.0, 50.0)], "period double")
    r = {x.period: x.r2 for x in M.periodogram(wave(spark, 0.0), "x", "v", grid).collect()}
    assert r[24.0] == pytest.approx(1.0) and max(r, key=r.get) == 24.0
    p = M.permutation_p(wave(spark, 0.3), "x", "v", [7.0, 12.0, 24.0, 50.0], 60)
    got = p.first()
    assert got.hits == 0 and got.p == pytest.approx(1 / 61) and got == p.first()
    flat = spark.createDataFrame([(k, float(v)) for k, v in enumerate(np.random.default_rng(8).normal(size=240))], "x int, v double")
    assert M.permutation_p(flat, "x", "v", [7.0, 12.0, 24.0, 50.0], 60).first().p > 0.05
    assert M.permutation_p(flat.limit(0), "x", "v", [7.0, 12.0, 24.0, 50.0], 60).first().p is None
    one = M.permutation_p(flat.limit(1), "x", "v", [7.0, 12.0, 24.0, 50.0], 60).first()
    assert (one.observed, one.hits, one.p) == (0.0, 60, 1.0)


@pytest.mark.parametrize("n, strata, block", [(50, 4, 1), (101, 4, 5), (3, 4, 1), (64, 1, 10)])
def test_shuffles(spark, n, strata, block):
    s = numbered(spark.range(n).select(F.col("id").alias("o"), F.col("id").cast("double").alias("v")).repartition(7), ["o"])
    assert [(r.o, r.k, r.rows) for r in s.orderBy("o").collect()] == [(k, k, n) for k in range(n)]
    got = {}
    for r in M.shuffles(s, 20, strata, block, 5).collect():
        got.setdefault(r.replicate, {})[r.k] = int(r.v)
    quarter = [min(strata - 1, k * strata // n) for k in range(n)]
    assert set(got) == set(range(21)) and all(got[0][k] == k for k in range(n))
    for places in got.values():
        assert sorted(places) == sorted(places.values()) == list(range(n)) and all(quarter[k] == quarter[v] for k, v in places.items())
    together = sum(p.get(k + 1) == v + 1 for p in got.values() for k, v in p.items())
    assert n < 50 or (together > 21 * n * 0.6) == (block > 1)
    again = {(r.replicate, r.k): int(r.v) for r in M.shuffles(s.repartition(3), 20, strata, block, 5).collect()}
    assert again == {(r, k): v for r, places in got.items() for k, v in places.items()}


def test_random_refills(spark):
    rows = spark.createDataFrame([(k, 100, 90 if k < 5 else 10) for k in range(10)], "k int, n long, x long")
    got = M.hypergeometric_mix(rows, "k", "n", "x", 100).collect()
    spread = {r.replicate: r.spread for r in got}
    assert spread[0] == pytest.approx(0.4) and max(v for k, v in spread.items() if k) < 0.2 and len(spread) == 101


def test_nearest_count(spark):
    rows = spark.createDataFrame([(1, 2, 5), (1, 3, 2), (0, 5, 9), (5, 5, 9)], "x long, t long, n long")
    assert [r.y for r in rows.select(nearest_count(F.col("x"), F.col("t"), F.col("n")).alias("y")).collect()] == [3, 1, 0, 9]


def test_holdout_has_no_look_ahead(spark):
    rows = [("r1", k, 100 + k, 40 + k % 5, k % 5 == 0) for k in range(50)] + [("r2", k, 10, 1, True) for k in range(3)]
    schema = "region string, unit int, n long, x long, test boolean"
    run = lambda rs: {(r.model, r.region, r.unit): r.predicted for r in P.fixed_share(spark.createDataFrame(rs, schema), F.col("test"), [[], ["region"]]).collect()}
    changed = [(a, b, n, 0 if t else x, t) for a, b, n, x, t in rows]
    assert run(rows) == run(changed)
    assert run(rows)["region", "r2", 0] == run(rows)["all", "r2", 0]


def test_shrunken_rates(spark):
    pre = spark.createDataFrame([("r", 1, 1000, 600), ("r", 2, 1000, 200)], "region string, zone int, n long, x long")
    levels = [[], ["region"], ["region", "zone"]]
    target = spark.createDataFrame([("r", 1), ("r", 3), ("s", 1)], "region string, zone int")
    got = {(r.region, r.zone): (r.rate0, r.rate1, r.rate2, r.category) for r in P.with_rates(target, P.shrunk_rates(pre, levels, "n", "x"), levels).collect()}
    assert got["r", 1][3] == "comparable"
    assert got["r", 1][:3] == pytest.approx((0.4, 0.4, 0.5))
    assert got["r", 3][:3] == pytest.approx((0.4, 0.4, 0.4)) and got["r", 3][3] == "no_history_zone"
    assert got["s", 1][:3] == pytest.approx((0.4, 0.4, 0.4)) and got["s", 1][3] == "no_history_region"
