"""Periodicity with shared shuffles, verdicts of digit tests, influence of groups, published tails: against plain computations."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.operators import series as S
from countloom.operators import stats as M
from countloom.operators.asof import asof_backward

AXES = {"minutes": (10.0, 200.0, 20), "units": (5.0, 100.0, 20)}


def batches(spark, period, n=240, noise=0.5):
    rng = random.Random(4)
    start = dt.datetime(2026, 1, 1)
    rows = []
    for k in range(n):
        share = 0.5 + (0.2 * math.sin(2 * math.pi * k / period) if period else 0) + noise * 0.1 * (rng.random() - 0.5)
        rows.append((start + dt.timedelta(minutes=k), 1, 1000, round(1000 * share)))
    return spark.createDataFrame(rows, "ts timestamp_ntz, units long, n long, a long")


def test_shuffles_stay_in_their_quarter():
    for n, block in [(0, 1), (1, 5), (17, 1), (100, 5), (103, 5)]:
        take = M.shuffled(n, np.random.default_rng(1), 4, block)
        assert sorted(take.tolist()) == list(range(n))
        quarter = np.minimum(3, np.arange(n) * 4 // max(n, 1))
        assert (quarter[take] == quarter).all()
    inside = M.shuffled(100, np.random.default_rng(2), 4, 5)
    assert sum(b == a + 1 for a, b in zip(inside, inside[1:])) >= 80  # stretches of five stay together


def test_peak_is_the_best_fit():
    rng = np.random.default_rng(3)
    share, half = rng.normal(size=60), 3
    (design,) = M._designs(np.arange(60.0), np.arange(60.0) * 2, np.full(60, 10.0), [(5, half)], {"minutes": (6.0, 30.0, 7)})
    median = [np.median(share[max(0, k - half) : k + half + 1]) for k in range(60)]
    z = share - median
    best = 0.0
    for p in np.geomspace(6, 30, 7):
        x = np.stack([np.ones(60), np.cos(2 * np.pi * np.arange(60) / p), np.sin(2 * np.pi * np.arange(60) / p)], axis=1)
        left = z - x @ np.linalg.lstsq(x, z, rcond=None)[0]
        best = max(best, 1 - (left @ left) / ((z - z.mean()) @ (z - z.mean())))
    assert M._peak(share, *design) == pytest.approx(best, abs=1e-9)


def test_joint_maximum(spark):
    configs = [(1, 7), (1, 20)]
    wave = {r["mode"]: r for r in M.joint_max_p(M.with_shares(batches(spark, 20), "ts"), configs, AXES, 60).collect()}
    none = {r["mode"]: r for r in M.joint_max_p(M.with_shares(batches(spark, None), "ts"), configs, AXES, 60).collect()}
    assert set(wave) == {"single", "blocks"} and wave["single"].p == pytest.approx(1 / 61) and wave["single"].observed > 0.5
    assert none["single"].p > 0.05 and none["single"].observed < 0.3
    best = M.best_periods(M.residual_sets(M.with_shares(batches(spark, 20), "ts"), configs), AXES).where("half = 20").first()
    assert 18 < best.period < 22 and best.r2 == pytest.approx(wave["single"].observed, abs=0.2)


def test_digit_verdicts(spark):
    values = [("a", 10 + k % 90) for k in range(500)] + [("b", k) for k in range(1, 40)] + [("c", None), ("d", 0)]
    got = {(r.g, r.test): r for r in M.digit_verdicts(spark.createDataFrame(values, "g string, n long"), ["g"], "n").collect()}
    second = got["a", "second"]
    assert second.status == "INSUFFICIENT" and second.chi2 is None and second.span == pytest.approx(9.9)  # spans less than tenfold
    own = [10 + k % 90 for k in range(500)]
    last = [n % 10 for n in own if n >= 30]
    want = sum((last.count(d) - len(last) / 10) ** 2 / (len(last) / 10) for d in range(10))
    assert got["a", "last"].status == "EXPLORATORY" and got["a", "last"].chi2 == pytest.approx(want)
    assert got["a", "last"].ends_0_5 == pytest.approx(100 * (last.count(0) + last.count(5)) / len(last))
    assert got["b", "first"].status == "INSUFFICIENT" and got["b", "first"].observations == 39
    assert ("c", "first") not in got and ("d", "last") not in got


def test_influence_against_leaving_out(spark):
    rng = random.Random(9)
    rows = [("r", k % 9, x := rng.random(), 0.3 * x * (k % 9 - 3) + rng.random()) for k in range(400)]
    m = M.moments(spark.createDataFrame(rows, "by string, g int, x double, y double"), ["by", "g"], "x", "y")

    def within(groups):
        xx = yy = xy = 0.0
        for g in groups:
            a = np.array([(x, y) for _, h, x, y in rows if h == g])
            a = a - a.mean(axis=0)
            xx, yy, xy = xx + a[:, 0] @ a[:, 0], yy + a[:, 1] @ a[:, 1], xy + a[:, 0] @ a[:, 1]
        return xy / math.sqrt(xx * yy)

    inf = M.group_influence(m, ["by"], ["g"])
    got = {r.g: r for r in inf.collect()}
    for g in range(9):
        assert got[g].r_without == pytest.approx(within([h for h in range(9) if h != g]))
        assert got[g].r_zone == pytest.approx(within([g])) and got[g].r_all == pytest.approx(within(range(9)))
    order = sorted(range(9), key=lambda g: -abs(got[g].influence))
    assert [g for g in order] == sorted(range(9), key=lambda g: got[g].by_influence)
    stress = M.group_stress(inf, ["by"], ["g"], 50, 5).first()
    top = sorted(range(9), key=lambda g: got[g].by_cov)
    assert stress.without_top3 == pytest.approx(within(top[3:])) and stress.without_influential == pytest.approx(within(order[5:]))
    assert stress.draws == 50 and stress.low <= stress.p025 <= stress.mid <= stress.p975 <= stress.high
    assert M.group_stress(inf.where("g < 6"), ["by"], ["g"], 5, 5).count() == 0  # too few groups to take five away


def test_published_tail_gives_possible_batches(spark):
    rng = random.Random(1)
    n = a = units = 0
    rows = []
    for k in range(40):
        units, more = units + rng.randint(1, 9), rng.randint(1, 500)
        n, a = n + more, a + rng.randint(0, more)
        rows.append((dt.datetime(2026, 1, 1, k // 2, 30 * (k % 2)), units, n, a))
    d = S.deltas(spark.createDataFrame(rows, "ts timestamp_ntz, units long, total long, a long"), "ts", ["units", "total", "a"])
    q = M.published_tail(d, "ts", "units", "total", "a", keep_first=True).orderBy("ts").collect()
    assert q[0].oracle_a == rows[19][3] and q[-1].oracle_a == rows[-1][3] and q[-1].oracle_residual == 0
    steps = [(y.oracle_a - x.oracle_a, y.total - x.total) for x, y in zip(q, q[1:])]
    assert all(0 <= s <= whole for s, whole in steps)
    assert q[0].line_target == pytest.approx(q[0].actual) and q[-1].line_target == pytest.approx(q[-1].actual)
    for x, y in zip(q, q[1:]):
        assert y.deviation == pytest.approx((rows[q.index(y) + 19][3] - rows[q.index(x) + 19][3]) - (y.line_target * y.total - x.line_target * x.total) / 100)


def test_as_of_by_buckets_is_as_of(spark):
    rng = random.Random(5)
    at = lambda: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rng.randrange(0, 20_000, 7))
    left = spark.createDataFrame([(k, rng.choice("ab"), at()) for k in range(200)] + [(900, "z", at())], "id int, g string, ts timestamp_ntz")
    right = spark.createDataFrame(list({(g, t): (g, t, k if k % 5 else None) for k, g, t in ((k, rng.choice("ab"), at()) for k in range(60))}.values()), "g string, ts timestamp_ntz, v int")
    for by in (["g"], []):
        l, r = (left, right) if by else (left.drop("g"), right.drop("g").groupBy("ts").agg(F.max("v").alias("v")))
        want = {x.id: (x.ts, x.v) for x in asof_backward(l, r, "ts", ["v"], by).collect()}
        got = asof_backward(l, r, "ts", ["v"], by, "day").collect()
        assert {x.id: (x.ts, x.v) for x in got} == want and len(got) == len(want) == 201
    assert any(v is None for _, v in want.values()) or want[900] is not None


def test_stretches_and_comparisons(spark):
    s = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (4, 8)], "t int, v int")
    assert [r.stretch for r in S.stretches(s, "t", F.col("t") == 3).orderBy("t").collect()] == [0, 0, 1, 1]
    other = spark.createDataFrame([(2, 6), (3, 9), (5, 1)], "t int, v int")
    assert {r.t: r.status for r in S.compared(s, other, "t", ["v"]).collect()} == {1: "ONLY_LEFT", 2: "EQUAL", 3: "DIFFERENT", 4: "ONLY_LEFT", 5: "ONLY_RIGHT"}
