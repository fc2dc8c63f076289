"""Series, as-of and overlap operators against plain Python."""

import datetime as dt
import random
from statistics import median

from pyspark.sql import functions as F

from countloom.operators import asof as J
from countloom.operators import series as S

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)


def series(spark, values, by="g"):
    return spark.createDataFrame([(by, at(60 * k), v) for k, v in enumerate(values)], "g string, ts timestamp_ntz, v double")


def test_deltas_and_cumulative(spark):
    s = S.cumulative(series(spark, [1.0, 2.0, 4.0]), "ts", ["v"], ["g"])
    got = [(r.v, r.d_v, r.seconds) for r in S.deltas(s, "ts", ["v"], ["g"]).orderBy("ts").collect()]
    assert got == [(1.0, None, None), (3.0, 2.0, 60.0), (7.0, 4.0, 60.0)]


def test_moving_median(spark):
    rng = random.Random(1)
    v = [float(rng.randint(0, 100)) for _ in range(40)]
    got = [r.residual for r in S.moving_median(series(spark, v), "ts", "v", 7, ["g"]).orderBy("ts").collect()]
    assert got == [x - median(v[max(0, k - 7) : k + 8]) for k, x in enumerate(v)]


def test_an_injected_valley_is_found(spark):
    v = [50.0] * 10 + [20.0] + [50.0] * 10 + [47.0] + [50.0] * 8
    got = S.valleys(series(spark, v), "ts", "v", 5, 10.0, ["g"]).collect()
    assert [(r.ts, r.prominence) for r in got] == [(at(600), 30.0)]


def test_longest_run(spark):
    s = series(spark, [1.0, 2.0, 0.0, 3.0, 4.0, 5.0, -1.0, 1.0, 1.0, 1.0])
    r = S.longest_run(s, "ts", F.col("v") > 0, ["g"]).first()
    assert (r.start, r.end, r.transitions) == (at(180), at(300), 3)


def test_cuts_are_strict(spark):
    rows = [("z", at(0), 2, 1), ("z", at(10), 3, 1), ("z", at(20), 5, 0)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, n long, a long")
    got = {r.cut: (r.pre_n, r.pre_a, r.all_n, r.all_a) for r in S.cut_sums(df, ["g"], "ts", [str(at(0)), str(at(10)), str(at(11))], {"n": F.col("n"), "a": F.col("a")}).collect()}
    assert got == {str(at(0)): (0, 0, 10, 2), str(at(10)): (2, 1, 10, 2), str(at(11)): (5, 2, 10, 2)}


def test_end_quarters(spark):
    for n, size in [(1, 1), (3, 1), (4, 1), (9, 2)]:
        rows = spark.createDataFrame([("g", k) for k in range(n)], "g string, k int")
        got = [r.quarter for r in S.end_quarters(rows, ["g"], [F.col("k")]).orderBy("k").collect()]
        assert got[:size] == ["EARLY"] * size and got.count("LATE") == (0 if n == 1 else size)


def test_average_ranks(spark):
    rows = spark.createDataFrame([(v,) for v in [3, 1, 3, 2, 3]], "v int")
    got = sorted((r.v, r.r) for r in rows.select("v", S.double_rank("v").alias("r")).collect())
    assert got == [(1, 2), (2, 4), (3, 8), (3, 8), (3, 8)]


def test_ties_are_never_split(spark):
    rows = [("c", at(k), 2, 300) for k in range(60)]
    s = spark.createDataFrame(rows, "g string, ts timestamp_ntz, events long, total long")
    got = S.pack_ties(s, "g", "ts", "events", ["total"], 5).orderBy("block").collect()
    assert got[0].events == 6 and sum(r.events for r in got) == 120 and len(got) == 20
    assert len(S.pack_ties(s, "g", "ts", "events", ["total"], 1).collect()) == 60
    assert all(r.events >= 7 for r in S.pack_ties(s, "g", "ts", "events", ["total"], 7).collect())
    few = S.pack_ties(s.limit(1), "g", "ts", "events", ["total"], 100).collect()
    assert len(few) == 1 and few[0].events == 2


def test_asof_and_first_reaching(spark):
    rng = random.Random(5)
    right = sorted({rng.randint(0, 500) for _ in range(60)})
    total, cum = 0, []
    for t in right:
        total += rng.randint(0, 5)
        cum.append((t, total))
    left = [rng.randint(-20, 520) for _ in range(80)]
    l = spark.createDataFrame([("g", at(t), t) for t in left], "g string, ts timestamp_ntz, k int")
    r = spark.createDataFrame([("g", at(t), v) for t, v in cum], "g string, ts timestamp_ntz, v int")
    got = sorted((x.k, x.v) for x in J.asof_backward(l, r, "ts", ["v"], ["g"]).fillna(-1).collect())
    assert got == sorted((t, max([v for s, v in cum if s <= t], default=-1)) for t in left)
    need = [rng.randint(0, total + 10) for _ in range(50)]
    levels = spark.createDataFrame([("g", n) for n in need], "g string, level int")
    reached = sorted((x.level, str(x.t)) for x in J.first_reaching(levels, r, "level", "v", "ts", "t", ["g"]).collect())
    assert reached == sorted((n, str(next((at(t) for t, v in cum if v >= n), None))) for n in need)


def test_receipts_before_publication(spark):
    received = spark.createDataFrame([("g", at(38), 100, 60), ("g", at(39), 200, 100), ("g", at(50), 300, 180)], "g string, ts timestamp_ntz, n int, a int")
    published = spark.createDataFrame([("g", at(39), 50), ("g", at(45), 200), ("g", at(60), 300)], "g string, ts timestamp_ntz, want int")
    ok = [(r.n, r.n - r.want) for r in J.asof_backward(published, received, "ts", ["n"], ["g"]).orderBy("ts").collect()]
    assert ok == [(200, 150), (200, 0), (300, 0)]
    first = [r.t for r in J.first_reaching(published.select("g", "want"), received, "want", "n", "ts", "t", ["g"]).orderBy("want").collect()]
    assert first == [at(38), at(39), at(50)]


def test_overlap_over_midnight(spark):
    day = 86_400
    rows = [("u", at(day - 600), at(day + 300)), ("u", at(100), at(200)), ("u", at(3 * day), at(3 * day))]
    got = J.overlap_days(spark.createDataFrame(rows, "u string, start timestamp_ntz, end timestamp_ntz"), ["u"]).orderBy("day").collect()
    assert [(str(r.day), r.intervals, r.total_us // 10**6, r.longest_us // 10**6) for r in got] == [("2024-01-01", 2, 700, 600), ("2024-01-02", 1, 300, 300)]


def test_nearest_snapshot(spark):
    s = spark.createDataFrame([("a", at(10)), ("a", at(20)), ("b", at(50))], "g string, ts timestamp_ntz")
    t = spark.createDataFrame([(at(15),), (at(5),)], "target timestamp_ntz")
    got = {(r.g, r.target): r.chosen for r in J.nearest_snapshot(t, s, "target", "ts", ["g"]).collect()}
    assert got == {("a", at(15)): at(10), ("a", at(5)): at(10), ("b", at(15)): at(50), ("b", at(5)): at(50)}
