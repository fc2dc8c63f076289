"""Matrices, levels, bands, top lists, closure, rules and left-out totals."""

from pyspark.sql import functions as F

from countloom.operators import aggregates as A
from countloom.plans import counts
from countloom.sources import driver


def offices(spark):
    rows = [(1, 15, 15, 30), (2, 10, 8, 19), (3, 20, 25, None), (4, 4, None, None)]
    long = [(u, o, n) for u, *ns in rows for o, n in zip("PGS", ns) if n is not None]
    return spark.createDataFrame(long, "unit int, office string, n long")


def test_matrix_keeps_absent_null(spark):
    m = A.presence(A.matrix(offices(spark), ["unit"], "office", "n", {"P": "p", "G": "g", "S": "s"}), ["g", "s"])
    got = {r.unit: (r.p, r.g, r.s, r.has_g, r.has_s) for r in m.collect()}
    assert got == {1: (15, 15, 30, 1, 1), 2: (10, 8, 19, 1, 1), 3: (20, 25, None, 1, 0), 4: (4, None, None, 0, 0)}
    pairs = m.where("p is not null and g is not null")
    d = F.col("p") - F.col("g")
    assert tuple(pairs.agg(F.count("*"), F.count_if(d != 0), F.sum(d), F.sum(F.abs(d))).first()) == (3, 2, -3, 7)
    bands = pairs.where(d != 0).groupBy(A.band(F.abs(d), [1, 2, 5, 10]).alias("b")).count().collect()
    assert {r.b: r["count"] for r in bands} == {"2": 1, "3-5": 1}


def test_band_edges(spark):
    got = spark.range(1, 13).select(A.band(F.col("id"), [1, 2, 5, 10]).alias("b")).collect()
    assert [r.b for r in got] == ["1", "2", "3-5", "3-5", "3-5", *["6-10"] * 5, "11+", "11+"]


def test_levels(spark):
    rows = spark.createDataFrame([("x", "p", 1), ("x", "q", 2), ("y", "p", 4), ("y", None, 8)], "a string, b string, n long")
    got = {(r.level, r.a, r.b): r.n for r in A.levels(rows, [[], ["a"], ["a", "b"]], {"n": F.sum("n")}).collect()}
    assert got == {(0, None, None): 15, (1, "x", None): 3, (1, "y", None): 12, (2, "x", "p"): 1, (2, "x", "q"): 2, (2, "y", "p"): 4, (2, "y", None): 8}


def test_top_k_breaks_ties_by_order(spark):
    rows = spark.createDataFrame([("u", c, n) for c, n in [("b", 5), ("a", 5), ("c", 9), ("d", 1)]], "g string, c string, n long")
    got = A.top_k(rows, ["g"], [F.desc("n"), F.asc("c")], 2).collect()
    assert [(r.c, r["rank"]) for r in got] == [("c", 1), ("a", 2)]


def test_closure(spark):
    rows = spark.createDataFrame([("r", "z1", 5), ("r", "z2", 6), ("s", "z1", 1)], "r string, z string, n long")
    totals = spark.createDataFrame([("r", 12), ("t", 3)], "r string, total long")
    got = {x.r: (x.total, x.children, x.n_children, x.difference) for x in A.closure(rows, ["r"], ["r", "z"], totals).collect()}
    assert got == {"r": (12, 11, 2, 1), "s": (0, 1, 1, -1), "t": (3, 0, 0, 3)}


def test_rules_ignore_missing(spark):
    rows = spark.createDataFrame([(1, 10, 5), (2, None, 5), (3, 4, 5)], "k int, eligible int, turnout int")
    rules = {"TURNOUT_OVER_ELIGIBLE": F.col("turnout") > F.col("eligible"), "SMALL": F.col("turnout") < 6}
    assert sorted((r.k, r.rule) for r in A.violations(rows, ["k"], rules).collect()) == [(1, "SMALL"), (2, "SMALL"), (3, "SMALL"), (3, "TURNOUT_OVER_ELIGIBLE")]


def test_leave_one_out(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 10)], "g string, n long")
    assert {r.g: r.n for r in A.leave_one_out(rows, ["g"], ["n"]).collect()} == {"a": 10, "b": 3}


def test_classify(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "k int, g string")
    special = spark.createDataFrame([(2, "special")], "k int, label string")
    groups = spark.createDataFrame([("x", "left")], "g string, label string")
    got = {r.k: r.label for r in A.classify(rows, "k", [("k", special), ("g", groups)], "other").collect()}
    assert got == {1: "left", 2: "special", 3: "other"}


def test_weighted_errors(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (-3.0, 3.0)], "e double, w double")
    e = A.weighted_errors(F.col("e"), F.col("w"))
    assert tuple(rows.agg(e["bias"], e["mae"], e["rmse"]).first()) == (-2.0, 2.5, 7.0**0.5)
    assert tuple(rows.where("w > 9").agg(e["bias"], e["mae"], e["rmse"]).first()) == (None, None, None)


def test_tasks_of_the_facts_follow_the_rows(spark, monkeypatch):
    """More rows make more tasks, not larger ones, whatever the session's number of partitions; units stay whole within a task."""
    sf = "/root/testdata/sf0.001"
    plain = sorted(map(tuple, counts.rule_violations(spark, sf).collect()))
    monkeypatch.setattr(driver, "TASK_ROWS", 200)
    facts = driver.counted(spark, sf).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in facts.groupBy("task").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 600 and sum(sizes) == driver.table(spark, sf, "lineitem").count()
    assert facts.groupBy("unit").agg(F.count_distinct("task").alias("n")).where("n > 1").count() == 0
    assert sorted(map(tuple, counts.rule_violations(spark, sf).collect())) == plain
