"""Reconciliation: source precedence, missing is not zero, both formulations agree, any number of partitions."""

import pytest
from pyspark.sql import functions as F

from countloom.operators import reconcile as R

KEYS = ["region", "area", "zone", "unit", "turn", "contest", "category"]
ROWS = [
    ("a", "AC", "1007", "9", "1", "1", "1", "13", 50),
    ("a", "AC", "1007", "9", "1", "1", "1", "13", 17),
    ("fallback", "AC", "1007", "9", "1", "1", "1", "13", 67),
    ("b", "AC", "1007", "9", "1", "1", "1", "13", 67),
    ("a", "AC", "1007", "9", "1", "1", "1", "22", 143),
    ("fallback", "AC", "1007", "9", "1", "1", "1", "22", 143),
    ("a", "AC", "1007", "9", "1", "1", "1", "95", 2),
    ("fallback", "AC", "1007", "9", "1", "1", "1", "96", 7),
    ("a", "AC", "1007", "9", "1", "1", "1", "55", 10),
    ("fallback", "AC", "1007", "9", "1", "1", "1", "55", 9),
    ("a", "PE", "24570", "10", "20", "1", "25", "101", 17),
    ("a", "AL", "27000", "3", "4", "1", "1", "13", 100),
    ("b", "AL", "27000", "3", "4", "1", "1", "13", 100),
]


def frame(spark, rows=ROWS, n=3):
    return spark.createDataFrame(rows, f"source string, {', '.join(f'{k} string' for k in KEYS)}, n long").repartition(n)


@pytest.mark.parametrize("how", [R.reconcile, R.reconcile_by_join])
@pytest.mark.parametrize("partitions", [1, 7])
def test_published_fixture(spark, how, partitions):
    got = {(r.region, r.category): (r.n_a, r.n_b, r.diff, r.status) for r in how(frame(spark, n=partitions), KEYS).collect()}
    assert got == {
        ("AC", "13"): (67, 67, 0, "OK"),
        ("AC", "22"): (143, 143, 0, "OK"),
        ("AC", "95"): (2, None, None, "MISSING_B"),
        ("AC", "96"): (None, 7, None, "MISSING_A"),
        ("AC", "55"): (10, 9, 1, "DIFFERENT"),
        ("PE", "101"): (17, None, None, "MISSING_B"),
        ("AL", "13"): (100, 100, 0, "OK"),
    }


def test_summary_adds_up(spark):
    s = R.summary(R.reconcile(frame(spark), KEYS)).first()
    assert tuple(s) == (7, 3, 1, 2, 1)
    assert s.keys_compared == s.matches + s.missing_a + s.missing_b + s.different


def test_fallback_is_never_added(spark):
    before = R.reconcile(frame(spark), KEYS).where("category = '22'").first()
    later = R.reconcile(frame(spark, [*ROWS, ("b", "AC", "1007", "9", "1", "1", "1", "22", 143)]), KEYS).where("category = '22'").first()
    assert before.n_b == later.n_b == 143


def test_one_shuffle(spark):
    plan = R.reconcile(frame(spark), KEYS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(region") == 1 and "Join" not in plan


def test_null_counts(spark):
    rows = [("a", *["x"] * 7, None), ("b", *["x"] * 7, 0)]
    assert R.reconcile(frame(spark, rows), KEYS).first().status == "MISSING_A"


def test_key_differences_and_lookup(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z"), (4, "w")], "k int, v string")
    assert {(r.k, r.side) for r in R.key_differences(a, b, ["k"]).collect()} == {(1, "only_a"), (2, "both"), (3, "both"), (4, "only_b")}
    got = sorted((r.k, r.v, r["match"]) for r in R.lookup(a, b, ["k"], "v").fillna("-", "v").collect())
    assert got == [(1, "-", "UNMATCHED"), (2, "x", "MATCHED"), (2, "x", "MATCHED"), (3, "y", "AMBIGUOUS")]


def test_versions_and_strict_mode(spark):
    old = spark.createDataFrame([(1, 5, 0.1), (2, 6, 0.2)], "k int, n int, r double")
    new = spark.createDataFrame([(1, 5, 0.3), (2, 7, 0.2)], "k int, n int, r double")
    got = {r.k: (r.fixed_equal, r.r_changed) for r in R.compare_versions(old, new, ["k"], ["n"], ["r"]).collect()}
    assert got == {1: (True, True), 2: (False, False)}
    R.fatal_if_any(old.where(F.col("k") > 9), "nothing")
    with pytest.raises(ValueError, match="repeated"):
        R.fatal_if_any(old, "repeated")
