"""Hard negatives against brute force over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.llm import hard_negatives
from countloom.llm.hard_negatives import Queries, ball_tree, mine, search


def plain(rows, every=50, positives=5, negatives=3):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * x) for x in v]
        if sum(x * x for x in w) < 1 << 62:
            best[i] = min(best.get(i, (label, w)), (label, w))
    out = []
    for a, (label, v) in best.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in best.items() if i != a and len(w) == len(v)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == label][:positives]:
            fits = [i for i in order if best[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, rank + 1, i, score[p], score[i]) for rank, i in enumerate(fits[:negatives])]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("scale", [20, 1 << 26])
def test_search(same, scale):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 6)) * scale
    v = (middle[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 6)) * scale / 9).astype(np.int64)
    v[:700] = v[0]  # many equal vectors, many equal scores
    ids, labels = rng.permutation(3000), rng.integers(0, 4, 3000)
    ask = rng.choice(3000, 60)
    exact = v[ask].astype(object) @ v.T.astype(object)
    low, high = np.sort(exact[np.arange(60)[:, None], rng.integers(0, 3000, (60, 2))], axis=1).T.astype(np.int64)
    got = search(Queries(v[ask], ids[ask], labels[ask], low, high, same), v, ids, labels, 5)
    for k, a in enumerate(ask):
        want = sorted((-int(s), int(i)) for s, i, x in zip(exact[k], ids, labels) if (x == labels[a]) == same and i != ids[a] and low[k] <= s <= high[k])[:5]
        assert [(-s, i) for s, i in zip(got.score[k].tolist(), got.id[k].tolist()) if s != hard_negatives.NONE] == want


def test_tree_leaves_nodes_out(monkeypatch):
    rng = np.random.default_rng(5)
    v = (np.repeat(rng.normal(size=(40, 8)) * 900, 200, axis=0) + rng.normal(size=(8000, 8)) * 20).astype(np.int64)
    seen, add = [], hard_negatives.Best.add
    monkeypatch.setattr(hard_negatives.Best, "add", lambda self, q, s, i: (seen.append(len(np.unique(q))), add(self, q, s, i)))
    one = np.arange(1)
    search(Queries(v[:1], one, one, np.array([hard_negatives.NONE + 1]), np.array([1 << 62]), False), v, np.arange(8000), np.arange(8000) % 7, 3)
    assert 0 < sum(seen) < 8000 / hard_negatives.LEAF / 4

    def check(node):
        away = np.sqrt(((v[node.rows] - node.centre) ** 2).sum(axis=1))
        assert away.max() <= node.radius * (1 + 1e-12) and (node.children or len(node.rows) <= hard_negatives.LEAF)
        for child in node.children:
            check(child)

    check(ball_tree(v.astype(float), np.arange(8000) % 7))


@pytest.mark.parametrize("block, shard", [(256, 100), (1 << 13, 1 << 16)])
def test_dealt(spark, monkeypatch, block, shard):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    rng = np.random.default_rng(6)
    v = rng.integers(-3, 4, (1500, 4)) / 8
    v[300:900] = v[300]
    rows = [(int(i), [float(x) for x in e], int(i) % 3) for i, e in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    got = told(mine(df, every=4))
    assert got and got == plain(rows, every=4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.7, 0.6], 2), (3, [0.7, 0.6], 2), (3, [0.7, 0.6], 3), (50, [-1.0, 1.0], 2), (100, [0.5], 1), (101, [0.4], 1), (102, [0.3], 5),
        (150, [], 1), (151, [], 1), (152, [], 2), (200, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [nan, 1.0], 2), (8, [inf, 1.0], 2), (9, [1.0, 0.8], None), (None, [0.9, 0.8], 2), (10, [1e30, 1e30], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit("x"), "low": F.lit(1), "shard": F.lit(2)})
    assert told(mine(df)) == plain([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows])
    assert mine(df.where("false")).count() == 0
    assert mine(df.where("label = 1")).count() == 0
