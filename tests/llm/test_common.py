"""Components, packed exchanges and the session's settings."""

import random
from pathlib import Path

import numpy as np
import pytest

from countloom.llm import common


def brute(edges):
    label = {x: x for e in edges for x in e if x is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            label[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in label}


def test_components(spark):
    rng = random.Random(3)
    path = list(range(1000, 1200))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(5, k) for k in range(10, 300)] + [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)]
    edges += [(-(1 << 63), (1 << 63) - 1), (7, 7), (None, 4), (4, None), (5, 10), (10, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute(edges)
    assert got == {k: v for k, v in want.items() if k in got}
    assert all(v == k for k, v in want.items() if k not in got)


def test_no_edges(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert common.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_packed_and_unpacked():
    rng = np.random.default_rng(1)
    bucket, a, b = rng.integers(0, 9, 500), rng.integers(0, 1 << 63, 500, np.uint64), rng.integers(0, 255, 500).astype(np.uint8)
    seen = []
    for batch in common.packed(bucket, [a, b]):
        for k, n, payload in zip(batch["bucket"].to_pylist(), batch["n"].to_pylist(), batch["payload"].to_pylist()):
            x, y = common.unpacked([n], [payload], [np.uint64, np.uint8])
            seen += [(k, int(p), int(q)) for p, q in zip(x, y)]
    assert sorted(seen) == sorted(zip(bucket.tolist(), a.tolist(), b.tolist()))
    assert list(common.packed(np.zeros(0, np.int64), [a[:0]])) == []


def test_staged_tables_live_in_the_shared_folder(spark):
    staged = common.stage(spark.range(9), "nine")
    assert staged.count() == 9 and staged.inputFiles()[0].startswith(common.shared_dir(spark))
    common.discard(spark, staged.staged_path)
    assert spark.range(1).count() == 1 and not Path(staged.staged_path.removeprefix("file://")).exists()


def test_links_that_are_left_are_an_error(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    with pytest.raises(RuntimeError):
        common.components(path, rounds=1)


def test_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for before, after in (("64m", common.BATCH), (str(1 << 20), 1 << 20)):
        spark.conf.set(key, before)
        common.lean(spark)
        assert int(spark.conf.get(key)) == after
    spark.conf.set(key, str(common.BATCH))
