"""Embedding near-duplicates against brute force: no wrong link, recall, and every odd input."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from countloom.llm import queries, vector_graph

SCHEMA = "vec_id long, embedding array<float>, label int, unit string, key string"


def brute(rows, threshold=0.98):
    ok = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    by = {}
    for k in ok:
        by.setdefault((rows[k][2], len(rows[k][1])), []).append(k)
    for ks in by.values():
        x = np.array([np.float32(rows[k][1]).astype(float) for k in ks])
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                links[ks[a]].add(ks[b])
    root = {}
    for k in range(len(rows)):
        if k in root:
            continue
        todo, group = [k], {k}
        while todo:
            for y in links[todo.pop()] - group:
                group.add(y)
                todo.append(y)
        for y in group:
            root[y] = min((rows[z][0] for z in group if rows[z][0] is not None), default=None)
    return [(rows[k][0], len(links[k]), root[k]) for k in range(len(rows))]


def clustered(seed, n, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.1, 0.3], (n, 1))
    return [(int(k), [float(v) for v in np.float32(row)], int(rng.choice([0, 0, 0, 1, 2]))) for k, row in enumerate(x)]


def compare(spark, rows, shard, least):
    got = vector_graph.near_duplicates(spark.createDataFrame([(*r, "u", "k") for r in rows], SCHEMA).repartition(3), shard=shard).collect()
    want = sorted(brute(rows), key=str)
    assert sorted(str(r.vec_id) for r in got) == sorted(str(w[0]) for w in want)
    exact = {w[0]: w for w in want}
    for r in got:
        if r.vec_id is not None:
            assert r.n_links <= exact[r.vec_id][1]
            assert r.kept == (r.component_id == r.vec_id)
    total = sum(w[1] for w in want)
    assert sum(r.n_links for r in got) >= least * total
    return got, exact, total


@pytest.mark.parametrize("shard", [10_000, 150])
def test_recall_and_precision(spark, shard):
    got, exact, total = compare(spark, clustered(5, 1500), shard, 0.97)
    assert total > 1000
    same = sum(r.component_id == exact[r.vec_id][2] for r in got)
    assert same >= 0.97 * len(got)


def test_one_group_of_near_copies(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(k, [float(v) for v in np.float32(base + rng.normal(size=16) * 0.03)], 1) for k in range(700)]
    got, exact, _ = compare(spark, rows, 100, 0.97)
    assert {r.component_id for r in got} == {0}


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 1), (3, v, 1), (3, v, 1), (4, [2.0, 4.0, 6.0], 1), (9, v, 2), (8, v, None), (7, None, 1), (6, [], 1), (10, [0.0, 0.0, 0.0], 1)]
    rows += [(11, [1.0, None, 2.0], 1), (12, [1.0, float("nan"), 2.0], 1), (13, [float("inf"), 1.0, 1.0], 1), (14, [1.0, 2.0], 1), (None, v, 1), (15, [3e38, 3e38, 1e38], 3), (16, [3e38, 3e38, 1e38], 3), (17, [-1.0, -2.0, -3.0], 1)]
    got = {}
    for r in vector_graph.near_duplicates(spark.createDataFrame([(*r, "u", "k") for r in rows], SCHEMA)).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[5] == [(3, 3, False)] and got[3] == [(3, 3, True)] * 2 and got[4] == [(3, 3, False)]
    assert got[15] == [(1, 15, True)] and got[16] == [(1, 15, False)]
    for alone in (6, 7, 8, 9, 10, 11, 12, 13, 14, 17):
        assert got[alone] == [(0, alone, True)]
    assert got[None] == [(0, None, False)]


def test_empty(spark):
    assert vector_graph.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_embedding_dedup(spark, sf)
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table.collect()]
    exact = {w[0]: w for w in brute(rows)}
    wrong = [r for r in got.collect() if (r.n_links, r.component_id) != exact[r.vec_id][1:]]
    assert not wrong


def test_audit(spark):
    rows = clustered(6, 600)
    frame = spark.createDataFrame([(*r, "u", "k") for r in rows], SCHEMA)
    audit = vector_graph.audit_recall(frame, vector_graph.near_duplicates(frame, shard=150), every=7).first()
    want = sum(w[1] for w in brute(rows) if w[0] % 7 == 0)
    assert audit.links == want > 0 and 0.9 <= audit.recall <= 1.0


def test_audit_query(spark):
    audit = queries.embedding_recall_audit(spark, "/root/testdata/sf0.01").first()
    assert audit.queries >= 5 and (audit.recall is None or audit.recall >= 0.9)


def test_crowds_are_split_with_their_overlaps(spark):
    """A ball at the border of a cell, and vectors that no centre tells apart: members are bounded, not homes only."""
    rng = np.random.default_rng(8)
    base = np.ones(16)
    x = np.concatenate((rng.normal(size=(400, 16)), base + rng.normal(size=(1500, 16)) * 0.02, -base + rng.normal(size=(600, 16)) * 1e-15))
    units = [(k, "a", (v / np.linalg.norm(v)).tobytes(), 1) for k, v in enumerate(x)]
    got = vector_graph.shards(spark.createDataFrame(units, "node long, cell string, unit binary, n long"), 100).collect()
    members, homes = Counter(r.shard for r in got), Counter(r.node for r in got if r.home == r.shard)
    assert max(members.values()) <= 300
    assert homes == Counter(range(len(x)))


def test_memory_of_a_crowd():
    """A shard whose members are all linked and have edges into many others: pairs and their edges aren't held at once."""
    rng = np.random.default_rng(9)
    x = 1 + rng.normal(size=(1000, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists = []
    for k, near in enumerate(vector_graph.pruned_graph(x)):
        edges = np.zeros(len(near) + 20, vector_graph._EDGE)
        edges["node"], edges["home"], edges["cosine"] = [*near, *range(5000 + 20 * k, 5020 + 20 * k)], [*[7] * len(near), *range(100, 120)], 0.999
        lists.append([edges.tobytes()])
    columns = {"shard": [7] * 1000, "node": range(1000), "home": [7] * 1000, "unit": [v.tobytes() for v in x], "n": [1] * 1000, "lists": lists, "entries": pa.nulls(1000, pa.list_(pa.int64()))}
    t = pa.table({k: v if k == "entries" else pa.array(list(v)) for k, v in columns.items()})
    tracemalloc.start()
    got = vector_graph._searched(0.98, True)(t).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # it was 1.7 GB
    counts, links, onward = (got[got.kind == k] for k in range(3))
    assert (counts.other == 999).all() and len(counts) == 1000 and len(links) == 999
    assert len(onward) == 1000 * 20 and set(onward.other) == set(range(100, 120))
    assert ((onward.entry - 5000) % 20 + 100 == onward.other).all()
