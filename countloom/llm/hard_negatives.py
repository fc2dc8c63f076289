"""Hard negatives: for each anchor and each of its best rows of the same label, rows of other labels that score a stated share of it.

Vectors are dealt to shards and anchors to blocks, and a task holds one block against one shard: it builds a ball tree of the
shard's vectors and goes down it with all anchors of the block. A ball with centre c and radius r bounds the inner products with q by
q.c - |q| r and q.c + |q| r; a node is left out for an anchor if its balls lie outside the score window or strictly beneath the anchor's
current k-th. What a shard leaves for a slice of anchors travels as one row and is merged by slice. Scores are whole numbers and exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, stage

#: Vectors of a leaf; vectors that a shard should have at most, anchors of a block and of a slice.
LEAF = 64
SHARD = 1 << 16
BLOCK = 1 << 13
SLICE = 256
#: A score that nothing has.
NONE = np.iinfo(np.int64).min


@dataclass
class Node:
    rows: np.ndarray
    centre: np.ndarray
    radius: float
    labels: tuple[int, int]
    children: tuple[Node, ...] = ()


def ball_tree(vectors: np.ndarray, labels: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """Halves the rows at the median of the way between two far ones; equal vectors are halved by place, so the depth is log2 of the rows."""
    rows = np.arange(len(vectors)) if rows is None else rows
    own = vectors[rows]
    centre = own.mean(axis=0)
    away = np.sqrt(((own - centre) ** 2).sum(axis=1))
    node = Node(rows, centre, float(away.max(initial=0.0)), (int(labels[rows].min()), int(labels[rows].max())))
    if len(rows) > LEAF:
        one = own[away.argmax()]
        other = own[((own - one) ** 2).sum(axis=1).argmax()]
        order = np.argpartition(own @ (other - one), len(rows) // 2)
        node.children = tuple(ball_tree(vectors, labels, rows[part]) for part in (order[: len(rows) // 2], order[len(rows) // 2 :]))
    return node


class Best:
    """The k best (score, id) of each query so far: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        k = self.score.shape[1]
        touched = np.unique(query)
        query = np.concatenate((np.repeat(touched, k), query))
        score = np.concatenate((self.score[touched].ravel(), score))
        row_id = np.concatenate((self.id[touched].ravel(), row_id))
        order = np.lexsort((row_id, ~score, query))  # ~ reverses the order and can't overflow
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[place < k].reshape(len(touched), k)
        self.score[touched], self.id[touched] = score[order], row_id[order]


@dataclass
class Queries:
    """Vectors with the label and id of their anchor, and the window that scores must lie in."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same_label: bool


def search(q: Queries, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> Best:
    """The k best rows of each query. Every leaf is seen by the queries that its bounds don't rule out, the most promising leaf first."""
    best = Best(len(q.ids), k)
    if not len(ids) or not len(q.ids):
        return best
    plain, length = vectors.astype(float), np.sqrt((q.vectors.astype(float) ** 2).sum(axis=1))
    turned = q.vectors.astype(float)
    largest = float(length.max()) * float(np.sqrt((plain**2).sum(axis=1)).max())
    exact = largest < 2.0**53  # then no sum of products is rounded
    root = ball_tree(plain, labels)

    def possible(node: Node, active: np.ndarray) -> np.ndarray:
        first, last = node.labels
        fits = (q.labels[active] >= first) & (q.labels[active] <= last) if q.same_label else ~((first == last) & (q.labels[active] == first))
        active = active[fits]
        middle, reach = turned[active] @ node.centre, length[active] * node.radius
        slack = 1e-9 * (length[active] * (np.sqrt(node.centre @ node.centre) + node.radius) + 1)
        upper, lower = middle + reach + slack, middle - reach - slack
        return active[(upper >= q.low[active]) & (lower <= q.high[active]) & (upper >= best.score[active, -1])]

    def look(node: Node, active: np.ndarray) -> None:
        own = node.rows
        score = np.rint(turned[active] @ plain[own].T).astype(np.int64) if exact else q.vectors[active] @ vectors[own].T
        label = labels[own][None, :] == q.labels[active][:, None]
        fits = (label if q.same_label else ~label) & (ids[own][None, :] != q.ids[active][:, None])
        fits &= (score >= q.low[active][:, None]) & (score <= q.high[active][:, None])
        last, last_id = best.score[active, -1][:, None], best.id[active, -1][:, None]
        a, b = np.nonzero(fits & ((score > last) | ((score == last) & (ids[own][None, :] < last_id))))
        if len(a):
            best.add(active[a], score[a, b], ids[own][b])

    def down(node: Node, active: np.ndarray) -> None:
        active = possible(node, active)
        if not len(active):
            return
        if not node.children:
            look(node, active)
            return
        left, right = node.children
        toward = turned[active] @ (left.centre - right.centre) + length[active] * (left.radius - right.radius) >= 0
        if toward.sum() * 2 >= len(active):
            down(left, active)
            down(right, active)
        else:
            down(right, active)
            down(left, active)

    down(root, np.arange(len(q.ids)))
    return best


def _windows(score: int, low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int]:
    """Whole scores from low to high shares of ``score``."""
    return -(-score * low[0] // low[1]), score * high[0] // high[1]


def usable(rows: DataFrame, vec_id: str, vector: str, label: str | Column, scale: int) -> DataFrame:
    """(vec_id, label, v): the rows that take part, each component floor(scale * x), one row for an id."""
    v = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    odd = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    label = F.col(label) if isinstance(label, str) else label
    rows = rows.where(F.col(vec_id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(False)))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v")).where(size < 2.0**62)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(values), len(flat) // max(1, len(values)))


def _best(rows: DataFrame, anchors: DataFrame, k: int, same_label: bool, n_shards: int, n_blocks: int) -> DataFrame:
    """(anchor, part, rank, id, score): the k best rows for each anchor and each of its windows (``parts``: low, high)."""
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int")
    shard = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(n_shards)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    n_slices = n_blocks * (BLOCK // SLICE)
    dealt = rows.select(every(n_blocks).alias("block"), shard.alias("shard"), F.size("v").alias("dim"), F.lit(None).cast("long").alias("slice"), "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("low"), F.lit(None).cast("array<long>").alias("high"))
    asked = anchors.select(block.alias("block"), every(n_shards).alias("shard"), F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n_slices)).alias("slice"), "vec_id", "label", "v", "low", "high")
    types = {"anchor": np.int64, "part": np.int64, "id": np.int64, "score": np.int64}

    def against(table: pa.Table) -> pa.Table:
        asked, rows = table.filter(table["slice"].is_valid()), table.filter(table["slice"].is_null())
        if not asked.num_rows or not rows.num_rows:
            return pa.table({"slice": pa.array([], pa.int64()), "payload": pa.array([], pa.binary())})
        low, high = asked["low"].combine_chunks(), asked["high"].combine_chunks()
        parts = np.array([len(x) for x in low.to_pylist()], int)
        one = np.repeat(np.arange(len(parts)), parts)
        column = lambda t, c: t[c].to_numpy()
        flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
        q = Queries(_matrix(asked["v"])[one], column(asked, "vec_id")[one], column(asked, "label")[one], flat(low), flat(high), same_label)
        best = search(q, _matrix(rows["v"]), column(rows, "vec_id"), column(rows, "label"), k)
        part = np.arange(len(one)) - np.repeat(np.cumsum(parts) - parts, parts)
        a, b = np.nonzero(best.score != NONE)
        record = {"anchor": q.ids[a], "part": part[a], "id": best.id[a, b], "score": best.score[a, b]}
        slices = column(asked, "slice")[one][a]
        out = [(int(s), np.stack([record[c][slices == s] for c in types]).astype(np.int64).tobytes()) for s in np.unique(slices)]
        return pa.table({"slice": pa.array([s for s, _ in out], pa.int64()), "payload": pa.array([p for _, p in out], pa.binary())})

    def merged(table: pa.Table) -> pa.Table:
        anchor, part, row_id, score = np.concatenate([np.frombuffer(p, np.int64).reshape(4, -1) for p in table["payload"].to_pylist()], axis=1)
        order = np.lexsort((row_id, ~score, part, anchor))
        anchor, part, row_id, score = (x[order] for x in (anchor, part, row_id, score))
        new = np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(part) != 0)))
        begin = np.flatnonzero(new)
        rank = np.arange(len(anchor)) - np.repeat(begin, np.diff(np.append(begin, len(anchor))))
        kept = rank < k
        return pa.table({"anchor": anchor[kept], "part": part[kept].astype(np.int32), "rank": (rank[kept] + 1).astype(np.int32), "id": row_id[kept], "score": score[kept]})

    found = asked.unionByName(dealt).groupBy("block", "shard", "dim").applyInArrow(against, "slice long, payload binary")
    return found.groupBy("slice").applyInArrow(merged, "anchor long, part int, rank int, id long, score long")


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id ``every`` divides; their positives are the ``positives`` best other rows of the same label (all, if fewer). For each
    positive the ``negatives`` best rows of other labels come back whose score lies within the two shares of the positive's score; a positive
    without any has no row. Ties go by smaller id.

    Rows with a null id, label or vector or a component that is null or not finite take no part, nor do vectors whose whole-number components'
    squares add up to 2^62 or more: their scores fit no long. Of rows that share an id the one with the least (label, vector) counts. Only vectors
    of one length are compared; further columns are ignored; an empty table gives no rows.
    """
    spark = lean(rows.sparkSession)
    rows = stage(usable(rows, vec_id, vector, label, scale), "rows")
    anchors = rows.where(F.col("vec_id") % every == 0)
    n_shards = max(2 * spark.sparkContext.defaultParallelism, math.ceil(rows.count() / SHARD))
    n_blocks = max(1, math.ceil(anchors.count() / BLOCK))
    least, most = F.array(F.lit(NONE + 1).cast("long")), F.array(F.lit(np.iinfo(np.int64).max).cast("long"))
    best = _best(rows, anchors.withColumns({"low": least, "high": most}), positives, True, n_shards, n_blocks)
    best = stage(best.select("anchor", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    def windows(batches):
        for b in batches:
            pairs = [_windows(s, low, high) for s in b["positive_score"].to_pylist()]
            columns = [b[c] for c in ("anchor", "rank", "positive_id", "positive_score")]
            yield pa.record_batch([*columns, pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["anchor", "rank", "positive_id", "positive_score", "low", "high"])

    told = best.mapInArrow(windows, "anchor long, rank int, positive_id long, positive_score long, low long, high long")
    lists = told.where("low <= high").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score", "low", "high"))).alias("p"))
    asked = anchors.join(lists, anchors["vec_id"] == lists["anchor"]).select("vec_id", "label", "v", F.col("p.low").alias("low"), F.col("p.high").alias("high"))
    got = _best(rows, asked, negatives, False, n_shards, n_blocks)
    positive = lists.select("anchor", F.posexplode("p").alias("part", "x")).select("anchor", "part", "x.positive_id", "x.positive_score")
    return got.join(positive, ["anchor", "part"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
