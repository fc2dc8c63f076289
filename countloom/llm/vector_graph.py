"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards.

Distinct vectors of a label are split by sampled centres until a shard is small, overlaps included; every vector has
a home shard and overlaps into the next nearest one. What centres can't split is dealt by a hash. Each shard builds a single-layer graph: candidates
from its vectors, pruned so that an edge stays only if no kept neighbour is much nearer to its end. The
adjacency lists of a vector's shards are united. Each vector then searches its home shard greedily
from the medoid, and expands everything in range; where united lists or overlapping members lead on to
another shard, the search goes there in the next round. All links found are verified in double precision.

Copies of one vector are one node. A search reports how many vectors it links with and a spanning star,
never pairs, so that a group of near copies costs no rows of its square. What a task holds is bounded by a shard's
members and a number of pairs, however many vectors lie within range of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lean, stage

#: A shard is split if it has more home vectors than this, or more than CROWD times as many members.
SHARD, CROWD = 512, 3
#: Centres of a split, sampled vectors for each of them, and rounds of their fit.
CENTRES, SAMPLE, FIT = 64, 64, 8
#: Candidates of a vector (nearest, and spread ones for long edges), its degree and the slack of the pruning.
NEAREST, SPREAD, DEGREE, LONG, ALPHA = 48, 16, 24, 6, 1.2
#: Width of the beam, and levels of splits by centres.
BEAM, LEVELS = 24, 8
#: Edges and components of vectors that are looked at together, pairs of queries and members, and queries of a shard that one task answers.
BLOCK, PAIRS, ASKING = 1 << 17, 1 << 20, 4096
#: Rows of shards for each task of a search.
DEALT = 1 << 14
_EDGE = np.dtype([("node", "<i8"), ("home", "<i8"), ("cosine", "<f4")])


def _unit(v: list | None) -> bytes | None:
    """The vector over its length; None if it is null, empty or zero or holds a null or non-finite component."""
    if not v or any(x is None for x in v):
        return None
    x = np.array(v, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return (x / np.sqrt((x * x).sum())).tobytes()


def with_units(vectors: DataFrame) -> DataFrame:
    """(vec_id, label string, unit binary): unit is null for a vector that links with nothing."""

    def run(batches):
        for b in batches:
            yield pa.record_batch({"vec_id": b.column(0), "label": b.column(1), "unit": pa.array([_unit(v) for v in b.column(2).to_pylist()], pa.binary())})

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, label string, unit binary")


def _matrix(column) -> np.ndarray:
    units = column.to_pylist()
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def _centres(t: pa.Table) -> pa.Table:
    """Spherical k-means of a cell's sample. Rows count in the order of their bytes.

    It begins with vectors far from each other and as many drawn ones, so that a crowd is split as well.
    """
    t = t.sort_by("unit")
    x = _matrix(t["unit"])
    k = int(min(t["k"][0].as_py(), len(x)))
    chosen = np.random.default_rng(len(x)).permutation(len(x))[: k // 2 + 1].tolist()
    near = (x @ x[chosen].T).max(axis=1)
    for _ in range(k - len(chosen)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    c = x[chosen].copy()
    for _ in range(FIT):
        own = (x @ c.T).argmax(axis=1)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        length = np.sqrt((s * s).sum(axis=1))
        c[length > 0] = s[length > 0] / length[length > 0, None]
    return pa.table({"cell": t["cell"].slice(0, 1), "centres": pa.array([c.tobytes()], pa.binary())})


def _assigned(batches):
    for b in batches:
        out = {"cell": [], "node": [], "home": [], "unit": [], "n": []}
        for cell, node, home, unit, n, centres in zip(*(b.column(k).to_pylist() for k in range(6))):
            x = np.frombuffer(unit, np.float64)
            by = np.argsort(-(np.frombuffer(centres, np.float64).reshape(-1, len(x)) @ x), kind="stable")
            for rank, c in enumerate(by[: 2 if home else 1].tolist()):
                out["cell"].append(f"{cell}/{c}")
                out["home"].append(home and rank == 0)
                out["node"].append(node)
                out["unit"].append(unit)
                out["n"].append(n)
        yield pa.RecordBatch.from_pydict(out, schema=_CELL)


_CELL = pa.schema([("cell", pa.string()), ("node", pa.int64()), ("home", pa.bool_()), ("unit", pa.binary()), ("n", pa.int64())])
_CELL_SQL = "cell string, node long, home boolean, unit binary, n long"


def shards(nodes: DataFrame, size: int = SHARD) -> DataFrame:
    """(shard long, node, home long, unit, n) from (node, cell, unit, n): the home row and the overlaps of each node.

    Cells with over ``size`` home vectors or CROWD times as many members are split by centres that are fitted to a sample
    of at most about CENTRES x SAMPLE of their members; every vector is assigned. A cell that is still
    too large after LEVELS splits holds vectors that centres hardly tell apart: it is dealt by a hash.
    """
    left, done, level = nodes.select("cell", "node", F.lit(True).alias("home"), "unit", "n"), None, 0
    while True:
        left = stage(left, "cells")
        count = left.groupBy("cell").agg(F.count("*").alias("m"), F.count_if("home").alias("h")).where((F.col("h") > size) | (F.col("m") > CROWD * size))
        k = F.least(F.lit(CENTRES), F.ceil(F.greatest(F.col("h"), F.col("m") / CROWD) / size) + 1).cast("int")
        parts = (F.ceil((F.col("m") + F.col("h")) / size) + 1).cast("int")
        big = stage(count.select("cell", k.alias("k"), parts.alias("parts"), (F.lit(SAMPLE) * k / F.col("m")).alias("share")), "big-cells")
        small = left.join(big.select("cell"), "cell", "left_anti")
        done = small if done is None else done.unionByName(small)
        if big.isEmpty():
            break
        if level < LEVELS:
            sample = left.join(big, "cell").where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
            centres = stage(sample.select("cell", "unit", "k").groupBy("cell").applyInArrow(_centres, "cell string, centres binary"), "centres")
            left = left.join(centres, "cell").select("cell", "node", "home", "unit", "n", "centres").mapInArrow(_assigned, _CELL_SQL)
        else:
            first = F.pmod(F.xxhash64("node", F.lit(level)), F.col("parts"))
            other = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(-level)), F.col("parts") - 1), F.col("parts"))
            dealt = left.join(big.select("cell", "parts"), "cell").select("cell", "node", "home", "unit", "n", F.posexplode(F.when(F.col("home"), F.array(first, other)).otherwise(F.array(first))).alias("rank", "at"))
            left = dealt.select(F.concat_ws("/", "cell", F.col("at").cast("string")).alias("cell"), "node", (F.col("home") & (F.col("rank") == 0)).alias("home"), "unit", "n")
        level += 1
    done = done.withColumn("shard", F.xxhash64("cell"))
    homes = done.where("home").select("node", F.col("shard").alias("at"))
    return stage(done.join(homes, "node").select("shard", "node", F.col("at").alias("home"), "unit", "n"), "shards")


def pruned_graph(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each row of ``x`` (unit vectors): robust-pruned, mutual, and all reachable from the medoid."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)]
    cosine = (x @ x.T).astype(np.float32)
    np.fill_diagonal(cosine, -2)
    near = min(NEAREST, n - 1)
    pool = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
    spread = np.random.default_rng(n).integers(0, n, (n, min(SPREAD, n - 1)))
    pool = np.concatenate((pool, spread), axis=1)
    rows = np.arange(n)[:, None]
    order = np.argsort(-cosine[rows, pool], axis=1, kind="stable")
    pool = pool[rows, order]
    far = 2 - 2 * cosine[rows, pool]
    alive = (pool != rows) & np.concatenate((np.ones((n, 1), bool), pool[:, 1:] != pool[:, :-1]), axis=1)
    kept, count = np.zeros(pool.shape, bool), np.zeros(n, np.int64)
    for t in range(pool.shape[1]):
        room = DEGREE if t < near else DEGREE + LONG  # the last places are for long edges
        take = alive[:, t] & (count < room)
        kept[take, t] = True
        count += take
        between = 2 - 2 * cosine[pool[:, t][:, None], pool]
        alive &= ~(take[:, None] & (ALPHA**2 * between <= far))
    a, b = np.nonzero(kept)
    b = pool[a, b]
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    reached = np.zeros(n, bool)
    frontier = np.array([int((x @ x.mean(axis=0)).argmax())])
    while True:
        while len(frontier):
            reached[frontier] = True
            hit = np.zeros(n, bool)
            hit[frontier] = True
            step = b[hit[a]]
            frontier = np.unique(step[~reached[step]])
        lost = np.flatnonzero(~reached)
        if not len(lost):
            break
        inside = np.flatnonzero(reached)
        best = cosine[np.ix_(lost, inside)]
        u = int(best.max(axis=1).argmax())
        v = int(inside[best[u].argmax()])
        a, b = np.append(a, [v, lost[u]]), np.append(b, [lost[u], v])
        frontier = lost[u : u + 1]
    pairs = np.unique(a * n + b)
    a, b = pairs // n, pairs % n
    return np.split(b, np.searchsorted(a, np.arange(1, n)))


def _built(t: pa.Table) -> pa.Table:
    t = t.sort_by("unit")  # so that the same vectors give the same graph
    x, node, home = _matrix(t["unit"]), t["node"].to_numpy(), t["home"].to_numpy()
    lists = []
    for k, near in enumerate(pruned_graph(x)):
        edges = np.zeros(len(near), _EDGE)
        edges["node"], edges["home"], edges["cosine"] = node[near], home[near], x[near] @ x[k]
        lists.append(edges.tobytes())
    return pa.table({"node": t["node"], "edges": pa.array(lists, pa.binary())})


class Shard:
    """The members of a shard with their united adjacency, restricted to it, and the edges that leave it."""

    def __init__(self, node: np.ndarray, home: np.ndarray, x: np.ndarray, lists: list[list[bytes]]):
        self.node, self.home, self.x = node, home, x
        by = np.argsort(node)
        size = np.array([sum(map(len, p)) for p in lists]) // _EDGE.itemsize
        flat, row = np.frombuffer(b"".join([e for p in lists for e in p]), _EDGE), np.repeat(np.arange(len(node)), size)
        at = by[np.minimum(np.searchsorted(node, flat["node"], sorter=by), len(node) - 1)]
        here = node[at] == flat["node"]
        self.out_row, self.out = row[~here], flat[~here]
        # of a member's edges into one shard the nearest is enough
        near = np.lexsort((self.out["node"], -self.out["cosine"], self.out["home"], self.out_row))
        self.out_row, self.out = self.out_row[near], self.out[near]
        new = np.ones(len(near), bool)
        new[1:] = (self.out_row[1:] != self.out_row[:-1]) | (self.out["home"][1:] != self.out["home"][:-1])
        self.out_row, self.out = self.out_row[new], self.out[new]
        pairs = np.unique(row[here] * len(node) + at[here])
        a, b = pairs // len(node), pairs % len(node)
        degree = np.bincount(a, minlength=len(node))
        self.near = np.full((len(node), max(1, int(degree.max(initial=0)))), -1, np.int64)
        self.near[a, np.arange(len(a)) - np.repeat(np.cumsum(degree) - degree, degree)] = b
        self.medoid = int((x @ x.mean(axis=0)).argmax())
        self.place = dict(zip(node.tolist(), range(len(node))))
        self.x32 = x.astype(np.float32)
        self.edges: np.ndarray | None = None

    @staticmethod
    def cosines(q: np.ndarray, x: np.ndarray, row: np.ndarray, to: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(row), x.dtype), max(1, (BLOCK << 3) // x.shape[1])
        for s in range(0, len(row), step):
            out[s : s + step] = np.einsum("ij,ij->i", q[row[s : s + step]], x[to[s : s + step]])
        return out

    def search(self, q: np.ndarray, entries: list[list[int]], slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, member, cosine) of what lies within ``slack``: greedy with a beam, then all in range is expanded."""
        m, n = len(q), len(self.node)
        q = q.astype(np.float32)
        seen = np.zeros((m, n), bool)
        beam, score = np.full((m, BEAM), -1), np.full((m, BEAM), -3.0, np.float32)
        open_ = np.zeros((m, BEAM), bool)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        row = np.repeat(np.arange(m), [len(e) for e in entries])
        to = np.array([k for e in entries for k in e], np.int64)
        while len(row):
            new = np.unique(row * n + to)
            row, to = new // n, new % n
            fresh = ~seen[row, to]
            row, to = row[fresh], to[fresh]
            seen[row, to] = True
            c = self.cosines(q, self.x32, row, to)
            found.append((row, to, c))
            if len(row):
                some, begin = np.unique(row, return_index=True)
                size = np.diff(np.append(begin, len(row)))
                width = int(size.max())
                place = np.arange(len(row)) - np.repeat(begin, size)
                at = np.repeat(np.arange(len(some)), size)
                b, s, o = np.full((len(some), BEAM + width), -1), np.full((len(some), BEAM + width), -3.0, np.float32), np.zeros((len(some), BEAM + width), bool)
                b[:, :BEAM], s[:, :BEAM], o[:, :BEAM] = beam[some], score[some], open_[some]
                b[at, BEAM + place], s[at, BEAM + place], o[at, BEAM + place] = to, c, True
                top = np.argpartition(-s, BEAM - 1, axis=1)[:, :BEAM]
                lines = np.arange(len(some))[:, None]
                beam[some], score[some], open_[some] = b[lines, top], s[lines, top], o[lines, top]
            best = np.where(open_, score, -3.0)
            pick = best.argmax(axis=1)
            active = np.flatnonzero(open_[np.arange(m), pick])
            open_[active, pick[active]] = False
            row, to = self._spread(active, beam[active, pick[active]])
        row, to, c = (np.concatenate(x) for x in zip(*found))
        inside = c >= slack
        row, to = row[inside], to[inside]
        while len(row):
            new = np.unique(row * n + to)
            a, b = [], []
            for r, t in self._around(new // n, new % n, seen):
                seen[r, t] = True
                c = self.cosines(q, self.x32, r, t)
                found.append((r, t, c))
                a.append(r[c >= slack])
                b.append(t[c >= slack])
            row, to = np.concatenate(a), np.concatenate(b)
        row, to, c = (np.concatenate(x) for x in zip(*found))
        inside = c >= slack
        return row[inside], to[inside], c[inside]

    def _around(self, row: np.ndarray, node: np.ndarray, seen: np.ndarray):
        """(row, neighbour), each once, of what isn't seen: by lists, or if that is less work by a product with the matrix of the edges."""
        n, width = len(self.node), self.near.shape[1]
        if len(row) * width * 300 > seen.size * n and n <= BLOCK >> 5:
            if self.edges is None:
                self.edges = np.zeros((n, n), np.float32)
                self.edges[self._spread(np.arange(n), np.arange(n))] = 1
            hit = np.zeros(seen.shape, np.float32)
            hit[row, node] = 1
            yield np.nonzero((hit @ self.edges > 0) & ~seen)
            return
        for s in range(0, len(row), BLOCK // width + 1):
            r, t = self._spread(row[s : s + BLOCK // width + 1], node[s : s + BLOCK // width + 1])
            fresh = ~seen[r, t]
            pairs = np.unique(r[fresh] * n + t[fresh])
            yield pairs // n, pairs % n

    def onward(self, row: np.ndarray, to: np.ndarray, c: np.ndarray, link: np.ndarray, homes: np.ndarray, own: int, sure: float, far: float):
        """(query, shard, entry), one for each query and shard: members linked whose home is elsewhere, and edges that leave from members near enough.

        An edge leads on if its angle is ``sure`` more than the member's at most; hits have angles up to ``far``.
        """
        m, n = len(homes), len(self.node)
        angle = np.arccos(np.clip(self.out["cosine"], -1, 1))
        always = np.flatnonzero(angle <= sure)
        maybe = np.flatnonzero((angle > sure) & (angle <= sure + far))
        away = np.flatnonzero(self.home != own)
        shards = np.unique(np.concatenate((self.home[away], self.out["home"][always], self.out["home"][maybe])))
        hit, linked = np.zeros((m, n), bool), np.zeros((m, n), bool)
        hit[row, to] = True
        linked[row[link], to[link]] = True
        entry = np.full((m, len(shards)), -1, np.int64)
        for among, members, nodes, place in ((hit, self.out_row[always], self.out["node"][always], self.out["home"][always]), (linked, away, self.node[away], self.home[away])):
            by = np.lexsort((nodes, place))
            members, nodes = members[by], nodes[by]
            cuts = np.searchsorted(place[by], shards), np.searchsorted(place[by], shards, "right")
            for k, (lo, hi) in enumerate(zip(*(x.tolist() for x in cuts))):
                if lo < hi:
                    part = among[:, members[lo:hi]]
                    first = part.argmax(axis=1)
                    yes = part[np.arange(m), first]
                    entry[yes, k] = nodes[lo:hi][first[yes]]
        if len(maybe):
            member, target, nodes = self.out_row[maybe], np.searchsorted(shards, self.out["home"][maybe]), self.out["node"][maybe]
            begin, size = np.searchsorted(member, np.arange(n)), np.bincount(member, minlength=n)
            some = np.flatnonzero(size[to] > 0)
            for lo in range(0, len(some), step := BLOCK // int(size.max()) + 1):
                k = some[lo : lo + step]
                times = size[to[k]]
                pair = np.repeat(k, times)
                e = np.repeat(begin[to[k]], times) + np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
                ok = (angle[maybe][e] - np.arccos(np.clip(c[pair], -1, 1)) <= sure) & (entry[row[pair], target[e]] < 0)
                entry[row[pair[ok]], target[e[ok]]] = nodes[e[ok]]
        entry[shards == homes[:, None]] = -1
        entry[:, shards == own] = -1
        a, k = np.nonzero(entry >= 0)
        return a, shards[k], entry[a, k]

    def _spread(self, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.near[node]
        a, b = np.nonzero(to >= 0)
        return row[a], to[a, b]


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that span the components of the links (a, b) between ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


_FOUND = pa.schema([("kind", pa.int32()), ("node", pa.int64()), ("other", pa.int64()), ("entry", pa.int64())])


def _searched(threshold: float, first: bool):
    slack = float(np.cos(1.2 * np.arccos(threshold)))
    reach, wide = np.arccos(threshold), np.arccos(slack)

    def run(t: pa.Table) -> pa.Table:
        """Rows of three kinds: 0 (node, number of vectors linked), 1 a link (node, root), 2 (node, shard to go to, entry)."""
        asked = t["entries"].is_valid().to_numpy()
        members = t.filter(pa.array(~asked))
        if not len(members):
            return _FOUND.empty_table()
        own = int(t["shard"][0].as_py())
        home, node, n = members["home"].to_numpy(), members["node"].to_numpy(), members["n"].to_numpy()
        s = Shard(node, home, _matrix(members["unit"]), members["lists"].to_pylist())
        if first:
            asking = np.flatnonzero(home == own)
            q, ids, homes = s.x[asking], node[asking], home[asking]
            entries = [[s.medoid, k] for k in asking.tolist()]
        else:
            queries = t.filter(pa.array(asked))
            q, ids, homes = _matrix(queries["unit"]), queries["node"].to_numpy(), queries["home"].to_numpy()
            entries = [[s.medoid, *(s.place[e] for e in set(x) if e in s.place)] for x in queries["entries"].to_pylist()]
        if not len(q):
            return _FOUND.empty_table()
        # nodes by their place: members, then queries that are none
        of = np.array([s.place.get(k, -1) for k in ids.tolist()])
        guest = np.flatnonzero(of < 0)
        of[guest] = len(node) + np.arange(len(guest))
        names = np.concatenate((node, ids[guest]))
        count, stars, go = np.zeros(len(q), np.int64), [], []
        step = max(1, PAIRS // len(node))
        for lo in range(0, len(q), step):
            part = q[lo : lo + step]
            row, to, c = s.search(part, entries[lo : lo + step], slack)
            near = np.flatnonzero(c >= threshold - 1e-3)
            link = np.zeros(len(row), bool)
            link[near] = s.cosines(part, s.x, row[near], to[near]) >= threshold
            link &= of[lo + row] != to
            mine = link & (home[to] == own)
            count[lo : lo + step] = np.bincount(row[mine], weights=n[to[mine]], minlength=len(part)).astype(np.int64)
            stars.append(_stars(of[lo + row[link]], to[link], len(names)))
            a, shard, entry = s.onward(row, to, c, link, homes[lo : lo + step], own, (reach + wide) / 2, wide)
            go.append((ids[lo + a], shard, entry))
        a, b = _stars(*(np.concatenate(x) for x in zip(*stars)), len(names))
        a, b = names[a], names[b]
        g = [np.concatenate(x) for x in zip(*go)]
        some = np.flatnonzero(count)
        kind = np.repeat([0, 1, 2], [len(some), len(a), len(g[0])])
        return pa.table([pa.array(kind, pa.int32()), *(pa.array(np.concatenate(x).astype(np.int64)) for x in ((ids[some], a, g[0]), (count[some], b, g[1]), (np.zeros(len(some) + len(a)), g[2])))], schema=_FOUND)

    return run


def search_all(members: DataFrame, threshold: float) -> DataFrame:
    """All rounds of the search over ``members`` (shard, node, home, unit, n): rows (kind, node, other)."""
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), members.count() // DEALT)
    lists = members.repartition(tasks, "shard").groupBy("shard").applyInArrow(_built, "node long, edges binary").groupBy("node").agg(F.collect_list("edges").alias("lists"))
    none = F.lit(None).cast("array<long>").alias("entries")
    table = stage(members.join(lists, "node").select("shard", "node", "home", "unit", "n", "lists", none), "graph")
    homes = table.where("shard = home").select("node", "home", "unit")
    schema = "kind int, node long, other long, entry long"
    found = stage(table.repartition(tasks, "shard").groupBy("shard").applyInArrow(_searched(threshold, True), schema), "found")
    every = [found]
    gone = None
    while True:
        go = found.where("kind = 2").groupBy("node", F.col("other").alias("shard")).agg(F.array(F.min("entry")).alias("entries"))
        if gone is not None:
            go = go.join(gone, ["node", "shard"], "left_anti")
        go = stage(go, "onward")
        if go.isEmpty():
            break
        gone = go.select("node", "shard") if gone is None else gone.unionByName(go.select("node", "shard"))
        # a shard that many ask is searched by several tasks, each with all its members
        parts = go.groupBy("shard").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("parts"))
        queries = go.join(homes, "node").join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        queries = queries.select("shard", "node", "home", "unit", F.lit(None).cast("long").alias("n"), F.lit(None).cast("array<binary>").alias("lists"), "entries", "part")
        asked = table.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        found = stage(asked.unionByName(queries).repartition(tasks, "shard", "part").groupBy("shard", "part").applyInArrow(_searched(threshold, False), schema), "found")
        every.append(found)
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out.where("kind < 2").select("kind", "node", "other")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, shard: int = SHARD) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and their cosine, in double precision, is at
    least ``threshold``. Null, empty and zero vectors and such with a null or non-finite component link with
    nothing, nor do vectors of different lengths. Every row is a vector of its own, also one that repeats another; its
    copies are counted in ``n_links``. A row with a null vec_id has no links and a null component_id, and is not kept.
    Search is approximate: it misses links where the graph does not lead to them, and reports none that is not one.
    An empty table gives no rows; further columns are not read.
    """
    lean(vectors.sparkSession)
    rows = with_units(vectors)
    key = F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("unit").isNotNull(), F.sha2(F.concat(F.encode(F.col("label"), "UTF-8"), F.lit(b"\0"), F.col("unit")), 256))
    rows = stage(rows.withColumn("key", key), "units")
    nodes = rows.where("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    cell = F.concat_ws(":", F.octet_length("unit").cast("string"), "label")
    nodes = stage(nodes.select(F.monotonically_increasing_id().alias("node"), "key", cell.alias("cell"), "unit", "n", "least"), "nodes")
    found = search_all(shards(nodes, shard), threshold)
    counts = found.where("kind = 0").groupBy("node").agg(F.sum("other").alias("more"))
    roots = components(found.where("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of = nodes.select("node", "key", "n", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").join(counts, "node", "left")
    of = stage(of.select("key", "component_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")), "linked")
    out = rows.select("vec_id", "key").join(of, "key", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def audit_recall(vectors: DataFrame, found: DataFrame, threshold: float = 0.98, every: int = 100) -> DataFrame:
    """(queries, links, found_links, recall) over the query rows whose vec_id ``every`` divides, against all rows, by brute force.

    Both are packed into blocks by label; each block of queries meets each block of its label's rows as one product of matrices.
    Blocks are of bounded size, so neither rows nor queries of a label go to one task. ``found`` is what
    :func:`near_duplicates` returned. Rows that have no links by contract aren't asked.
    """
    rows = with_units(vectors).where("vec_id is not null and label is not null and unit is not null")
    cell = F.concat_ws(":", F.octet_length("unit").cast("string"), "label")

    def blocks(df: DataFrame, size: int) -> DataFrame:
        def run(batches):
            for b in batches:
                cells, ids, units = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_pylist()
                by: dict[str, list[int]] = {}
                for k, c in enumerate(cells):
                    by.setdefault(c, []).append(k)
                for c, own in by.items():
                    for lo in range(0, len(own), size):
                        part = own[lo : lo + size]
                        yield pa.record_batch({"cell": pa.array([c]), "ids": pa.array([ids[part].tobytes()], pa.binary()), "units": pa.array([b"".join([units[k] for k in part])], pa.binary())})

        dealt = df.select(cell.alias("cell"), "vec_id", "unit").sortWithinPartitions("cell")
        return dealt.mapInArrow(run, "cell string, ids binary, units binary")

    asked = blocks(rows.where(F.col("vec_id") % every == 0).repartition("label"), 1024)
    pairs = blocks(rows, 4096).join(asked.select("cell", F.col("ids").alias("q"), F.col("units").alias("v")), "cell").select("ids", "units", "q", "v")

    def count(batches):
        for b in batches:
            for ids, units, q, v in zip(*(b.column(k).to_pylist() for k in range(4))):
                ids, q = np.frombuffer(ids, np.int64), np.frombuffer(q, np.int64)
                x, y = np.frombuffer(units).reshape(len(ids), -1), np.frombuffer(v).reshape(len(q), -1)
                near = ((y @ x.T) >= threshold).sum(axis=1)
                yield pa.record_batch({"vec_id": pa.array(q), "near": pa.array(near.astype(np.int64))})

    # a row meets itself once; several rows of one vec_id are asked together
    exact = pairs.mapInArrow(count, "vec_id long, near long").groupBy("vec_id").agg(F.sum("near").alias("near"))
    mine = found.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.sum(F.col("n_links") + 1).alias("mine"), F.count("*").alias("rows"))
    both = exact.join(mine, "vec_id").select(F.col("rows"), (F.col("near") - F.col("rows")).alias("links"), (F.col("mine") - F.col("rows")).alias("found"))
    return both.agg(F.sum("rows").alias("queries"), F.sum("links").alias("links"), F.sum("found").alias("found_links"), F.try_divide(F.sum("found"), F.sum("links")).alias("recall"))
