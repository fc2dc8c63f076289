"""SimHash near-duplicates by multi-index hashing.

Each text gets a SimHash over its word shingles. Two searches use it.

:func:`simhash_components` links fingerprints of 64 bits at a radius of 3 at most. A fingerprint has two 32-bit segments,
of which one agrees up to one bit: every fingerprint enters the table under its two segment values and looks
up the 32 one-bit neighbours of each. Complete distances verify all matches, so no link is lost.

:func:`near_duplicates` links texts by the similarity of their shingles. A similarity of 0.8 leaves 15 % of the bits different, so
no few segments are sure to agree: fingerprints have 256 bits, and each enters a number of tables under all values of the ball of one
bit around a segment; two such balls share a value where the segments differ in two bits at most. The width of the segments
follows from the number of fingerprints, so that a value has a few at any size, and the number of tables from the
width, so that a pair at the similarity meets with the wanted probability. Chains of meetings within the radius make candidate
groups. Those that near distances alone don't join are dealt in blocks of texts, block against block, where every pair within
the radius is settled: by its distance, or by the exact similarity of its shingles. An edge stands for others only once it is settled.

Texts with one fingerprint count once: only distinct fingerprints take part in the search, and
each bucket of the table answers with a spanning tree of its links, never with all its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, ceil, comb, floor, log, pi, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, lean, mix64, n_groups, packed, packed_schema, stage, unpacked

#: Groups of up to so many fingerprints are compared as a whole.
SMALL = 256
#: 64-bit words of a fingerprint of the wide search.
WORDS = 4
#: Bytes of shingles in a block of texts that are compared exactly, and the least that a text counts for.
BLOCK, LEAST = 8 << 20, 8 << 10


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    norm = b" ".join(words)
    if len(words) < width:
        return np.array([digest(norm, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = len(words) - width + 1
    return np.fromiter((digest(norm[s:e], seed) for s, e in zip(starts[:last].tolist(), ends[width - 1 :].tolist())), np.uint64, last)


def fingerprint(hashes: np.ndarray, words: int = 1, block: int = 255 * 16) -> np.ndarray:
    """``words`` numbers of 64 bits; bit k is 1 if it is set in over half of ``hashes``, 0 for none. Further words mix the hashes."""
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block]
        every = np.stack([part, *(mix64(part + np.full(1, word, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for word in range(1, words))], axis=1)
        bits = np.unpackbits(every.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1)
        for k in range(0, len(bits), 255):  # as many as a byte can count
            total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes)).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, words: int = 1) -> DataFrame:
    """(doc_id, hash of the text, fp0 long, fp1 ...): lower-case of A-Z only, words ``[^\\x20\\x09-\\x0D]+``, shingles with repeats."""

    def run(batches):
        for b in batches:
            fps = np.zeros((len(b), words), np.uint64)
            for k, t in enumerate(b.column(2).to_pylist()):
                fps[k] = fingerprint(shingle_hashes(t, width, seed), words)
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(words))], names=["doc_id", "text_hash", *_names(words)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, ", ".join(["doc_id long", "text_hash long", *(f"{x} long" for x in _names(words))]))


def _names(words: int) -> list[str]:
    return [f"fp{k}" for k in range(words)]


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether 64-bit fingerprints are near, with broadcasting."""
    return np.bitwise_count(a ^ b) <= radius


def spanning(x: np.ndarray, own: int, radius: int) -> np.ndarray:
    """For each fingerprint in ``x`` the least place it is linked to by chains; only links with one of the first ``own`` count.

    Small groups are compared as a whole. Large ones are split again: within a radius of 3 one of four 16-bit blocks agrees.
    """
    n = len(x)
    if n <= SMALL or radius > 3:
        return _spanning(x, own, radius)
    label = np.arange(n)
    a, b = [], []
    for k in range(4):
        block = (x >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        order = np.argsort(block, kind="stable")  # places stay in order: own ones first
        cut = np.flatnonzero(block[order][1:] != block[order][:-1]) + 1
        for part in np.split(order, cut):
            mine = int((part < own).sum())
            if len(part) > 1 and mine:
                found = part[_spanning(x[part], mine, radius)]
                a.append(part[found != part])
                b.append(found[found != part])
    a, b = (np.concatenate(y) if y else np.zeros(0, np.int64) for y in (a, b))
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _spanning(x: np.ndarray, own: int, radius: int) -> np.ndarray:
    """:func:`spanning` by comparing. In large groups each member looks only at those that none has reached yet."""
    n = len(x)
    label = np.arange(n)
    if n <= SMALL:
        near = _near(x[:own, None], x[None, :], radius)
        if int(near.sum()) == own:
            return label
        while True:
            low = np.where(near, label[None, :], n).min(axis=1)
            new = label.copy()
            new[:own] = np.minimum(new[:own], low)
            new = np.minimum(new, np.where(near, new[:own, None], n).min(axis=0))
            if (new == label).all():
                return label
            label = new
    left = np.arange(n)
    while len(left):
        todo = [int(left[0])]
        root, left = todo[0], left[1:]
        while todo and len(left):
            u = todo.pop()
            near = _near(x[u], x[left], radius)
            if u >= own:
                near &= left < own
            found = left[near]
            label[found] = root
            todo += found.tolist()
            left = left[~near]
    return label


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links that span the components of distinct fingerprints ``fps`` (fp0 long)."""
    if radius > 3:
        raise ValueError("radius is 3 at most")
    bits = 32
    nb = n_groups(fps, 16)
    codes = np.arange(2 * (bits + 1), dtype=np.int64)

    def keys(fp: np.ndarray, code: np.ndarray) -> np.ndarray:
        """(segment, value) as one number; code: bits + 1 a segment, 0 the value itself, k the one with bit k - 1 flipped."""
        seg, flip = code // (bits + 1), code % (bits + 1)
        value = (fp >> (seg * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
        mask = np.where(flip > 0, np.uint64(1) << np.maximum(flip - 1, 0).astype(np.uint64), np.uint64(0))
        return (value ^ mask) | (seg.astype(np.uint64) << np.uint64(32))

    def probes(batches):
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 10_000):
                part = np.repeat(every[at : at + 10_000], len(codes))
                code = np.tile(codes, len(part) // len(codes))
                bucket = mix64(keys(part, code)) % np.uint64(nb)
                yield from packed(bucket.astype(np.int64), [part, code.astype(np.uint8)])

    def verify(t: pa.Table) -> pa.Table:
        fp, code = unpacked(t["n"].to_pylist(), t["payload"].to_pylist(), [np.uint64, np.uint8])
        code = code.astype(np.int64)
        key, probe = keys(fp, code), code % (bits + 1) > 0
        order = np.lexsort((probe, key))
        x, key, probe = fp[order], key[order], probe[order]
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1)) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, n in zip(*(y[(sizes > 1) & ~probe[starts]].tolist() for y in (starts, sizes))):
            every = x[s : s + n]
            label = spanning(every, n - int(probe[s : s + n].sum()), radius)
            moved = np.flatnonzero(label != np.arange(n))
            a.append(every[moved].view(np.int64))
            b.append(every[label[moved]].view(np.int64))
        a, b = np.concatenate(a), np.concatenate(b)
        links = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    rows = fps.select("fp0").mapInArrow(probes, packed_schema())
    return rows.groupBy("bucket").applyInArrow(verify, "a long, b long")


def simhash_components(docs: DataFrame, width: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp, component_id (least doc_id of its component).

    Fingerprints of 64 bits link at ``radius`` or fewer differing bits. A null text counts as empty; texts without words have
    fingerprint zero and link like any other. Repeated rows keep a row each. A null doc_id takes part but is never the least one.
    An empty table gives no rows; further columns are not read.
    """
    lean(docs.sparkSession)
    own = stage(fingerprints(docs, width, seed), "fingerprints")
    distinct = stage(own.groupBy("fp0").agg(F.min("doc_id").alias("first_doc")), "distinct-fp")
    roots = components(fingerprint_links(distinct, radius))
    of = _with_first(distinct.withColumn("node", F.col("fp0")), roots, ["fp0"])
    return own.join(of, "fp0").select("doc_id", F.col("fp0").alias("fp"), "component_id")


def _with_first(nodes: DataFrame, roots: DataFrame, by: list[str]) -> DataFrame:
    """(*by, component_id) of ``nodes`` (*by, node, first_doc) and their ``roots``."""
    of = nodes.join(roots, "node", "left").select(*by, "first_doc", F.coalesce("root", "node").alias("root"))
    # staged, so that the join has plain exchanges on both sides and a component of very many nodes can be split
    first = stage(of.groupBy("root").agg(F.min("first_doc").alias("component_id")), "first-docs")
    return stage(of.join(first, "root").select(*by, "component_id"), "components")


@dataclass(frozen=True)
class Plan:
    """How the wide search goes: ``tables`` segments of ``width`` bits; up to ``sure`` differing bits link, over ``radius`` never do."""

    width: int
    tables: int
    sure: int
    radius: int

    @staticmethod
    def of(n: int, similarity: float, recall: float) -> Plan:
        """For ``n`` fingerprints: a pair at ``similarity`` is looked at with probability ``recall``, and again lies within the radius."""
        q, m = acos(2 * similarity / (1 + similarity)) / pi, 64 * WORDS
        width = min(32, max(16, ceil(log(max(n, 2), 2)) - 2))
        meet = sum(comb(width, k) * q**k * (1 - q) ** (width - k) for k in range(3))
        off = NormalDist().inv_cdf(recall) * sqrt(m * q * (1 - q))
        return Plan(width, ceil(log(1 - recall) / log(1 - meet)), floor(m * q - off), ceil(m * q + off))

    def places(self) -> np.ndarray:
        """The bits of each table's segment: disjoint as long as the fingerprint has enough, then shuffled anew."""
        rng, out = np.random.default_rng(64), []
        while len(out) < self.tables:
            order = rng.permutation(64 * WORDS)
            out += [order[k : k + self.width] for k in range(0, 64 * WORDS - self.width + 1, self.width)]
        return np.array(out[: self.tables])


def _tree(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, distance) of a spanning forest of the links within ``radius`` among the rows of ``x``; the nearest ones in small groups."""
    n = len(x)
    a, b, d = [], [], []
    if n <= SMALL:
        far = np.bitwise_count(x[:, None, :] ^ x[None, :, :]).sum(axis=2, dtype=np.int32)
        some = np.flatnonzero((far <= radius).sum(axis=1) > 1)
        if not len(some):
            return (np.zeros(0, np.int64),) * 3
        far = far[np.ix_(some, some)]
        open_, near, parent = np.ones(len(some), bool), far[0].copy(), np.zeros(len(some), np.int64)
        open_[0] = False
        for _ in range(len(some) - 1):
            u = int(np.where(open_, near, 1 << 20).argmin())
            open_[u] = False
            if near[u] <= radius:
                a.append(some[u])
                b.append(some[parent[u]])
                d.append(near[u])
            nearer = far[u] < near
            near[nearer], parent[nearer] = far[u][nearer], u
        return np.array(a, np.int64), np.array(b, np.int64), np.array(d, np.int64)
    left = np.arange(n)
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            u = todo.pop()
            far = np.bitwise_count(x[left] ^ x[u]).sum(axis=1, dtype=np.int64)
            hit = far <= radius
            found = left[hit]
            a.append(found)
            b.append(np.full(len(found), u))
            d.append(far[hit])
            todo += found[np.argsort(-far[hit], kind="stable")].tolist()
            left = left[~hit]
    return tuple(np.concatenate(y) if y else np.zeros(0, np.int64) for y in (a, b, d))


def _leading_zeros(x: np.ndarray) -> np.ndarray:
    """Zero bits above the highest one of 64-bit numbers; 63 for 0."""
    y = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        y |= y >> np.uint64(k)
    return (np.uint64(64) - np.maximum(np.bitwise_count(y), 1).astype(np.uint64)).astype(np.uint64)


def wide_links(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(a, b, d): links of ``nodes`` (node, fp0, ...) within the plan's radius, each bucket's as a spanning forest.

    The links up to ``sure`` bits span by themselves what such links join; they are in a small bucket's nearest tree anyway.
    """
    nb = n_groups(nodes, 16)
    places, per = plan.places(), plan.width + 1
    codes = np.arange(plan.tables * per, dtype=np.int64)

    def values(fps: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(fps), np.uint64)
        for j, bit in enumerate(places[table].tolist()):
            out |= ((fps[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)) << np.uint64(j)
        return out

    def keys(fps: np.ndarray, code: np.ndarray) -> np.ndarray:
        """(table, value) as one number; code: a place for each value of the ball, 0 the value itself."""
        out = np.zeros(len(fps), np.uint64)
        for table in np.unique(code // per).tolist():
            own = np.flatnonzero(code // per == table)
            flip = code[own] % per
            mask = np.where(flip > 0, np.uint64(1) << np.maximum(flip - 1, 0).astype(np.uint64), np.uint64(0))
            out[own] = (values(fps[own], table) ^ mask) | np.uint64(table << 32)
        return out

    def first_meeting(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
        """Whether pairs of fingerprints meet under ``key`` and under no key before it.

        A link need not be told where an earlier bucket has both: there they are in one tree already.
        """
        table, value = key >> 32, np.uint64(key & 0xFFFFFFFF)
        first = np.ones(len(a), bool)
        for t in range(table):
            first &= np.bitwise_count(values(a, t) ^ values(b, t)) > 2
        x, y = values(a, table), values(b, table)
        low = np.minimum(x, y)  # of the values that both balls hold
        differ = x ^ y
        bit = differ & (~differ + np.uint64(1))
        two = np.bitwise_count(differ) == 2
        low[two] = np.minimum(x ^ bit, x ^ (differ ^ bit))[two]
        same = differ == 0
        top = np.uint64(1) << np.uint64(63) >> _leading_zeros(x)
        low[same] = np.where(x > 0, x ^ top, x)[same]
        return first & (low == value)

    def probes(batches):
        for b in batches:
            every = np.stack([b.column(k).to_numpy().view(np.uint64) for k in range(WORDS)], axis=1)
            for at in range(0, len(every), 4000):
                part = every[at : at + 4000]
                key = np.empty((len(part), len(codes)), np.uint64)
                flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(plan.width, dtype=np.uint64)))
                for table in range(plan.tables):
                    key[:, table * per : (table + 1) * per] = (values(part, table)[:, None] ^ flips) | np.uint64(table << 32)
                bucket = (mix64(key.ravel()) % np.uint64(nb)).astype(np.int64)
                row = np.repeat(np.arange(len(part)), len(codes))
                yield from packed(bucket, [*(part[row, k] for k in range(WORDS)), np.tile(codes, len(part)).astype(np.uint16)])

    def verify(t: pa.Table) -> pa.Table:
        *fps, code = unpacked(t["n"].to_pylist(), t["payload"].to_pylist(), [*[np.uint64] * WORDS, np.uint16])
        x = np.stack(fps, axis=1)
        key = keys(x, code.astype(np.int64))
        order = np.argsort(key, kind="stable")
        x, key = x[order], key[order]
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1)) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        found = [np.zeros((0, 3), np.int64)]
        for s, n in zip(*(y[sizes > 1].tolist() for y in (starts, sizes))):
            part = x[s : s + n]
            a, b, d = (np.concatenate(y) for y in zip(*(_tree(part, r) for r in ((plan.radius,) if n <= SMALL else (plan.sure, plan.radius)))))
            if len(a):
                first = first_meeting(x[s + a], x[s + b], int(key[s]))
                a, b, d = node(x[s + a[first]]), node(x[s + b[first]]), d[first]
                found.append(np.stack((np.minimum(a, b), np.maximum(a, b), d), axis=1))
        links = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": links[:, 0], "b": links[:, 1], "d": links[:, 2]})

    rows = nodes.select(*_names(WORDS)).mapInArrow(probes, packed_schema())
    return rows.groupBy("bucket").applyInArrow(verify, "a long, b long, d long").distinct()


def node(x: np.ndarray) -> np.ndarray:
    """Ids of fingerprints, a row each."""
    out = np.zeros(len(x), np.uint64)
    for k in range(x.shape[1]):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + x[:, k] + np.full(1, k + 1, np.uint64))
    return out.view(np.int64)


def _with_node(batches):
    for b in batches:
        x = np.stack([b.column(k).to_numpy().view(np.uint64) for k in range(WORDS)], axis=1)
        yield pa.record_batch([*b.columns, pa.array(node(x))], names=[*b.schema.names, "node"])


def shingle_sets(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """(node, shingles): the sorted set of shingle hashes of each of the ``texts`` (node, text)."""

    def sets(batches):
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.record_batch({"node": pa.array([k], pa.int64()), "shingles": pa.array([np.unique(shingle_hashes(text, width, seed)).tobytes()], pa.binary())})

    return texts.mapInArrow(sets, "node long, shingles binary")


def settle(fps: np.ndarray, sets: list[np.ndarray], group: np.ndarray, block: np.ndarray, plan: Plan, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links that join the texts of two blocks as all their links across the blocks do; of one block, all its links.

    ``group`` names what is joined already; pairs within a group aren't looked at. A pair links at ``plan.sure`` differing bits
    or fewer, up to ``plan.radius`` if the ``sets`` have the Jaccard ``similarity``.
    """
    label = np.unique(group, return_inverse=True)[1]
    blocks = np.unique(block)
    left, right = np.flatnonzero(block == blocks[0]), np.flatnonzero(block == blocks[-1])
    sizes = np.array([len(x) for x in sets], np.int64)
    entries = np.concatenate([sets[k] for k in right])
    owner = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(entries, kind="stable")
    entries, owner = entries[order], owner[order]
    out_a, out_b = [], []
    for i in left.tolist():
        apart = label[right] != label[i]
        if not apart.any():
            continue
        far = np.bitwise_count(fps[right] ^ fps[i]).sum(axis=1, dtype=np.int64)
        hit = apart & (far <= plan.sure)
        if (apart & ~hit & (far <= plan.radius)).any():
            lo, hi = np.searchsorted(entries, sets[i], "left"), np.searchsorted(entries, sets[i], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(right))
            hit |= apart & (far <= plan.radius) & (both >= similarity * (sizes[right] + sizes[i] - both) - 1e-9)
        for j in right[hit].tolist():
            if label[i] != label[j]:
                out_a.append(i)
                out_b.append(j)
                label[label == label[j]] = label[i]
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def settled_links(groups: DataFrame, nodes: DataFrame, shingles: DataFrame, plan: Plan, similarity: float) -> DataFrame:
    """Links (a, b) that settle candidate ``groups`` (node, grp, root), root: what near links join already.

    Texts are dealt to blocks of about ``BLOCK`` bytes: small groups share one, large ones have several, and a root that fills
    blocks has them for itself, so that two blocks of one root needn't meet. Each other two blocks of a group meet in one task, which
    holds both; a text travels once for each block of its group. Links come as a spanning forest, never as all pairs.
    """
    names = _names(WORDS)
    rows = groups.join(nodes.select("node", *names), "node").join(shingles, "node")
    rows = stage(rows.withColumn("w", F.greatest(F.lit(LEAST), F.length("shingles"))), "doubtful-texts")
    size = rows.groupBy("grp").agg(F.sum("w").alias("w_grp"))
    bins = max(1, ceil((size.where(F.col("w_grp") < BLOCK).agg(F.sum("w_grp")).first()[0] or 0) / BLOCK))
    of_root = rows.groupBy("grp", "root").agg(F.sum("w").alias("w_root")).join(size, "grp")
    bin_ = F.when(F.col("w_grp") < BLOCK, F.pmod(F.xxhash64("grp", F.lit(1)), F.lit(bins))).otherwise(F.col("grp"))
    small = F.sum(F.when(F.col("w_root") < BLOCK, F.col("w_root")))
    of_root = of_root.withColumn("bin", F.struct((F.col("w_grp") < BLOCK).alias("shared"), bin_.alias("id")))
    parts = of_root.groupBy("bin").agg(F.ceil(F.coalesce(small, F.lit(0)) / BLOCK).alias("parts"))
    of_root = of_root.join(parts, "bin").select("grp", "root", "bin", "parts", F.when(F.col("w_root") >= BLOCK, F.ceil(F.col("w_root") / BLOCK)).alias("own"))
    block = F.when(F.col("own").isNotNull(), F.xxhash64("root", F.pmod(F.xxhash64("node", F.lit(2)), "own"))).otherwise(F.pmod(F.xxhash64("root", F.lit(3)), "parts"))
    rows = stage(rows.join(of_root, ["grp", "root"]).select("bin", block.alias("block"), "node", "root", *names, "shingles"), "text-blocks")
    blocks = stage(rows.groupBy("bin", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")), "blocks")
    x, y = (blocks.select("bin", *[F.col(c).alias(f"{c}_{k}") for c in ("block", "lo", "hi")]) for k in "xy")
    one_root = (F.col("lo_x") == F.col("hi_x")) & (F.col("lo_y") == F.col("hi_y")) & (F.col("lo_x") == F.col("lo_y"))
    meet = x.join(y, "bin").where((F.col("block_x") <= F.col("block_y")) & ~one_root)
    meet = meet.select("bin", "block_x", "block_y", F.explode(F.array_distinct(F.array("block_x", "block_y"))).alias("block"))

    def compare(t: pa.Table) -> pa.Table:
        fps = np.stack([t[c].to_numpy().view(np.uint64) for c in names], axis=1)
        sets = [np.frombuffer(s, np.uint64) for s in t["shingles"].to_pylist()]
        a, b = settle(fps, sets, t["root"].to_numpy(), t["block"].to_numpy(), plan, similarity)
        ids = t["node"].to_numpy()
        return pa.table({"a": ids[a], "b": ids[b]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    dealt = rows.join(meet, ["bin", "block"])
    return dealt.groupBy("bin", "block_x", "block_y").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.97, seed: int = 42) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, component_id (least doc_id of its group).

    Texts whose sets of ``width``-word shingles have at least that Jaccard ``similarity`` link; groups follow chains of links. A pair at the
    similarity meets with probability ``recall``, and as often its distance lies within the radius; nearer ones are nearly sure.
    Links of a distance that leaves no doubt are taken as they are, all others only after an exact comparison. Texts of one
    candidate group that no near links join are all compared within the radius, so their work is quadratic in their number, dealt by blocks.

    A null text counts as empty; texts without words are alike. Repeated rows keep a row each. A null doc_id takes part but is never
    the least one. An empty table gives no rows; further columns are not read.
    """
    lean(docs.sparkSession)
    names = _names(WORDS)
    own = stage(fingerprints(docs, width, seed, WORDS), "fingerprints")
    first = F.min(F.struct("doc_id", "text_hash")).alias("rep")
    distinct = own.groupBy(*names).agg(F.min("doc_id").alias("first_doc"), first)
    kinds = ", ".join([*(f"{x} long" for x in names), "first_doc long", "rep struct<doc_id: bigint, text_hash: bigint>", "node long"])
    distinct = stage(distinct.mapInArrow(_with_node, kinds), "distinct-fp")
    plan = Plan.of(distinct.count(), similarity, recall)
    links = stage(wide_links(distinct, plan), "near-links")
    sure = links.where(F.col("d") <= plan.sure).select("a", "b")
    candidates, near = components(links.select("a", "b")), components(sure)
    groups = candidates.withColumnRenamed("root", "grp").join(near, "node", "left").select("node", "grp", F.coalesce("root", "node").alias("root"))
    groups = stage(groups, "candidate-groups")
    open_ = groups.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("grp")
    groups = stage(groups.join(open_, "grp", "left_semi"), "open-groups")
    reps = distinct.join(groups, "node", "left_semi").select("node", F.col("rep.doc_id").alias("id"), F.col("rep.text_hash").alias("h"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")
    texts = texts.join(reps, texts["id"].eqNullSafe(reps["id"]) & (texts["h"] == reps["h"])).select("node", "text").dropDuplicates(["node"])
    linked = sure.unionByName(settled_links(groups, distinct, shingle_sets(texts, width, seed), plan, similarity))
    of = _with_first(distinct.select("node", "first_doc", *names), components(linked), names)
    return own.join(of, names).select("doc_id", "component_id")
