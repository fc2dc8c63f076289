"""Benchmark decontamination by SimHash of item-sized windows and multi-index Hamming blocks.

A window of a document has as many words as an item. Its 64-bit SimHash over five-word shingles
is looked up in a table of the items' fingerprints: eight blocks of eight bits, each probed
with all values within floor(radius / 8) bits, so every item within ``radius`` is found. A pair counts if
the exact weighted Jaccard similarity of its shingles is at least ``similarity``.

Windows are placed where they can match. A pair of similarity s shares at least s / (1 + s) of the shingles
of window and item together, so a window is fingerprinted if it holds that many shingles of items of
its size, each counted at most as often as one such item has it. The order of the shingles does not
matter: passages whose sentences were moved are found too. The Hamming radius is the one approximation.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64
from .repeats import grouped
from .words import normal_words, shingles

#: Starts of windows that are fingerprinted at once.
STARTS = 4096
#: Items of a block that is sent to the executors at once: at most about this many bytes of text.
BLOCK_BYTES = 8 << 20
BLOCKS, BITS = 8, 8


def simhash(hashes: np.ndarray) -> int:
    """Weighted SimHash: repeated shingles count each time; a bit is 1 if set in over half."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


def simhashes(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """:func:`simhash` of hashes[lo:hi] for each pair, from running sums of the bits."""
    out = np.zeros(len(lo), np.uint64)
    for k in range(64):
        sums = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum((hashes >> np.uint64(k)) & np.uint64(1), out=sums[1:])
        out |= ((sums[hi] - sums[lo]) * 2 > hi - lo).astype(np.uint64) << np.uint64(k)
    return out


def similarity_of(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two shingle bags."""
    both = sum(min(n, b[x]) for x, n in a.items())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


class Items:
    """The items of a block: shingles with their places, fingerprints, and the Hamming block table."""

    def __init__(self, items: list[tuple[int, str]], width: int, radius: int):
        self.width, self.radius = width, radius
        self.ids, self.sizes, self.bags, fps = [], [], [], []
        # shingle width -> window size -> shingle -> the most times that an item of that size has it
        most: dict[int, dict[int, dict[int, int]]] = {}
        for item, text in items:
            words = normal_words([text or ""])[0]
            if not len(words):
                continue
            w = min(width, len(words))
            h = shingles(words, w)
            self.ids.append(item)
            self.sizes.append(len(words))
            self.bags.append(Counter(h.tolist()))
            fps.append(simhash(h))
            of = most.setdefault(w, {}).setdefault(len(words), {})
            for x, n in self.bags[-1].items():
                of[x] = max(n, of.get(x, 0))
        self.fps = np.array(fps, np.uint64)
        self.sorted = {w: np.array(sorted(set().union(*of.values())), np.uint64) for w, of in most.items()}
        # by width and window size: the places of the shingles in ``sorted``, in order, and their counts
        self.most = {w: {n: self._most(self.sorted[w], x) for n, x in sorted(of.items())} for w, of in most.items()}
        self.maybe = {}
        for w, keys in self.sorted.items():
            self.maybe[w] = np.zeros(1 << 20, bool)
            self.maybe[w][keys >> np.uint64(44)] = True
        near = radius // BLOCKS
        values = np.arange(1 << BITS, dtype=np.uint64)
        self.table = []
        for k in range(BLOCKS):
            own = (self.fps >> np.uint64(BITS * k)) & np.uint64(255)
            self.table.append([np.flatnonzero(np.bitwise_count(own ^ v) <= near) for v in values])

    @staticmethod
    def _most(keys: np.ndarray, of: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, np.array(list(of), np.uint64))
        order = np.argsort(at)
        return at[order], np.array(list(of.values()), np.int64)[order]

    def within(self, fp: int) -> np.ndarray:
        """Items whose fingerprints are within the radius."""
        found = np.unique(np.concatenate([self.table[k][(fp >> (BITS * k)) & 255] for k in range(BLOCKS)]))
        return found[np.bitwise_count(self.fps[found] ^ np.uint64(fp)) <= self.radius]

    def maybe_in(self, words: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Which of the documents, that have ``count`` of the ``words`` each, share a shingle with an item."""
        last = np.cumsum(count)
        found = np.zeros(len(count), bool)
        for w, keys in self.sorted.items():
            h = shingles(words, w)
            hits = np.flatnonzero(self.maybe[w][h >> np.uint64(44)])
            hits = hits[np.isin(h[hits], keys)]
            owner = np.searchsorted(last, hits, "right")
            found[owner[hits + w <= last[owner]]] = True
        return found

    def found(self, column: pa.Array, similarity: float):
        """(row, matches) of the rows of a batch that may have some."""
        texts = [t or "" for t in column.to_pylist()]
        for lo, hi in grouped([len(t) for t in texts]):
            words, count = normal_words(texts[lo:hi])
            end = np.cumsum(count)
            for k in np.flatnonzero(self.maybe_in(words, count)).tolist():
                yield lo + k, self.matches(words[end[k] - count[k] : end[k]], similarity)

    def matches(self, words: np.ndarray, similarity: float) -> dict[int, tuple[float, int, int]]:
        """item index -> best (similarity, start word, window size) in a document."""
        best: dict[int, tuple[float, int, int]] = {}
        for w, keys in self.sorted.items():
            h = shingles(words, w)
            if not len(h):
                continue
            hits = np.flatnonzero(self.maybe[w][h >> np.uint64(44)])
            hits = hits[np.isin(h[hits], keys)]
            if not len(hits):
                continue
            keyed = np.searchsorted(keys, h[hits])
            for n, (own, most) in self.most[w].items():
                for start, fp in self.windows(h, hits, keyed, own, most, n - w + 1, similarity):
                    near = [i for i in self.within(fp).tolist() if self.sizes[i] == n]
                    if not near:
                        continue
                    lo, hi = max(0, start), min(len(words), start + n)
                    bag = Counter(h[lo : hi - w + 1].tolist())
                    for i in near:
                        s = similarity_of(bag, self.bags[i])
                        if s >= similarity and (i not in best or (-s, lo) < (-best[i][0], best[i][1])):
                            best[i] = (s, lo, hi - lo)
        return best


    @staticmethod
    def windows(h: np.ndarray, hits: np.ndarray, keyed: np.ndarray, own: np.ndarray, most: np.ndarray, size: int, similarity: float):
        """(start, fingerprint) of the windows of ``size`` shingles that hold enough of ``own`` ones; borders of the text clip them."""
        at = np.minimum(np.searchsorted(own, keyed), len(own) - 1)
        mine = own[at] == keyed
        places, at = hits[mine], at[mine]
        # a window of m shingles needs s / (1 + s) of m + size, and has at least s of size itself
        if len(places) < similarity * size - 1e-9:
            return
        # a place counts for the starts after the one ``most`` places of its shingle before, so that more of it don't count
        order = np.lexsort((places, at))
        before = np.full(len(places), -size, np.int64)
        ranks, limit = np.arange(len(order)), most[at[order]]
        back = np.maximum(ranks - limit, 0)
        same = (ranks >= limit) & (at[order][back] == at[order])
        before[order[same]] = places[order][back[same]]
        first = np.maximum(before, places - size) + 1
        turns, where = np.unique(np.concatenate((first, places + 1)), return_inverse=True)
        n = len(places)
        held = np.cumsum(np.bincount(where[:n], minlength=len(turns)) - np.bincount(where[n:], minlength=len(turns)))
        for k in np.flatnonzero(held >= similarity * size - 1e-9).tolist():
            for a in range(int(turns[k]), int(turns[k + 1]), STARTS):
                starts = np.arange(a, min(a + STARTS, int(turns[k + 1])))
                lo, hi = np.maximum(starts, 0), np.minimum(starts + size, len(h))
                enough = held[k] >= similarity / (1 + similarity) * (hi - lo + size) - 1e-9
                if enough.any():
                    starts, lo, hi = starts[enough], lo[enough], hi[enough]
                    yield from zip(starts.tolist(), simhashes(h[lo[0] : hi[-1]], lo - lo[0], hi - lo[0]).tolist())


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 23) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): one row per row of ``docs`` and item that it holds.

    Words are runs of letters and digits, lower-cased; items of under ``width`` words count as one
    shingle; items and texts without words, or null, match nothing. The best window stands for a pair,
    the first one on ties. Items go to the executors in blocks of bounded size, each against
    all documents. Repeated documents give rows each; so do repeated items. Very long texts are searched whole. An empty table
    of documents or of items gives no rows; further columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, similarity double, start_word int, n_words int"
    target = _arrow(docs.schema["doc_id"], benchmark.schema["item_id"])
    out = None
    for shared in _blocks(benchmark, width, radius):

        def run(batches, shared=shared):
            for b in batches:
                ids = b.column(0).to_pylist()
                rows = [(ids[k], shared.value.ids[i], *found[i]) for k, found in shared.value.found(b.column(1), similarity) for i in sorted(found)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out


def _blocks(benchmark: DataFrame, width: int, radius: int):
    """The items as broadcast blocks of bounded size; one at least."""
    spark = lean(benchmark.sparkSession)
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield spark.sparkContext.broadcast(Items([tuple(r) for r in block.collect()], width, radius))


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 23) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are; each row is judged by itself.

    Null texts and such without words hold none and stay; so does every row where there are no items. An empty table stays empty.
    """
    at = docs.columns.index("text")
    for shared in _blocks(benchmark, width, radius):

        def run(batches, shared=shared):
            for b in batches:
                clean = np.ones(len(b), bool)
                clean[[k for k, found in shared.value.found(b.column(at), similarity) if found]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def _arrow(doc, item) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([("doc_id", to_arrow_type(doc.dataType)), ("item_id", to_arrow_type(item.dataType)), ("similarity", pa.float64()), ("start_word", pa.int32()), ("n_words", pa.int32())])
