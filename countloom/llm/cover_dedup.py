r"""Substring dedup of word windows by difference-cover anchors.

The positions i of a document whose i modulo 13 lies in the difference cover {0, 1, 3, 9} are anchors.
For any two positions there is a shift k < 13 that takes both to anchors; so two equal windows of 35
words share an aligned pair of anchors, and the 23 words from there on lie in both windows. Only
the hashes of these 23 words at anchors are compared over the corpus, 4 for each 13 words.
Where an anchor is shared, the windows that may hold it are extended to, and those in several places are removed.
Two windows count as one if a rolling hash of their word hashes agrees and so does an XXH3 of their whole bytes, 64 bits
each. Both rest on a seed that is drawn for each run, so no text can be made to collide.
"""

from __future__ import annotations

import functools
import secrets
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import lean, n_groups, packed, packed_schema, stage, unpacked
from .repeats import Task, chunkwise, member, shared_keys, short, sorted_keys, with_chunk
from .words import runs, spans_hash

#: Difference covers by modulus: each difference modulo it arises between two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Windows that a task holds before it sends them.
HELD = 1 << 21
#: Bytes of a word that are hashed by tables; longer words are hashed as a whole.
LONG_WORD = 64
#: Bytes that are split at once, which stay in a processor's cache.
BLOCK = 1 << 15


class WordHashes:
    """Hashes of words: the sum of a random value for each byte at its place, or XXH3 for long ones. Both follow from a seed."""

    def __init__(self, seed: int):
        self.seed = seed
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, *range(0x09, 0x0E)]] = True
        self.value = np.random.default_rng(seed).integers(0, 1 << 64, 256 * LONG_WORD, np.uint64)

    def split(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """The words of ``data``: their starts, sizes and hashes, and all of them joined by single spaces, each followed by one."""
        x = np.frombuffer(data, np.uint8)
        blank = self.blank[x]
        starts, ends = runs(~blank)
        size = ends - starts
        flat = x[~blank]  # the words' bytes, one word after another
        if not len(starts):
            return starts, size, np.zeros(0, np.uint64), b""
        begin = np.cumsum(size) - size
        place = np.arange(len(flat), dtype=np.int32) - np.repeat(begin.astype(np.int32), size)
        short = size <= LONG_WORD
        if not short.all():
            place = np.minimum(place, LONG_WORD - 1)
        sums = np.add.reduceat(self.value[(place << 8) + flat], begin)
        for k in np.flatnonzero(~short).tolist():
            sums[k] = xxhash.xxh3_64_intdigest(flat[begin[k] : begin[k] + size[k]].tobytes(), self.seed)
        joined = np.full(len(flat) + len(starts), 32, np.uint8)
        spaces = np.zeros(len(joined), bool)
        spaces[begin + size + np.arange(len(starts))] = True
        joined[~spaces] = flat
        return starts, size, sums, joined.tobytes()


@functools.lru_cache(1)
def _hashes(seed: int) -> WordHashes:
    """One table a worker and run."""
    return WordHashes(seed)


class Layout:
    """The words of a piece: where its documents begin, and each word's place in its document."""

    def __init__(self, texts: list[bytes], hashes: WordHashes):
        self.seed = hashes.seed
        data = b"\n".join(texts) + b"\n"
        starts, sizes, sums, joined, at = [], [], [], [], 0
        while at < len(data):
            end = min(len(data), at + BLOCK)
            while end < len(data) and data[end - 1] not in b" \t\n\v\f\r":
                end += 1  # a word is never cut
            s, n, h, part = hashes.split(data[at:end])
            starts.append(s + at)
            sizes.append(n)
            sums.append(h)
            joined.append(part)
            at = end
        self.words, self.joined = np.concatenate(sums), b"".join(joined)
        self.ends = np.cumsum(np.concatenate(sizes) + 1) - 1  # of each word in ``joined``
        begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.count = np.diff(np.searchsorted(np.concatenate(starts), begin))
        self.first = np.cumsum(self.count) - self.count
        self.owner = np.repeat(np.arange(len(texts)), self.count)
        self.place = np.arange(len(self.words)) - self.first[self.owner]
        self.left = self.count[self.owner] - self.place

    def hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        """Hash of ``width`` words from each place on."""
        return spans_hash(self.words, at, at + width)

    def digests(self, at: np.ndarray, width: int) -> np.ndarray:
        """XXH3 of the bytes of ``width`` words from each place on, joined by spaces."""
        digest, seed, text = xxhash.xxh3_64_intdigest, self.seed, self.joined
        begin = np.where(at > 0, self.ends[at - 1] + 1, 0)
        return np.fromiter((digest(text[s:e], seed) for s, e in zip(begin.tolist(), self.ends[at + width - 1].tolist())), np.uint64, len(at))


class Cover:
    def __init__(self, window: int):
        self.window = window
        self.modulus = max((m for m in COVERS if 2 * m <= window), default=1)
        self.inner = window - self.modulus + 1
        self.is_anchor = np.isin(np.arange(self.modulus), COVERS.get(self.modulus, (0,)))

    def anchors(self, x: Layout) -> tuple[np.ndarray, np.ndarray]:
        """Places of the anchors of documents with a window at least, and their keys."""
        at = np.flatnonzero(self.is_anchor[x.place % self.modulus] & (x.left >= self.inner) & (x.count[x.owner] >= self.window))
        return at, x.hashes(at, self.inner)

    def windows(self, x: Layout, at: np.ndarray) -> np.ndarray:
        """Starts of all windows that hold one of the anchors ``at`` as a match would."""
        edge = np.zeros(len(x.words) + 1, np.int64)
        np.add.at(edge, at - np.minimum(x.place[at], self.modulus - 1), 1)
        np.add.at(edge, at + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (x.left >= self.window))


def _sent(found: list[tuple[np.ndarray, np.ndarray]], chunk: int, nb: int):
    """A record for each distinct window of a chunk; the chunk is negative, less one, if it has the window twice."""
    a, b = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    many = np.diff(np.concatenate((first, [len(a)]))) > 1
    ref = np.where(many, -chunk - 1, chunk).astype(np.int32)
    yield from packed(((a[first] >> np.uint64(32)) % np.uint64(nb)).astype(np.int64), [a[first], b[first], ref])


def _repeated(t: pa.Table) -> pa.Table:
    """For each chunk its windows that are in several places."""
    a, b, ref = unpacked(t["n"].to_pylist(), t["payload"].to_pylist(), [np.uint64, np.uint64, np.int32])
    order = np.lexsort((b, a))
    a, b, ref = a[order], b[order], ref[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    count = np.diff(np.concatenate((first, [len(a)])))
    hit = np.repeat((np.add.reduceat((ref < 0).astype(np.int64), first) > 0) | (count > 1), count)
    chunk = np.where(ref < 0, -ref - 1, ref)
    batches = list(packed(chunk[hit], [a[hit], b[hit]], key="chunk"))
    return pa.Table.from_batches(batches) if batches else pa.table({"chunk": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "n": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})


SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept string"


def dedup_windows(docs: DataFrame, window: int = 35) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, spans (of removed words), kept.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Each word goes that a window of ``window`` words covers
    whose words also start anywhere else, the same text included; windows are judged on the input. ``kept``
    has the other words joined by one space. A null text has no words; a text of under ``window`` words
    loses none. Repeated rows are places of their own, so they lose their windows. A null doc_id is kept.
    An empty table gives no rows; further columns are not read. A text's word hashes are in
    memory at once, about ten bytes for each byte of it.
    """
    hashes = functools.partial(_hashes, secrets.randbits(64))
    lean(docs.sparkSession)
    chunks, nb = n_groups(docs, 4, most=1 << 22), n_groups(docs, 16, most=1 << 22)
    rows = with_chunk(docs, chunks)
    cover = Cover(window)

    def anchors(texts):
        x = Layout(texts, hashes())
        at, key = cover.anchors(x)
        yield key, x.owner[at]

    shared, _ = shared_keys(rows, anchors, nb)

    class Candidates(Task):
        """Sends the windows at shared anchors, each distinct one of the chunk once."""

        def __init__(self, chunk, payloads):
            self.chunk, self.keys, self.found = chunk, sorted_keys(payloads), []

        def piece(self, doc_ids, texts):
            x = Layout(texts, hashes())
            at, key = cover.anchors(x)
            starts = cover.windows(x, at[member(short(key, nb), self.keys)])
            if len(starts):
                self.found.append((x.hashes(starts, window), x.digests(starts, window)))
            if sum(len(a) for a, _ in self.found) > HELD:
                yield from self.end()

        def end(self):
            if self.found:
                yield from _sent(self.found, self.chunk, nb)
            self.found = []

    places = chunkwise(shared, rows, Candidates, packed_schema())
    again = stage(places.groupBy("bucket").applyInArrow(_repeated, packed_schema("chunk")).select("chunk", "payload"), "repeated-windows")

    class Removal(Task):
        def __init__(self, chunk, payloads):
            parts = [unpacked([len(p) // 16], [p], [np.uint64, np.uint64]) for p in payloads]
            a, b = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
            order = np.argsort(a)
            self.first, self.second = a[order], b[order]

        def starts(self, x: Layout) -> np.ndarray:
            """Starts of the repeated windows."""
            a, b = self.first, self.second
            starts = np.flatnonzero(x.left >= window)
            if not len(a) or not len(starts):
                return starts[:0]
            h = x.hashes(starts, window)
            near = np.flatnonzero(member(h, a))
            at, starts, h = np.searchsorted(a, h[near]), starts[near], h[near]
            second = x.digests(starts, window)
            hit, open_ = np.zeros(len(at), bool), np.arange(len(at))
            while len(open_):  # entries with the same first hash lie side by side
                hit[open_] = b[at[open_]] == second[open_]
                open_ = open_[~hit[open_]]
                at[open_] += 1
                open_ = open_[at[open_] < len(a)]
                open_ = open_[a[at[open_]] == h[open_]]
            return starts[hit]

        def piece(self, doc_ids, texts):
            x = Layout(texts, hashes())
            edge = np.zeros(len(x.words) + 1, np.int64)
            starts = self.starts(x)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            yield kept(x, gone, doc_ids, texts)

    def kept(x, gone, doc_ids, texts):
        out = {"n_removed": [], "spans": [], "kept": []}
        for k, t in enumerate(texts):
            mine = gone[x.first[k] : x.first[k] + x.count[k]]
            words = t.split()
            s, e = runs(mine)
            out["n_removed"].append(int(mine.sum()))
            out["spans"].append([{"start": i, "end": j} for i, j in zip(s.tolist(), e.tolist())])
            out["kept"].append(b" ".join(compress(words, (~mine).tolist()) if len(s) else words))
        return pa.record_batch(
            {
                "doc_id": doc_ids,
                "n_words": pa.array(x.count.astype(np.int64)),
                "n_removed": pa.array(out["n_removed"], pa.int64()),
                "spans": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(out["kept"], pa.binary()).cast(pa.string()),
            }
        )

    return chunkwise(again, rows, Removal, SCHEMA)
