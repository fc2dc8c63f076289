"""Suffix-array dedup of byte strings with a run-length index.

A 50-byte string goes where it also starts in a document with a smaller id. The corpus is dealt to
shards by content: every window of 50 bytes has a minimizer, the 24 bytes within it whose hash is
least, and neighbouring windows with one minimizer form a segment. Equal windows have equal minimizers and so
meet in one shard. Only segments whose minimizer occurs in several places are sent.

A shard builds the Burrows-Wheeler transform of its distinct segments, by their least document, compresses
it to runs and keeps, for each run, the text position of its end before and the match length at
the border. Streamed over the text, these samples give each position its matching statistics: the
longest match with its lexicographic neighbour, and where that is. Matches of 50 bytes or more
are chained; the first text position of a chain names the smallest document that has the window.
"""

from __future__ import annotations

import functools
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, n_groups, packed, packed_schema, stage, unpacked
from .repeats import PIECE, Task, chunkwise, grouped, member, shared_keys, short, sorted_keys, with_chunk
from .words import runs

#: Stands for a null doc_id, which comes after all others.
LAST = np.iinfo(np.int64).max
#: Bytes of segments that a task holds before it sends them.
HELD = 1 << 24
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_ANSWERS = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("payload", pa.binary())])
_RECORD = np.dtype([("key", "<u8"), ("least", "<i8"), ("chunk", "<i4"), ("length", "u1")])
#: Bytes of segments that are indexed at once; sorting more costs more for each byte.
INDEXED = 1 << 20
#: A segment's length and the places in it are held in a byte.
LONGEST = 200


@functools.lru_cache(1)
def _values() -> np.ndarray:
    return np.random.default_rng(50).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def grams(x: np.ndarray, inner: int) -> np.ndarray:
    """Hash of ``inner`` bytes from each place on, put together from powers of two."""
    h, width, out, done = _values()[x], 1, None, 0
    while True:
        if inner & width:
            n = max(0, len(x) - (done + width) + 1)
            out = h[:n].copy() if out is None else out[:n] * _B + h[done : done + n]
            done += width
        if done == inner:
            out ^= out >> np.uint64(32)
            out *= _C
            out ^= out >> np.uint64(29)
            return out
        h = h[: max(0, len(h) - width)] * (_A + np.uint64(2 * width)) + h[width:]
        width *= 2


def minimizers(g: np.ndarray, span: int) -> np.ndarray:
    """For each window the least hash of the ``span`` grams in it."""
    width = 1
    while width < span:
        step = min(width, span - width)
        n = max(0, len(g) - step)
        g = np.minimum(g[:n], g[step:])
        width += step
    return g


class Windows:
    """The windows of a piece of some documents, grouped into runs with one minimizer.

    ``first`` and ``last`` are a run's window starts in ``x``, ``key`` the hash of its minimizer,
    ``text`` its document (an index), ``shift`` what leads from ``x`` to places in that document.
    """

    def __init__(self, blocks: list[tuple[int, int, bytes]], length: int, inner: int):
        self.length, self.inner = length, inner
        self.x = x = np.frombuffer(b"".join([b for _, _, b in blocks]), np.uint8)
        n = max(0, len(x) - length + 1)
        sizes = np.array([len(b) for _, _, b in blocks], np.int64)
        ends = np.cumsum(sizes)
        self.g = grams(x, inner)
        low = minimizers(self.g, length - inner + 1)
        new = np.ones(n, bool)
        np.not_equal(low[1:], low[:-1], out=new[1:])
        begin = ends - sizes
        new[begin[begin < n]] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], n)[: len(first)] - 1
        block = np.searchsorted(ends, first, "right")
        last = np.minimum(last, ends[block] - length)
        long = last - first >= length - inner + 1  # of a text that repeats itself; equal windows keep their key
        if long.any():
            parts = np.where(long, (last - first) // (length - inner + 1) + 1, 1)
            first = np.repeat(first, parts) + (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * (length - inner + 1)
            last = np.minimum(np.repeat(last, parts), first + length - inner)
            block = np.repeat(block, parts)
        ok = first <= last
        self.first, self.last, block = first[ok], last[ok], block[ok]
        self.key = low[self.first]
        self.text = np.array([k for k, _, _ in blocks], np.int64)[block]
        self.shift = (np.array([base for _, base, _ in blocks], np.int64) - begin)[block]

    def content(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Key of the bytes of the segments [first, last + length), from four grams that cover them."""
        end = last + self.length - self.inner
        second, third = np.minimum(first + self.inner, end), np.maximum(end - self.inner, first)
        return mix64(((self.g[first] * _A + self.g[second]) * _B + self.g[third]) * _C + self.g[end] * _D + (last - first).astype(np.uint64))

    def opened(self, which: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, first, last) of segments: the chosen runs, but those with a hot minimizer window by window."""
        single = which[hot[which]]
        n = self.last[single] - self.first[single] + 1
        run = np.repeat(single, n)
        at = self.first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        whole = which[~hot[which]]
        return np.concatenate((whole, run)), np.concatenate((self.first[whole], at)), np.concatenate((self.last[whole], at))


def blocks_of(texts: list[bytes], length: int, size: int = PIECE) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (index, offset, bytes): whole texts, or for very long ones pieces whose windows add up to theirs."""
    held, total = [], 0
    for k, t in enumerate(texts):
        for base in range(0, max(1, len(t) - length + 1), size):
            block = t[base : base + size + length - 1]
            if total and total + len(block) > size:
                yield held
                held, total = [], 0
            held.append((k, base, block))
            total += len(block)
    if held:
        yield held


class RunLengthIndex:
    """The run-length compressed transform of some segments, with samples at the run borders."""

    def __init__(self, segments: np.ndarray, sizes: np.ndarray, least: int):
        """``segments``: their bytes one after another, each followed by a separator (any byte); ``sizes`` without it.

        Match lengths under ``least`` are kept as 0.
        """
        n = len(segments)
        ends = np.cumsum(sizes + 1) - 1
        places = np.arange(n, dtype=np.int32)
        self.rest = rest = np.repeat(ends.astype(np.int32), sizes + 1) - places  # bytes up to the separator
        bits = max(1, n.bit_length())
        code, width = self._codes(segments, ends, bits)
        longest = int(sizes.max(initial=0))
        order, new = self._sorted(code, bits, places)
        del code
        while True:
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(new, dtype=np.int32)
            if width <= least:
                near, near_width = rank, width
            if width >= longest:
                break
            self._doubled(order, new, rank, rest, width, bits)
            width *= 2
        # equal rests of two segments go by the place of their separators
        left = order - 1
        before = segments[left].astype(np.int32)
        opening = (order == 0) | (rest[left] == 0)
        before[opening] = -1 - np.arange(int(opening.sum()), dtype=np.int32)  # separators differ from each other
        head = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.symbols, self.runs = before[head], head
        self.at, self.up = order[head], order[np.maximum(head - 1, 0)]
        self.match = np.zeros(len(head), np.int32)
        a, b = self.at, self.up
        far = np.flatnonzero((near[a] == near[b]) & (head > 0))
        far = far[(rest[a[far]] >= near_width) & (rest[b[far]] >= near_width)]
        a, b = a[far], b[far]
        most, lcp = np.minimum(rest[a], rest[b]), np.full(len(far), near_width, np.int32)
        open_ = np.arange(len(far))
        while len(open_):
            p, q = a[open_] + lcp[open_], b[open_] + lcp[open_]
            same = (segments[p] == segments[q]) & (lcp[open_] < most[open_])
            open_ = open_[same]
            lcp[open_] += 1
        self.match[far] = lcp
        sample = np.full(n, -1, np.int32)
        sample[self.at] = np.arange(len(head), dtype=np.int32)
        by = sample[sample >= 0]  # in text order
        self.at, self.up, self.match = self.at[by], self.up[by], self.match[by]

    @staticmethod
    def _codes(segments: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
        """A number for the first symbols of each suffix, in their order, and how many symbols it holds."""
        known = np.zeros(256, bool)
        known[segments] = True
        symbol = np.cumsum(known, dtype=np.int64)
        each = int(symbol[-1]).bit_length()
        s = symbol[segments]
        s[ends] = 0
        width = max(1, min(8, (63 - bits) // each))
        code = s.copy()
        for k in range(1, width):
            code[:-1] = np.where(s[:-1] > 0, code[1:], 0)
            code[-1] = 0
            code |= s << (each * k)
        return code, width

    @staticmethod
    def _sorted(key: np.ndarray, bits: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places by key, then by place, and where a new key begins. The place stands in the low bits, so values are sorted."""
        both = (key << bits) | places
        both.sort()
        order = (both & ((1 << bits) - 1)).astype(np.int32)
        both >>= bits
        return order, np.concatenate(([False], both[1:] != both[:-1]))

    @staticmethod
    def _doubled(order: np.ndarray, new: np.ndarray, rank: np.ndarray, rest: np.ndarray, width: int, bits: int) -> None:
        """From the order by the first ``width`` symbols, and where a new rank begins in it, to the order by twice as many, in place.

        Only suffixes that share their rank are sorted: by their own rank, the rank of what follows and their place, in one value. Where these do
        not fit, by the latter two first and then in this order by their own rank, so the sorts are such of values however many suffixes there are.
        """
        n = len(order)
        open_ = np.zeros(n, bool)
        np.logical_not(new[1:], out=open_[1:])
        open_[:-1] |= open_[1:]
        slots = np.flatnonzero(open_)
        own = order[slots]
        low = np.int64((1 << bits) - 1)
        follows = rank[own + np.minimum(rest[own], np.int32(width))]
        if 3 * bits <= 63:
            both = (((rank[own].astype(np.int64) << bits) | follows) << bits) | own
            both.sort()
            order[slots] = both & low
            both >>= bits
            new[slots[1:]] = both[1:] != both[:-1]
            return
        both = (follows.astype(np.int64) << bits) | own
        both.sort()
        own = (both & low).astype(np.int32)
        both >>= bits
        follows = both.astype(np.int32)
        both = (rank[own].astype(np.int64) << bits) | np.arange(len(own))
        both.sort()
        by = both & low
        both >>= bits
        order[slots], follows = own[by], follows[by]
        new[slots[1:]] = (both[1:] != both[:-1]) | (follows[1:] != follows[:-1])

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text position, in order: the longest match with the suffix before it, and that one's place."""
        run = np.diff(self.at, append=len(self.rest))
        start, match, up = (np.repeat(x, run) for x in (self.at, self.match, self.up))
        step = np.arange(len(self.rest), dtype=np.int32) - start
        return match - step, up + step


def first_places(index: RunLengthIndex, length: int) -> np.ndarray:
    """For each position the least position whose ``length`` bytes are the same; itself if its rest is shorter."""
    match, near = index.statistics()
    places = np.arange(len(match), dtype=np.int32)
    up = np.where(match >= length, near, places)
    while True:
        further = up[up]
        if (further == up).all():
            break
        up = further
    least = places.copy()
    linked = np.flatnonzero(up != places)
    np.minimum.at(least, up[linked], places[linked])
    return least[up]


def _packed(bucket: np.ndarray, records: np.ndarray, start: np.ndarray, x: np.ndarray):
    """Rows (bucket, kind, n, payload): the records of a bucket and their bytes, compressed."""
    press = zstandard.ZstdCompressor(1)
    order = np.argsort(bucket, kind="stable")
    bucket, records, start = bucket[order], records[order], start[order]
    cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
    size = records["length"].astype(np.int64)
    flat, to = x[_spans(start, size)], np.concatenate(([0], np.cumsum(size)))
    lo, hi = [0, *cut.tolist()], [*cut.tolist(), len(bucket)]
    yield pa.record_batch(
        {
            "bucket": pa.array(bucket[lo].astype(np.int32)),
            "kind": pa.array(np.zeros(len(lo), np.int32)),
            "n": pa.array(np.subtract(hi, lo).astype(np.int32)),
            "payload": pa.array([press.compress(b"".join([*(records[f][s:e].tobytes() for f in _RECORD.names), flat[to[s] : to[e]].tobytes()])) for s, e in zip(lo, hi)], pa.binary()),
        }
    )


def _unpacked(n: int, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    records, at = np.zeros(n, _RECORD), 0
    for f in _RECORD.names:
        records[f] = np.frombuffer(data, _RECORD[f], n, at)
        at += n * _RECORD[f].itemsize
    return records, np.frombuffer(data, np.uint8, offset=at)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of the spans [start, start + size), one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def checks(x: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """32 bits of XXH3 over the bytes of each span of ``x``."""
    text, digest = x.tobytes(), xxhash.xxh3_64_intdigest
    return (np.fromiter((digest(text[s:e], seed) for s, e in zip(start.tolist(), (start + size).tolist())), np.uint64, len(start)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _merged(content: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments by content: their order, the first of each content, and which of these stand for sure for all with their key.

    Bytes are compared: segments that share a key without being equal stay apart and aren't sure.
    """
    order = np.lexsort((doc, content))
    content, start, size = content[order], start[order], size[order]
    same = (content[1:] == content[:-1]) & (size[1:] == size[:-1])
    pairs = np.flatnonzero(same)
    for lo in range(0, len(pairs), 1 << 14):
        p = pairs[lo : lo + (1 << 14)]
        n = size[p]
        differ = np.add.reduceat(x[_spans(start[p], n)] != x[_spans(start[p + 1], n)], np.cumsum(n) - n)
        same[p[differ > 0]] = False
    head = np.flatnonzero(np.concatenate(([True], ~same)))
    key = content[head]
    sure = np.ones(len(head), bool)
    twice = key[1:] == key[:-1]
    sure[1:][twice] = sure[:-1][twice] = False
    return order, head, sure


def _shard(t: pa.Table, length: int, inner: int, seed: int) -> pa.Table:
    """For each chunk: which windows of its segments start in an earlier document, and in which.

    Segments are indexed in shares of about INDEXED bytes by their minimizers, as they came here.
    """
    parts, texts = [], []
    for n, data in zip(t["n"].to_pylist(), t["payload"].to_pylist()):
        own, text = _unpacked(n, data)
        parts.append(own)
        texts.append(text)
    records, x = np.concatenate(parts), np.concatenate(texts)
    del parts, texts
    size = records["length"].astype(np.int64)
    begin = np.cumsum(size) - size
    shares = -(-len(x) // INDEXED)
    if shares < 2:
        told = [_answers(records, x, size, begin, length, seed)]
    else:
        share = np.zeros(len(records), np.int64)
        for lo, hi in grouped(size.tolist()):
            piece = x[begin[lo] : begin[hi - 1] + size[hi - 1]]
            share[lo:hi] = mix64(minimizers(grams(piece, inner), length - inner + 1)[begin[lo:hi] - begin[lo]] ^ _D) % np.uint64(shares)
        order = np.argsort(share, kind="stable")
        told = [_answers(records[k], x, size[k], begin[k], length, seed) for k in np.split(order, np.searchsorted(share[order], np.arange(1, shares))) if len(k)]
    chunk, *columns, first = (np.concatenate(c) for c in zip(*told))
    sure = chunk >= 0  # one document of the chunk has this content: it is said here that it is a later one
    chunk = np.where(sure, chunk, -chunk - 1)
    batches = [*packed(chunk[sure], [c[sure] for c in columns], key="chunk"), *packed(chunk[~sure], [c[~sure] for c in (*columns, first)], key="chunk", kind=1)]
    return pa.Table.from_batches(batches, schema=_ANSWERS).select(["chunk", "payload", "kind"]) if batches else _ANSWERS.empty_table().select(["chunk", "payload", "kind"])


def _answers(records: np.ndarray, x: np.ndarray, size: np.ndarray, begin: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """(chunk as records have it, key, check, from, to, first document) of runs of windows with one first document; records of one content share them."""
    order = np.lexsort((records["least"], records["key"]))
    records, size = records[order], size[order]
    # a row of bytes for each record, its own first and then zeros
    columns = np.arange(int(size.max()) + 1)
    rows = np.lib.stride_tricks.sliding_window_view(np.append(x, np.zeros(len(columns), np.uint8)), len(columns))[begin[order]]
    rows[columns >= size[:, None]] = 0
    same = (records["key"][1:] == records["key"][:-1]) & (size[1:] == size[:-1])
    maybe = np.flatnonzero(same)
    same[maybe] = (rows[maybe + 1] == rows[maybe]).all(axis=1)
    new = np.concatenate(([True], ~same))
    head = np.flatnonzero(new)  # has the least document of its content
    by = np.argsort(records["least"][head], kind="stable")
    rank = np.empty(len(head), np.int64)
    rank[by] = np.arange(len(head))
    of = rank[np.cumsum(new) - 1]
    head = head[by]
    sizes = size[head]
    inside = columns <= sizes[:, None]  # with a separator after each
    flat = rows[head][inside]
    start = np.cumsum(sizes + 1) - (sizes + 1)
    owner = np.repeat(np.arange(len(head), dtype=np.int32), sizes + 1)
    first = records["least"][head][owner[first_places(RunLengthIndex(flat, sizes, length), length)]]
    # runs of windows of one content with one first document
    window = np.flatnonzero((columns <= sizes[:, None] - length)[inside])
    edge = np.concatenate(([True], (first[window[1:]] != first[window[:-1]]) | (owner[window[1:]] != owner[window[:-1]])))
    lo = window[edge]
    hi = np.concatenate((window[np.flatnonzero(edge)[1:] - 1], window[-1:])) if len(window) else window
    begin_of, count = np.searchsorted(owner[lo], np.arange(len(head))), np.bincount(owner[lo], minlength=len(head))
    n = count[of]
    rec = np.repeat(np.arange(len(records)), n)
    span = begin_of[of[rec]] + np.arange(len(rec)) - np.repeat(np.cumsum(n) - n, n)
    chunk = records["chunk"][rec]
    need = (first[lo[span]] < records["least"][rec]) | (chunk < 0)
    rec, span, chunk = rec[need], span[need], chunk[need]
    check = checks(flat, start, sizes, seed)
    return chunk, records["key"][rec], check[of[rec]], (lo[span] - start[of[rec]]).astype(np.uint8), (hi[span] - start[of[rec]]).astype(np.uint8), first[lo[span]]


SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary"


def dedup_bytes(docs: DataFrame, length: int = 50, inner: int = 24) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, spans (maximal, of bytes), kept.

    Texts are UTF-8 bytes, a null text is empty. Each byte goes that is covered by a ``length``-byte string
    which also starts in a document with a smaller doc_id; strings are judged on the input. Rows that repeat a
    doc_id do not remove each other's bytes. A row with a null doc_id comes after all others: it loses what
    they have and takes nothing. An empty table gives no rows; further columns are not read.
    ``inner`` is the length of a minimizer; ``length`` may be up to twice ``inner`` and two more.
    """
    if not inner < length <= 2 * inner + 2 or length > LONGEST // 2:
        raise ValueError(f"length must lie in inner + 1 .. 2 * inner + 2, and be {LONGEST // 2} at most")
    seed = secrets.randbits(64)
    lean(docs.sparkSession)
    # each chunk sends a row to each shard and gets one from it: fewer shards, which index their segments in shares
    chunks, nb, shards = n_groups(docs, 4, most=1 << 22), n_groups(docs, 16, most=1 << 22), n_groups(docs, 4, most=1 << 22)
    rows = with_chunk(docs, chunks)

    def pieces(texts):
        for blocks in blocks_of(texts, length):
            if sum(len(b) for _, _, b in blocks) >= length:
                yield Windows(blocks, length, inner)

    def anchors(texts):
        for w in pieces(texts):
            yield w.key, w.text

    shared, hot = shared_keys(rows, anchors, nb)
    told = docs.sparkSession.sparkContext.broadcast(hot)  # bounded: see Slots

    def ids(doc_ids) -> np.ndarray:
        return doc_ids.fill_null(LAST).to_numpy()

    class Segments(Task):
        """Sends the segments with shared minimizers, each distinct one of the chunk once with its least document."""

        def __init__(self, chunk, payloads):
            self.chunk, self.keys, self.held, self.size, self.whole = chunk, sorted_keys(payloads), [], 0, True

        def piece(self, doc_ids, texts):
            docs_of = ids(doc_ids)
            for w in pieces(texts):
                which = np.flatnonzero(member(short(w.key, nb), self.keys))
                run, first, last = w.opened(which, told.value.has(short(w.key, nb)))
                if len(run):
                    size = last - first + length
                    self.held.append((w.key[run], w.content(first, last), docs_of[w.text[run]], size, w.x[_spans(first, size)]))
                    self.size += int(size.sum())
            if self.size > HELD:
                self.whole = False  # other documents of the chunk can follow: nothing is sure of all of them
                yield from self.end()

        def end(self):
            if not self.held:
                return
            key, content, doc, size, x = (np.concatenate(c) for c in zip(*self.held))
            self.held, self.size = [], 0
            start = np.cumsum(size) - size
            order, head, sure = _merged(content, doc, start, size, x)
            key, content, doc, size, start = (a[order] for a in (key, content, doc, size, start))
            final = np.append(head[1:], len(content)) - 1
            records = np.zeros(len(head), _RECORD)
            records["key"], records["least"], records["length"] = content[head], doc[head], size[head]
            records["chunk"] = np.where((doc[final] > doc[head]) | ~sure | (not self.whole), -self.chunk - 1, self.chunk)
            single = (size[head] == length) & told.value.has(short(key[head], nb))
            route = np.where(single, mix64(content[head] ^ _B), mix64(key[head]))
            yield from _packed((route % np.uint64(shards)).astype(np.int64), records, start[head], x)

    def answered(t: pa.Table) -> pa.Table:
        return _shard(t, length, inner, seed)

    found = chunkwise(shared, rows, Segments, packed_schema()).groupBy("bucket").applyInArrow(answered, "chunk int, payload binary, kind int")
    found = found.select("chunk", F.concat(F.when(F.col("kind") == 1, F.lit(b"\1")).otherwise(F.lit(b"\0")), "payload").alias("payload"))
    found = stage(found, "repeated-segments")

    class Removal(Task):
        def __init__(self, chunk, payloads):
            parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.int64))]
            for p in payloads:
                if p[0]:
                    parts.append(unpacked([(len(p) - 1) // 22], [p[1:]], [np.uint64, np.uint32, np.uint8, np.uint8, np.int64]))
                else:
                    key, check, lo, hi = unpacked([(len(p) - 1) // 14], [p[1:]], [np.uint64, np.uint32, np.uint8, np.uint8])
                    parts.append((key, check, lo, hi, np.full(len(key), np.iinfo(np.int64).min)))
            key, check, lo, hi, first = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(key, kind="stable")
            self.key, self.check, self.lo, self.hi, self.first = key[order], check[order], lo[order].astype(np.int64), hi[order].astype(np.int64), first[order]

        def piece(self, doc_ids, texts):
            docs_of, gone = ids(doc_ids), [None] * len(texts)
            for w in pieces(texts) if len(self.key) else ():
                run, first, last = w.opened(np.arange(len(w.key)), told.value.has(short(w.key, nb)))
                content = w.content(first, last)
                some = np.flatnonzero(member(content, self.key))
                lo = np.searchsorted(self.key, content[some])
                n = np.searchsorted(self.key, content[some], "right") - lo
                rec, entry = np.repeat(some, n), _spans(lo, n)
                check = checks(w.x, first[some], last[some] - first[some] + length, seed)
                yes = (self.first[entry] < docs_of[w.text[run[rec]]]) & (self.check[entry] == np.repeat(check, n))
                rec, entry = rec[yes], entry[yes]
                text, shift = w.text[run[rec]], w.shift[run[rec]]
                start, end = first[rec] + self.lo[entry] + shift, first[rec] + self.hi[entry] + shift + length
                order = np.argsort(text, kind="stable")
                text, start, end = text[order], start[order], end[order]
                cut = np.flatnonzero(text[1:] != text[:-1]) + 1
                for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(text)]):
                    if s < e:
                        k = int(text[s])
                        if gone[k] is None:
                            gone[k] = np.zeros(len(texts[k]) + 1, np.int32)
                        np.add.at(gone[k], start[s:e], 1)
                        np.add.at(gone[k], end[s:e], -1)
            yield kept(doc_ids, texts, gone)

    def kept(doc_ids, texts, gone):
        out = {"n_bytes": [len(t) for t in texts], "n_removed": [], "spans": [], "kept": []}
        for t, edge in zip(texts, gone):
            if edge is None:
                out["n_removed"].append(0)
                out["spans"].append([])
                out["kept"].append(t)
                continue
            mask = np.cumsum(edge[:-1]) > 0
            s, e = runs(mask)
            out["n_removed"].append(int(mask.sum()))
            out["spans"].append([{"start": i, "end": j} for i, j in zip(s.tolist(), e.tolist())])
            out["kept"].append(np.frombuffer(t, np.uint8)[~mask].tobytes())
        return pa.record_batch(
            {
                "doc_id": doc_ids,
                "n_bytes": pa.array(out["n_bytes"], pa.int64()),
                "n_removed": pa.array(out["n_removed"], pa.int64()),
                "spans": pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(out["kept"], pa.binary()),
            }
        )

    return chunkwise(found, rows, Removal, SCHEMA)
