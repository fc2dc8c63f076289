"""What the two exact-repeat operators share: chunks of documents and the search for shared anchors.

Documents are dealt to chunks by a hash of their id and text. An anchor is a 64-bit key of a place in
a text. :func:`shared_keys` tells every chunk which of its anchors occur more than once in the
corpus; :func:`chunkwise` brings such answers and the documents of a chunk together in one stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, packed, packed_schema, stage, unpacked

#: Bytes of text that are looked at together, and keys that are gathered before they are sent.
PIECE = 1 << 18
FLUSH = 1 << 19
#: Bytes of text that a task bundles at once.
BUNDLE = 16 << 20
#: A key in more places than this is hot.
HOT = 4096
#: Hot keys are told as a set of slots of this many bits, 16 MB at most however many they are.
SLOT_BITS = 27


def with_chunk(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, doc_id, text): the chunk depends on a row's id and text only."""
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk")
    return docs.select(chunk, F.col("doc_id").cast("long").alias("doc_id"), "text")


def bundled(rows: DataFrame) -> DataFrame:
    """(chunk, payload): the documents that some batches have of a chunk, compressed together. :func:`unbundled` reads them."""

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1), texts_of(b.column(2))))
            size += b.nbytes
            if size >= BUNDLE:
                yield from bundle(held)
                held, size = [], 0
        if held:
            yield from bundle(held)

    def bundle(held):
        press = zstandard.ZstdCompressor(3)
        chunks, ids = np.concatenate([c for c, _, _ in held]), pa.concat_arrays([i for _, i, _ in held])
        texts = [t for _, _, part in held for t in part]
        null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        order = np.argsort(chunks, kind="stable")
        cut = np.flatnonzero(chunks[order][1:] != chunks[order][:-1]) + 1
        for at in np.split(order, cut) if len(order) else ():
            part = [texts[k] for k in at.tolist()]
            sizes = np.array([len(t) for t in part], "<i8")
            head = np.int64(len(at)).tobytes() + ids[at].tobytes() + sizes.tobytes() + null[at].tobytes()
            yield pa.record_batch({"chunk": pa.array(chunks[at[:1]], pa.int32()), "payload": pa.array([head + press.compress(b"".join(part))], pa.binary())})

    return rows.mapInArrow(run, "chunk int, payload binary")


def unbundled(payload: bytes) -> tuple[pa.Array, list[bytes]]:
    n = int(np.frombuffer(payload, np.int64, 1)[0])
    ids, sizes = np.frombuffer(payload, "<i8", n, 8), np.frombuffer(payload, "<i8", n, 8 + 8 * n)
    null = np.frombuffer(payload, bool, n, 8 + 16 * n)
    text = zstandard.ZstdDecompressor().decompress(payload[8 + 17 * n :], max_output_size=max(1, int(sizes.sum())))
    ends = np.cumsum(sizes).tolist()
    return pa.array(ids, pa.int64(), mask=null), [text[s:e] for s, e in zip([0, *ends], ends)]


def grouped(sizes: list[int], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """[from, to) of neighbours whose sizes sum to ``limit`` at most, or single larger ones."""
    at, total = 0, 0
    for k, n in enumerate(sizes):
        if k > at and total + n > limit:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def texts_of(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _split(key: np.ndarray, nb: int) -> np.ndarray:
    """Bucket of a mixed 64-bit key, by its upper half."""
    return ((key >> np.uint64(32)) % np.uint64(nb)).astype(np.int64)


def short(key: np.ndarray, nb: int) -> np.ndarray:
    """A key as its bucket and its lower half; this is what answers hold."""
    return (_split(key, nb).astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))


class Slots:
    """Hot keys by the slot of their hash. A key that shares a slot counts as hot too, everywhere alike; that costs time only."""

    def __init__(self, words: np.ndarray, bits: np.ndarray):
        order = np.argsort(words)
        self.words, self.bits = words[order], bits[order]

    @staticmethod
    def of(keys: np.ndarray) -> np.ndarray:
        return mix64(keys) >> np.uint64(64 - SLOT_BITS)

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(keys), bool)
        slot = self.of(keys)
        word = (slot >> np.uint64(6)).astype(np.int64)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return (self.words[at] == word) & ((self.bits[at] >> (slot & np.uint64(63))) & np.uint64(1) > 0)


def _slots(keys: DataFrame) -> Slots:
    """:class:`Slots` of rows (payload binary: keys), united in Spark."""

    def run(batches):
        for b in batches:
            slot = Slots.of(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64))
            yield pa.record_batch({"word": pa.array((slot >> np.uint64(6)).astype(np.int32)), "bits": pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))})

    got = keys.select("payload").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    return Slots(got["word"].to_numpy().astype(np.int64), got["bits"].to_numpy().astype(np.int64).view(np.uint64))


def shared_keys(rows: DataFrame, anchors: Callable[[list[bytes]], Iterator[tuple[np.ndarray, np.ndarray]]], nb: int) -> tuple[DataFrame, Slots]:
    """The keys of anchors in several places: a staged table (chunk, keys binary) and the hot keys.

    ``anchors`` yields arrays (key, index of its text). A task sends a key it meets once with its chunk;
    a key it meets several times goes out once with their number, and its chunks get
    their answer at once. So a key has a record per task and flush at most. A key stands for
    its :func:`short` form; a false meeting of two of these costs time and changes no result.
    """

    def emit(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def flush():
            key, chunk = (np.concatenate(x) for x in zip(*held))
            held.clear()
            key = short(key, nb)
            order = np.argsort(key, kind="stable")
            key, chunk = key[order], chunk[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(np.concatenate((first, [len(key)])))
            ref = np.where(count > 1, -count, chunk[first]).astype(np.int32)
            own = key[first]
            yield from packed((own >> np.uint64(32)).astype(np.int64), [own.astype(np.uint32), ref])
            many = np.repeat(count > 1, count)
            if many.any():
                key, chunk = key[many], chunk[many]
                order = np.lexsort((key, chunk))
                key, chunk = key[order], chunk[order]
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])))
                key, chunk = key[new], chunk[new]
                yield from packed(_split(mix64(chunk.astype(np.uint64)), nb), [key, chunk.astype(np.int32)], kind=1)

        for b in batches:
            chunks = b.column(0).to_numpy()
            texts = texts_of(b.column(2))
            for lo, hi in grouped([len(t) for t in texts]):
                for key, owner in anchors(texts[lo:hi]):
                    if len(key):
                        held.append((key, chunks[lo:hi][owner]))
                        n += len(key)
                if n >= FLUSH:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    def answer(t: pa.Table) -> pa.Table:
        kind = t["kind"].to_numpy()
        told: list[tuple[np.ndarray, np.ndarray]] = []
        hot = np.zeros(0, np.uint64)
        if (kind == 0).any():
            part = t.filter(pa.array(kind == 0))
            low, ref = unpacked(part["n"].to_pylist(), part["payload"].to_pylist(), [np.uint32, np.int32])
            key = (np.uint64(t["bucket"][0].as_py()) << np.uint64(32)) | low.astype(np.uint64)
            order = np.argsort(low, kind="stable")
            key, ref = key[order], ref[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            count = np.diff(np.concatenate((first, [len(key)])))
            places = np.add.reduceat(np.maximum(-ref, 1), first)
            hot = key[first[places > HOT]]
            shared = np.repeat(places > 1, count) & (ref >= 0)
            told.append((key[shared], ref[shared]))
        if (kind == 1).any():
            part = t.filter(pa.array(kind == 1))
            key, chunk = unpacked(part["n"].to_pylist(), part["payload"].to_pylist(), [np.uint64, np.int32])
            told.append((key, chunk.astype(np.int64)))
        key, chunk = (np.concatenate(x) for x in zip(*told))
        told_hot = pa.record_batch([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([len(hot)], pa.int32()), pa.array([hot.tobytes()], pa.binary())], schema=target)
        return pa.Table.from_batches([*packed(chunk, [key], key="chunk"), *[told_hot] * (len(hot) > 0)], schema=target)

    target = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("payload", pa.binary())])
    found = rows.mapInArrow(emit, packed_schema()).groupBy("bucket").applyInArrow(answer, packed_schema("chunk"))
    found = stage(found, "shared-keys")
    return found.where("chunk >= 0").select("chunk", "payload"), _slots(found.where("chunk = -1"))


class Task:
    """What is done with one chunk: its answers first, then its documents piece by piece, then what is left."""

    def __init__(self, chunk: int, payloads: list[bytes]):
        self.chunk = chunk

    def piece(self, doc_ids: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def chunkwise(answers: DataFrame, rows: DataFrame, task: Callable[[int, list[bytes]], Task], schema: str) -> DataFrame:
    """A :class:`Task` for each chunk of ``rows`` (chunk, doc_id, text) with its ``answers`` (chunk, payload).

    Rows come sorted by chunk, answers first, and are read as a stream.
    """
    both = answers.select("chunk", F.lit(0).alias("kind"), "payload").unionByName(bundled(rows).select("chunk", F.lit(1).alias("kind"), "payload"))

    def run(batches):
        now, payloads, own = None, [], None
        for b in batches:
            for chunk, kind, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if chunk != now:
                    if own is not None:
                        yield from own.end()
                    now, payloads, own = chunk, [], None
                if kind == 0:
                    payloads.append(payload.as_py())
                    continue
                if own is None:
                    own, payloads = task(chunk, payloads), []
                ids, texts = unbundled(payload.as_py())
                for lo, hi in grouped([len(t) for t in texts]):
                    yield from own.piece(ids.slice(lo, hi - lo), texts[lo:hi])
        if own is not None:
            yield from own.end()

    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, schema)


def sorted_keys(payloads: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(payloads), np.uint64))


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys
