"""Token ids in training order: fixed-stride binary shards under a keyed permutation.

Documents are sorted by id over ranges and encoded once; their ids, each document closed by an end mark, form one stream
that is cut into sequences of ``length`` ids. A document's place in it follows from the documents alone, however they are dealt. A Feistel network over the least even number of bits that holds
the number of sequences, with cycle-walking, permutes them: sequence number to global slot and back, from a key
alone. Shard k holds the slots of one range; every slot has the same number of bytes in it, so the
place of a slot follows from its number, and reading goes on from any slot. Ranges of shards are folders of their own, so that a
reader opens none of the earlier ones.

Executors reach shared stores through Spark's writers only, so a shard is a Parquet row
(shard, first_slot, n, payload); ``payload`` is the plain little-endian array of its ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.sources.storage import shuffles_dropped

from .common import TOKENIZERS, discard, lean, mix64, stage
from .secrets import encoding

ROUNDS = 6
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
PER_SHARD = 1024
#: Shards of a folder and of a file, at most.
PER_FOLDER, PER_FILE = 32, 8


class Order:
    """A permutation of range(n) from a key: a Feistel network, walked on while outside of the range."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
        seeds = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1)
        self.keys = mix64(seeds)

    def _walk(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        x = np.asarray(x, np.uint64).copy()
        todo = np.arange(len(x))
        while len(todo):
            left, right = x[todo] >> half, x[todo] & mask
            for k in keys:
                if back:
                    left, right = right ^ (mix64(left ^ k) & mask), left
                else:
                    left, right = right, left ^ (mix64(right ^ k) & mask)
            x[todo] = left << half | right
            todo = todo[x[todo] >= self.n]
        return x.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self._walk(sequences, self.keys, False)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1], True)


def encoded(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """(part, start, n, ids binary): each document's ids and where they start in the stream of its part; parts follow each other.

    Parts are ranges of (doc_id, hash of the text), and so is the order within one.
    """

    def run(batches):
        enc = encoding(vocabulary)
        kind, start = _kind(max(enc.max_token_value, end)), 0
        for b in batches:
            out = {"part": [], "start": [], "n": [], "ids": []}
            for p, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*enc.encode_ordinary(text), end], kind)
                for key, x in zip(out, (p, start, len(ids), ids.tobytes())):
                    out[key].append(x)
                start += len(ids)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())]))

    rows = docs.where("text is not null and text <> ''").select("doc_id", F.xxhash64("text").alias("h"), "text")
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return rows.select(F.spark_partition_id().alias("part"), "text").mapInArrow(run, "part int, start long, n long, ids binary")


def _kind(largest: int) -> np.dtype:
    return np.dtype("<u2" if largest < 1 << 16 else "<u4")


def materialise(docs: DataFrame, path: str, key: int = 20, length: int = 2048, per_shard: int = PER_SHARD, vocabulary: str = VOCABULARY, end: int = 50256) -> None:
    """Writes the shards of ``docs`` (doc_id, text) to ``path``/shards and one row about them to ``path``/about.

    Documents follow each other by doc_id, nulls first, then by a hash of the text; so the same documents and key give the same
    slots on any cluster. Null and empty texts have no ids and no end mark.
    The last sequence is filled up with ``end``. Very long texts are encoded whole and cut like any other. Repeated rows stay. An
    empty table gives no shards. Further columns are not read.
    """
    spark = lean(docs.sparkSession)
    kind = _kind(max(encoding(vocabulary).max_token_value, end))
    ids = stage(encoded(docs, vocabulary, end), "token-ids")
    # a number per task of the encoding: bounded by their number
    sizes = {r["part"]: r["n"] for r in ids.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()}
    total = sum(sizes.values())
    n = -(-total // length)
    order = Order(n, key)
    base = spark.sparkContext.broadcast(dict(zip(sizes, np.cumsum([0, *sizes.values()]).tolist())))
    shards = max(1, -(-n // per_shard))
    files = max(-(-shards // PER_FILE), min(shards, 2 * spark.sparkContext.defaultParallelism))
    ranges = -(-shards // PER_FOLDER)

    def cut(batches):
        for b in batches:
            rows = {"sequence": [], "at": [], "ids": []}
            for part, start, data in zip(*(b.column(c).to_pylist() for c in range(3))):
                start += base.value[part]
                x = np.frombuffer(data, kind)
                lo = 0
                while lo < len(x):
                    s, at = divmod(start + lo, length)
                    hi = min(len(x), lo + length - at)
                    rows["sequence"].append(s)
                    rows["at"].append(at)
                    rows["ids"].append(x[lo:hi].tobytes())
                    lo = hi
            slot = order.slots(np.array(rows["sequence"], np.int64))
            yield pa.record_batch({"shard": pa.array(slot // per_shard), "slot": pa.array(slot), "at": pa.array(rows["at"], pa.int32()), "ids": pa.array(rows["ids"], pa.binary())})

    def fill(batches):
        stride = length * kind.itemsize
        shard, payload = None, None
        for b in batches:
            out = []
            for k, slot, at, data in zip(*(b.column(c).to_pylist() for c in range(4))):
                if k != shard:
                    if shard is not None:
                        out.append((shard, payload))
                    held = min(per_shard, n - k * per_shard)
                    shard, payload = k, bytearray(np.full(held * length, end, kind).tobytes())
                begin = (slot - k * per_shard) * stride + at * kind.itemsize
                payload[begin : begin + len(data)] = data
            yield made(out)
        if shard is not None:
            yield made([(shard, payload)])

    def made(out):
        size = [len(p) // (length * kind.itemsize) for _, p in out]
        return pa.record_batch({"shard": pa.array([k for k, _ in out], pa.int64()), "first_slot": pa.array([k * per_shard for k, _ in out], pa.int64()), "n": pa.array(size, pa.int64()), "payload": pa.array([bytes(p) for _, p in out], pa.binary())})

    pieces = ids.select("part", "start", "ids").mapInArrow(cut, "shard long, slot long, at int, ids binary")
    pieces = pieces.repartitionById(files, _range(F.col("shard"), files, shards)).sortWithinPartitions("shard")
    made_of = pieces.mapInArrow(fill, "shard long, first_slot long, n long, payload binary").withColumn("range", _range(F.col("shard"), ranges, shards))
    with shuffles_dropped(spark):
        made_of.write.partitionBy("range").option("compression", "zstd").parquet(f"{path}/shards")
    discard(spark, ids.staged_path)
    about = spark.createDataFrame([(n, total, length, per_shard, kind.itemsize, key, end, shards, ranges)], "n_sequences long, n_tokens long, length int, per_shard int, width int, key long, end int, shards long, ranges int")
    about.coalesce(1).write.parquet(f"{path}/about")


def _range(shard, ranges: int, shards: int):
    """The file or folder that holds a shard: ranges of shards of equal size."""
    return F.floor(shard * ranges / shards).cast("int")


def read(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """(slot, sequence, n_tokens, ids array<int>) from ``from_slot`` on; only the files from there on are opened.

    Rows come in slot order within a shard. ``n_tokens`` is less than the length in the last sequence only.
    """
    about = spark.read.parquet(f"{path}/about").first()
    length, kind = about["length"], np.dtype(f"<u{about['width']}")
    n, total, per_shard = about["n_sequences"], about["n_tokens"], about["per_shard"]
    order = Order(n, about["key"])

    def run(batches):
        for b in batches:
            for first, size, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                skip = max(0, from_slot - first)
                if skip >= size:
                    continue
                slot = np.arange(first + skip, first + size)
                sequence = order.sequences(slot)
                data = np.frombuffer(payload.as_buffer(), kind).reshape(size, length)[skip:]
                for lo in range(0, len(slot), 256):
                    s = sequence[lo : lo + 256]
                    m = np.minimum(length, total - s * length)
                    flat = np.concatenate([row[:k] for row, k in zip(data[lo : lo + 256], m.tolist())]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(m))).astype(np.int32)), pa.array(flat))
                    yield pa.record_batch({"slot": pa.array(slot[lo : lo + 256]), "sequence": pa.array(s), "n_tokens": pa.array(m), "ids": lists})

    if not n:
        return spark.createDataFrame([], "slot long, sequence long, n_tokens long, ids array<int>")
    shard = from_slot // per_shard
    schema = "shard long, first_slot long, n long, payload binary, range int"
    shards = spark.read.schema(schema).parquet(f"{path}/shards").where((F.col("range") >= shard * about["ranges"] // about["shards"]) & (F.col("shard") >= shard))
    return shards.select("first_slot", "n", "payload").mapInArrow(run, "slot long, sequence long, n_tokens long, ids array<int>")
