"""Helpers that the training-data operators share: staging, packed exchanges, components.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, so that any
executor can read them again after another one is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.sources.storage import discard, shared_dir, stage  # noqa: F401

TOKENIZERS = "/opt/tokenizers"


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH = 4 << 20


def lean(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes for this session: a worker holds a few MB of text, however long the rows are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > BATCH:
        spark.conf.set(key, str(BATCH))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_groups(df: DataFrame, per_split: int = 4, least: int = 16, most: int = 65536) -> int:
    """Number of groups for a packed exchange; it follows the number of input splits."""
    return int(min(most, max(least, per_split * df.rdd.getNumPartitions())))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values (wraps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def packed(bucket: np.ndarray, columns: list[np.ndarray], key: str = "bucket", kind: int = 0):
    """Record batches of (bucket, kind, n, payload): the columns of each bucket's records, one after another.

    A packed row carries many records, so the shuffle moves a few large rows instead of many
    small ones; :func:`unpacked` is the inverse.
    """
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_bucket)) + 1
    starts = np.concatenate(([0], cuts))
    ends = np.concatenate((cuts, [len(bucket)]))
    columns = [np.ascontiguousarray(c[order]) for c in columns]
    payload = [b"".join(c[s:e].tobytes() for c in columns) for s, e in zip(starts.tolist(), ends.tolist())]
    yield pa.record_batch(
        {
            key: pa.array(sorted_bucket[starts].astype(np.int32), pa.int32()),
            "kind": pa.array(np.full(len(starts), kind, np.int32), pa.int32()),
            "n": pa.array((ends - starts).astype(np.int32), pa.int32()),
            "payload": pa.array(payload, pa.binary()),
        }
    )


def packed_schema(key: str = "bucket") -> str:
    return f"{key} int, kind int, n int, payload binary"


def unpacked(n: list[int], payload: list[bytes], types: list[np.dtype]) -> list[np.ndarray]:
    """The columns that :func:`packed` took, over all given rows."""
    parts: list[list[np.ndarray]] = [[] for _ in types]
    for count, data in zip(n, payload):
        at = 0
        for k, kind in enumerate(types):
            width = np.dtype(kind).itemsize * count
            parts[k].append(np.frombuffer(data, kind, count, at))
            at += width
    return [np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, types)]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, root), root the least node.

    Each round hooks every node to its least neighbour, jumps twice along the hooks and
    contracts the edges; a path shrinks by a factor of about four a round. Nulls and loops
    are ignored. All of it stays in Spark tables, each deleted once the next ones are written; nothing goes to the driver
    but counts. Links that are left after ``rounds`` are an error.
    """
    spark = edges.sparkSession
    links = stage(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    for _ in range(rounds):
        if links.isEmpty():
            break
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        first = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "hook")
        hook = first
        for _ in range(2):
            hook = hook.join(hook.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p"))
        hook = stage(hook, "jump")
        old = [links.staged_path, first.staged_path]
        if roots is None:
            roots = hook.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            old.append(roots.staged_path)
            roots = roots.join(hook.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        roots = stage(roots, "roots")
        left = hook.select(F.col("u").alias("a"), F.col("p").alias("x"))
        right = hook.select(F.col("u").alias("b"), F.col("p").alias("y"))
        links = stage(
            links.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "links",
        )
        discard(spark, *old, hook.staged_path)
    else:
        if not links.isEmpty():
            raise RuntimeError(f"links are left after {rounds} rounds")
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
