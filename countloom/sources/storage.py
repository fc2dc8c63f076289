"""The shared folder of a session: where intermediate tables, written files and stream checkpoints go."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of a staged table, which a writer holds in memory.
ROW_GROUP = 32 << 20
#: Drops the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    A local one is set only where none is named and the session itself is local, as in tests; on a cluster
    executors would write into their own disks, so a missing setting is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-countloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; :func:`discard_since` removes it."""
    path = f"{shared_dir(spark)}/countloom/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, the shuffle files of a query go as soon as it has ended: its result is a written table, nothing reads them again."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        df.write.options(compression="zstd", **{"parquet.block.size": ROW_GROUP}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        if path in _made:
            _made.remove(path)


def mark() -> int:
    """How many tables have been staged so far; for :func:`discard_since`."""
    return len(_made)


def discard_since(spark: SparkSession, at: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete what was staged after ``at`` but for ``keep``: call it once the results that rest on these tables are written."""
    kept = {df.staged_path for df in keep}
    discard(spark, *[p for p in _made[at:] if p not in kept])
