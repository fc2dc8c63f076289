"""Feeds as streams: arrivals per minute, de-duplicated ingest with upsert, and a guard against falling counters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from countloom.sources.storage import shared_dir


def file_feed(spark: SparkSession, path: str, per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream; the schema is that of the files there are. One file is a folder of one."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def minute_totals(feed: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events and counts per minute; rows that are later than ``late`` are dropped by the watermark."""
    rows = feed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("events"), F.sum(F.floor("value").cast("long")).alias("total")).select(F.col("window.start").alias("bucket"), "events", "total")


def session_totals(feed: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: events of a unit in sessions."""
    rows = feed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def run_to_end(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """All there is now, exactly once: offsets and outputs are committed together, so a restart goes on where it stood."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def _first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("first_row")).select(*keys, "first_row.*").select(rows.columns)


def upsert_latest(feed: DataFrame, target: str, checkpoint: str, keys: list[str], order: str) -> None:
    """Each micro-batch adds a part with its first row of every key; :func:`latest` reads them as one table.

    A batch that is run again after a failure writes the same part again. What was stored before is not rewritten; :func:`compact` does that
    once in a while.
    """

    def add(batch: DataFrame, number: int) -> None:
        _first(batch, keys, order).write.mode("overwrite").parquet(f"{target}/part={number}")

    feed.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, target: str, keys: list[str], order: str) -> DataFrame:
    """The first row of every key by ``order`` over all parts."""
    return _first(spark.read.option("basePath", target).parquet(target).drop("part"), keys, order)


def compact(spark: SparkSession, target: str, into: str, keys: list[str], order: str) -> None:
    """All parts as one, in a new place that readers turn to when it is whole; the old one can go then."""
    latest(spark, target, keys, order).write.parquet(f"{into}/part=-1")


def falling_counters(feed: DataFrame, key: str, order: str, counter: str) -> DataFrame:
    """Rows of a cumulative feed that fall below the highest value seen of their key, with state per key.

    Rows of one key in a batch are read in time order, so a worker holds those of one key and trigger: bound the files of a trigger where
    a key is hot (``file_feed``'s ``per_trigger``). (key, order, counter, highest).
    """
    import pandas as pd

    kinds = dict(feed.dtypes)

    def guard(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        high = state.get[0] if state.exists else None
        before = rows[counter].cummax().shift()
        if high is not None:
            before = before.fillna(high).clip(lower=high)
        top = rows[counter].max() if high is None else max(high, rows[counter].max())
        state.update((int(top),))
        bad = rows[counter] < before
        yield pd.DataFrame({key: rows[key][bad], order: rows[order][bad], counter: rows[counter][bad], "highest": before[bad].astype("int64")})

    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {counter} {kinds[counter]}, highest long"
    return feed.groupBy(key).applyInPandasWithState(guard, out, "highest long", "append", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """The last progress of each running stream, for a heartbeat; ``spark.streams.addListener(Progress())``."""

    def __init__(self) -> None:
        self.last: dict[str, tuple[int, int]] = {}

    def onQueryStarted(self, event) -> None:
        self.last[str(event.id)] = (-1, 0)

    def onQueryProgress(self, event) -> None:
        self.last[str(event.progress.id)] = (event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.last.pop(str(event.id), None)


def stream_arrivals(spark: SparkSession, path: str) -> DataFrame:
    """The arrivals per minute of all files at ``path``, by a stream that runs until it has read them."""
    run = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    feed = file_feed(spark, path)
    totals = feed.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.date_trunc("minute", "ts").alias("bucket")).agg(F.count("*").alias("events"), F.sum(F.floor("value").cast("long")).alias("total"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/table")

    totals.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{run}/table")
