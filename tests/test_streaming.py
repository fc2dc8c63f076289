"""Streams over folders: restarts lose and repeat nothing, repeated rows are dropped, falling counters show."""

import datetime as dt

from pyspark.sql import functions as F

from countloom.streaming import feeds

T0 = dt.datetime(2024, 1, 1)


def put(spark, folder, rows):
    spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), u, e, float(v), "{}") for i, s, u, e, v in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(folder)


def test_restart_goes_on(spark, tmp_path):
    src, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    put(spark, src, [(1, 0, 1, "a", 2.5), (2, 30, 1, "a", 1.5), (3, 70, 1, "b", 9.0)])
    run = lambda: feeds.run_to_end(feeds.minute_totals(feeds.file_feed(spark, src), "1 minute"), out, mark)
    run()
    put(spark, src, [(4, 100, 2, "a", 4.0), (5, 1000, 2, "a", 4.0)])
    run()
    run()
    put(spark, src, [(6, 90000, 2, "a", 1.0)])
    run()
    got = sorted((r.bucket, r.events, r.total) for r in spark.read.parquet(out).collect())
    want = [(T0, 2, 3), (T0 + dt.timedelta(minutes=1), 2, 13), (T0 + dt.timedelta(seconds=960), 1, 4)]
    assert got == want


def test_stream_equals_batch(spark, tmp_path):
    src = f"{tmp_path}/events.parquet"
    for k in range(3):
        put(spark, src, [(10 * k + j, 40 * j + k, 1, "a", j) for j in range(10)])
    got = {(r.bucket, r.events, r.total) for r in feeds.stream_arrivals(spark, src).collect()}
    batch = spark.read.parquet(src).groupBy(F.date_trunc("minute", "ts").alias("b")).agg(F.count("*").alias("n"), F.sum(F.floor("value")).cast("long").alias("t"))
    assert got == {(r.b, r.n, r.t) for r in batch.collect()}


def test_upsert_keeps_the_first(spark, tmp_path):
    src, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    put(spark, src, [(1, 0, 7, "a", 1.0), (2, 5, 7, "a", 2.0), (3, 5, 8, "a", 3.0)])
    feeds.upsert_latest(feeds.file_feed(spark, src), out, mark, ["user_id", "event_type"], "event_id")
    put(spark, src, [(4, 9, 7, "a", 4.0), (5, 9, 9, "b", 5.0)])
    feeds.upsert_latest(feeds.file_feed(spark, src), out, mark, ["user_id", "event_type"], "event_id")
    assert spark.read.parquet(f"{out}/part=1").count() == 2  # what was there isn't written again
    feeds.compact(spark, out, f"{tmp_path}/whole", ["user_id", "event_type"], "event_id")
    for table in (out, f"{tmp_path}/whole"):
        got = sorted((r.user_id, r.event_id) for r in feeds.latest(spark, table, ["user_id", "event_type"], "event_id").collect())
        assert got == [(7, 1), (8, 3), (9, 5)]


def test_falling_counters(spark, tmp_path):
    src, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    go = lambda: feeds.run_to_end(feeds.falling_counters(feeds.file_feed(spark, src).select("user_id", "ts", F.col("value").cast("long").alias("n")), "user_id", "ts", "n"), out, mark)
    put(spark, src, [(1, 0, 1, "a", 5), (2, 1, 1, "a", 7), (3, 2, 1, "a", 6), (4, 0, 2, "a", 1)])
    go()
    put(spark, src, [(5, 9, 1, "a", 6), (6, 10, 1, "a", 8), (7, 9, 2, "a", 1)])
    go()
    assert sorted((r.user_id, r.n, r.highest) for r in spark.read.parquet(out).collect()) == [(1, 6, 7), (1, 6, 7)]


def test_sessions(spark, tmp_path):
    src, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    put(spark, src, [(1, 0, 1, "a", 1), (2, 600, 1, "a", 1), (3, 9000, 1, "a", 1), (4, 99000, 1, "a", 1)])
    go = lambda: feeds.run_to_end(feeds.session_totals(feeds.file_feed(spark, src)), out, mark)
    go()
    put(spark, src, [(5, 200000, 1, "a", 1)])
    go()
    assert sorted(r.events for r in spark.read.parquet(out).collect()) == [1, 1, 2]
