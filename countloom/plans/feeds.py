"""Queries: as-of joins, overlaps, dedupe, JSON fields, fingerprints and the streaming twin of the arrivals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from countloom.functions import scalars
from countloom.functions.scalars import floor_time
from countloom.operators import asof
from countloom.plans.registry import query
from countloom.plans.series import _arrivals
from countloom.sources.driver import FEED, SNAPSHOTS, feed, snapshots, table
from countloom.streaming.feeds import stream_arrivals as _stream_arrivals

_RECEIVED = f"""{SNAPSHOTS}, minutes AS (SELECT date_trunc('minute', ts) AS ts, sum(n) AS n FROM feed GROUP BY 1),
  received AS (SELECT ts, CAST(sum(n) OVER (ORDER BY ts) AS BIGINT) AS received FROM minutes),
  published AS (SELECT ts + INTERVAL 90 MINUTE AS ts, total AS published FROM snapshots)"""


def _received(spark, sf_dir):
    return _arrivals(spark, sf_dir, "minute").select(F.col("bucket").alias("ts"), F.col("cum_total").alias("received"))


def _published(spark, sf_dir):
    return snapshots(spark, sf_dir).select((F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("ts"), F.col("total").alias("published"))


@query(
    f"""WITH {_RECEIVED}, o("offset") AS (VALUES (-60), (0), (300)), p AS (SELECT "offset", ts, ts + to_seconds("offset") AS at, published FROM published, o)
    SELECT p."offset", p.ts, published, r.received, r.received - published AS surplus, coalesce(r.received >= published, false) AS ok FROM p ASOF LEFT JOIN received r ON p.at >= r.ts"""
)
def asof_received(spark, sf_dir):
    """What had been received when something was published, under several clock offsets."""
    offsets = spark.createDataFrame([(-60,), (0,), (300,)], "offset int")
    p = _published(spark, sf_dir).crossJoin(F.broadcast(offsets)).select("offset", F.col("ts").alias("at"), (F.col("ts") + F.make_dt_interval(secs=F.col("offset"))).alias("ts"), "published")
    series = _received(spark, sf_dir).crossJoin(F.broadcast(offsets))
    out = asof.asof_backward(p, series, "ts", ["received"], ["offset"], "day")
    return out.select("offset", F.col("at").alias("ts"), "published", "received", (F.col("received") - F.col("published")).alias("surplus"), F.coalesce(F.col("received") >= F.col("published"), F.lit(False)).alias("ok"))


@query(f"WITH {_RECEIVED} SELECT p.ts, p.published, min(r.ts) AS necessary_ts FROM published p LEFT JOIN received r ON r.received >= p.published GROUP BY 1, 2")
def first_sufficient_time(spark, sf_dir):
    """The first minute at which enough had been received for what was published."""
    return asof.first_reaching(_published(spark, sf_dir), _received(spark, sf_dir), "published", "received", "ts", "necessary_ts")


@query(
    """WITH t(target) AS (VALUES (TIMESTAMP '2024-01-01 00:00:00'), (TIMESTAMP '2024-01-10 12:00:00'), (TIMESTAMP '2030-01-01 00:00:00'))
    SELECT event_type AS category, target, coalesce(max(ts) FILTER (WHERE ts <= target), min(ts)) AS chosen FROM events, t GROUP BY 1, 2"""
)
def nearest_snapshot(spark, sf_dir):
    """The latest state at or before a target time, else the first after it."""
    targets = spark.sql("SELECT CAST(x AS TIMESTAMP_NTZ) AS target FROM VALUES ('2024-01-01 00:00:00'), ('2024-01-10 12:00:00'), ('2030-01-01 00:00:00') AS t(x)")
    rows = table(spark, sf_dir, "events", "ts", "event_type").withColumnRenamed("event_type", "category")
    targets = targets.select(F.col("target").cast(dict(rows.dtypes)["ts"]).alias("target"))
    return asof.nearest_snapshot(targets, rows, "target", "ts", ["category"])


@query(
    """WITH e AS (SELECT user_id AS unit, ts AS "start", lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "end" FROM events),
    i AS (SELECT * FROM e WHERE epoch_us("end") - epoch_us("start") > 21600000000),
    d AS (SELECT CAST(unnest(generate_series(date_trunc('day', (SELECT min(ts) FROM events)), (SELECT max(ts) FROM events), INTERVAL 1 DAY)) AS DATE) AS day),
    j AS (SELECT unit, day, least(epoch_us("end"), epoch_us(CAST(day + 1 AS TIMESTAMP))) - greatest(epoch_us("start"), epoch_us(CAST(day AS TIMESTAMP))) AS us
      FROM i JOIN d ON "start" < CAST(day + 1 AS TIMESTAMP) AND CAST(day AS TIMESTAMP) < "end")
    SELECT unit, day, count(*) AS intervals, CAST(sum(us) AS BIGINT) AS total_us, max(us) AS longest_us FROM j WHERE us > 0 GROUP BY 1, 2"""
)
def interval_overlap(spark, sf_dir):
    """Silences of over six hours of a unit, laid on calendar days."""
    w = Window.partitionBy("unit").orderBy("ts", "event_id")
    e = feed(spark, sf_dir).select("unit", F.col("ts").alias("start"), F.lead("ts").over(w).alias("end"))
    long = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp")) > 21_600_000_000
    return asof.overlap_days(e.where(long), ["unit"])


@query(
    """WITH d AS (SELECT user_id AS unit, event_type AS category, date_trunc('hour', ts) AS hour, event_id, CAST(floor(value) AS BIGINT) AS n FROM events)
    SELECT unit, category, hour, event_id, n FROM d QUALIFY row_number() OVER (PARTITION BY unit, category, hour ORDER BY event_id) = 1"""
)
def dedupe_snapshots(spark, sf_dir):
    """The first row of each key stays."""
    rows = feed(spark, sf_dir).select("unit", "category", floor_time("hour", "ts").alias("hour"), "event_id", "n")
    first = rows.groupBy("unit", "category", "hour").agg(F.min_by(F.struct("event_id", "n"), "event_id").alias("x"))
    return first.select("unit", "category", "hour", "x.event_id", "x.n")


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') IS NULL AS missing FROM events""")
def json_field_extract(spark, sf_dir):
    """Typed access to JSON fields; an absent field is null."""
    props = table(spark, sf_dir, "events", "event_id", "props").withColumn("v", F.try_parse_json("props"))
    return props.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.try_variant_get("v", "$.missing", "string").isNull().alias("missing"))


@query(f"WITH {FEED} SELECT date_trunc('minute', ts) AS bucket, count(*) AS events, CAST(sum(n) AS BIGINT) AS total FROM feed GROUP BY 1")
def stream_arrivals(spark, sf_dir):
    """The arrivals per minute by Structured Streaming over the table's files, until they are read."""
    return _stream_arrivals(spark, f"{sf_dir}/events.parquet")


@query(
    f"""WITH {FEED}, b AS (SELECT date_trunc('hour', ts) AS ts, category, sum(n) AS n FROM feed GROUP BY 1, 2)
    SELECT ts, CAST(sum(n) FILTER (WHERE category = 'click') AS BIGINT) AS click, CAST(sum(n) FILTER (WHERE category = 'purchase') AS BIGINT) AS purchase,
    CAST(sum(n) FILTER (WHERE category = 'view') AS BIGINT) AS view FROM b GROUP BY 1"""
)
def wide_export(spark, sf_dir):
    """A category per column, in sorted order, absent ones null."""
    hours = feed(spark, sf_dir).withColumn("ts", floor_time("hour", "ts"))
    of = lambda c: F.sum(F.when(F.col("category") == c, F.col("n"))).alias(c)
    return hours.groupBy("ts").agg(of("click"), of("purchase"), of("view"))


@query(
    """SELECT p_partkey, regexp_extract(p_name, '[0-9]+$') AS digits, upper(trim(p_type)) AS label, substr(CAST(p_partkey AS VARCHAR), 1, 1) AS first_digit,
    CASE WHEN p_partkey >= 10 THEN substr(CAST(p_partkey AS VARCHAR), 2, 1) END AS second_digit, CAST(p_partkey % 10 AS BIGINT) AS last_digit, substr(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 40) AS safe_name,
    substr(sha256(CAST(p_partkey AS VARCHAR) || '|' || p_brand), 1, 16) AS row_hash FROM part"""
)
def scalar_columns(spark, sf_dir):
    """Text keys, digits, safe names and row hashes of the part table."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    return p.select(
        "p_partkey", F.regexp_extract("p_name", "[0-9]+$", 0).alias("digits"), scalars.canonical_category(F.col("p_type")).alias("label"), scalars.first_digit(F.col("p_partkey")).alias("first_digit"), scalars.second_digit(F.col("p_partkey")).alias("second_digit"),
        scalars.last_digit(F.col("p_partkey")).alias("last_digit"), scalars.safe_name(F.col("p_name"), 40).alias("safe_name"), F.substring(scalars.row_hash("p_partkey", "p_brand"), 1, 16).alias("row_hash"),
    )


@query()
def fingerprint_manifest(spark, sf_dir):
    """Buckets of units by CRC-32 with an order-free fingerprint each; the oracle has no CRC-32."""
    rows = feed(spark, sf_dir)
    bucket = scalars.crc_bucket(64, "unit", "category")
    row = F.conv(F.substring(scalars.row_hash("event_id", "unit", "category", "n"), 1, 8), 16, 10).cast("long")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(row).alias("fingerprint"))
