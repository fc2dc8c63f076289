"""Count facts, matrices and feeds derived from the star-schema tables, in Spark and as SQL for the oracle.

The operators are generic; these adapters give them data. A fact is one count of a category in a unit, with
the unit's place in a hierarchy: region > area > zone > unit. Zone and area come from one key, so they nest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.functions.scalars import floor_time

#: Rows of the largest table that a task of a join takes; tasks become more with the table, not larger.
TASK_ROWS = 250_000
FEW_TASKS = 8
UNIT = ["region", "area", "zone", "unit", "contest"]
KEYS = [*UNIT, "category"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def n_tasks(df: DataFrame) -> int:
    """Tasks that take about :data:`TASK_ROWS` rows of a stored table each; the count comes from the files' footers."""
    return -(-df.count() // TASK_ROWS)


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` by its keys over at least so many tasks, which Spark doesn't merge by their compressed size; a few tasks are left to Spark."""
    return df.repartition(tasks, *keys) if tasks > FEW_TASKS else df


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: its keys, count ``n``, time of receipt, and two numbers that the sources differ by.

    Rows are dealt by their order, a few lines each, and stay so: what is grouped by unit needs no other exchange.
    """
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    units = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    tasks = n_tasks(items)
    rows = dealt(items, tasks, "l_orderkey").join(dealt(units, tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("n_name").alias("region"),
        (F.col("c_custkey") % 20).alias("area"),
        (F.col("c_custkey") % 100).alias("zone"),
        F.col("o_orderkey").alias("unit"),
        F.substring("o_orderpriority", 1, 1).alias("contest"),
        F.concat("l_returnflag", "l_linestatus").alias("category"),
        F.col("l_quantity").cast("long").alias("n"),
        F.col("l_shipdate").alias("received"),
        "l_partkey",
        "l_suppkey",
    )


COUNTED = """counted AS (
  SELECT n_name AS region, c_custkey % 20 AS area, c_custkey % 100 AS zone, o_orderkey AS unit,
         substr(o_orderpriority, 1, 1) AS contest, l_returnflag || l_linestatus AS category,
         CAST(l_quantity AS BIGINT) AS n, l_shipdate AS received, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)"""


def three_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts as sources ``a``, ``b`` and ``fallback`` publish them: b misses some rows and counts others wrong.

    One scan: every row becomes the list of its publications.
    """
    base = counted(spark, sf_dir)
    a = F.when(F.col("l_partkey") % 83 != 0, F.struct(F.lit("a").alias("source"), F.col("n").alias("n")))
    wrong = F.when(F.col("l_partkey") % 89 == 0, F.col("n") + 1).otherwise(F.col("n"))
    b = F.when(F.col("l_partkey") % 97 != 0, F.struct(F.lit("b").alias("source"), wrong.alias("n")))
    back = F.when((F.col("l_partkey") % 97 == 0) & (F.col("l_suppkey") % 2 == 0), F.struct(F.lit("fallback").alias("source"), F.col("n").alias("n")))
    return base.select(*KEYS, F.explode(F.array_compact(F.array(a, b, back))).alias("p")).select(*KEYS, "p.source", "p.n")


THREE_SOURCES = f"""{COUNTED}, published AS (
  SELECT region, area, zone, unit, contest, category, 'a' AS source, n FROM counted WHERE l_partkey % 83 <> 0
  UNION ALL
  SELECT region, area, zone, unit, contest, category, 'b', n + CASE WHEN l_partkey % 89 = 0 THEN 1 ELSE 0 END FROM counted WHERE l_partkey % 97 <> 0
  UNION ALL
  SELECT region, area, zone, unit, contest, category, 'fallback', n FROM counted WHERE l_partkey % 97 = 0 AND l_suppkey % 2 = 0)"""


def unit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by office: totals of three groups of categories, null where a group is absent."""
    from countloom.operators.aggregates import matrix

    offices = counted(spark, sf_dir).withColumn("office", F.substring("category", 1, 1))
    return matrix(offices, ["region", "area", "zone", "unit"], "office", "n", {"R": "p", "N": "g", "A": "s"})


UNIT_MATRIX = f"""{COUNTED}, matrix AS (
  SELECT region, area, zone, unit,
         sum(n) FILTER (WHERE substr(category, 1, 1) = 'R') AS p,
         sum(n) FILTER (WHERE substr(category, 1, 1) = 'N') AS g,
         sum(n) FILTER (WHERE substr(category, 1, 1) = 'A') AS s
  FROM counted GROUP BY region, area, zone, unit)"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts: time, unit, category and count of each event."""
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value").select("event_id", "ts", F.col("user_id").alias("unit"), F.col("event_type").alias("category"), F.floor("value").cast("long").alias("n"))


FEED = "feed AS (SELECT event_id, ts, user_id AS unit, event_type AS category, CAST(floor(value) AS BIGINT) AS n FROM events)"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a published cumulative series: hourly totals of units counted, of all counts and of two categories."""
    from countloom.operators.series import cumulative

    hourly = feed(spark, sf_dir).groupBy(floor_time("hour", "ts").alias("ts")).agg(
        F.count("*").alias("units"), F.sum("n").alias("total"), F.sum(F.when(F.col("category") == "click", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("category") == "view", F.col("n")).otherwise(0)).alias("b")
    )
    return cumulative(hourly, "ts", ["units", "total", "a", "b"])


SNAPSHOTS = f"""{FEED}, hourly AS (
  SELECT date_trunc('hour', ts) AS ts, count(*) AS units, sum(n) AS total,
         sum(CASE WHEN category = 'click' THEN n ELSE 0 END) AS a, sum(CASE WHEN category = 'view' THEN n ELSE 0 END) AS b
  FROM feed GROUP BY 1), snapshots AS (
  SELECT ts, CAST(sum(units) OVER w AS BIGINT) AS units, CAST(sum(total) OVER w AS BIGINT) AS total, CAST(sum(a) OVER w AS BIGINT) AS a, CAST(sum(b) OVER w AS BIGINT) AS b
  FROM hourly WINDOW w AS (ORDER BY ts ROWS UNBOUNDED PRECEDING))"""
