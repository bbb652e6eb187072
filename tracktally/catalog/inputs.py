"""How the test tables stand in for tracks, landfalls, polygons and draws.

A user of ``events`` is a track, an event an observation. Strong errors are the
marked observations (record "L"). Orders are located events with the customer's
nation as the location. Every table is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracktally.functions.numeric import keyed_uniform
from tracktally.session import load_tables, task_count

FIRST_YEAR, LAST_YEAR, HORIZON = 1995, 2001, 5

TRACKS_SQL = """
tracks AS (
  SELECT user_id AS STORM_ID, event_id AS EVENT_ID, ts AS TS,
         CAST(ts AS DATE) AS DATE, strftime(ts, '%H%M') AS TIME,
         CASE WHEN event_type = 'error' AND value >= 150 THEN 'L' ELSE '' END AS RECORD_ID,
         event_type AS STATUS,
         CAST(500 + (event_id * 104729) % 5500 AS DOUBLE) / 100 AS LAT,
         CAST((event_id * 7919) % 7000 - 12000 AS DOUBLE) / 100 AS LON,
         CAST(floor(value) AS INT) AS WIND,
         CAST(900 + event_id % 100 AS INT) AS PRESSURE,
         CAST(year(ts) AS INT) AS YEAR, CAST(month(ts) AS INT) AS MONTH,
         CAST(day(ts) AS INT) AS DAY
  FROM events)"""


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    (events,) = load_tables(spark, folder, "events")
    marked = (F.col("event_type") == "error") & (F.col("value") >= 150)
    return events.select(
        F.col("user_id").alias("STORM_ID"),
        F.col("event_id").alias("EVENT_ID"),
        F.col("ts").alias("TS"),
        F.to_date("ts").alias("DATE"),
        F.date_format("ts", "HHmm").alias("TIME"),
        F.when(marked, "L").otherwise("").alias("RECORD_ID"),
        F.col("event_type").alias("STATUS"),
        ((500 + (F.col("event_id") * 104729) % 5500).cast("double") / 100).alias("LAT"),
        (((F.col("event_id") * 7919) % 7000 - 12000).cast("double") / 100).alias("LON"),
        F.floor("value").cast("int").alias("WIND"),
        (900 + F.col("event_id") % 100).cast("int").alias("PRESSURE"),
        F.year("ts").alias("YEAR"),
        F.month("ts").alias("MONTH"),
        F.dayofmonth("ts").alias("DAY"),
    )


LANDFALLS_SQL = """
landfalls AS (
  SELECT o_orderkey AS STORM_ID, CAST(year(o_orderdate) AS INT) AS YEAR,
         CAST(month(o_orderdate) AS INT) AS MONTH, n_name AS LOCATION
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def dated_orders(spark: SparkSession, folder: str) -> DataFrame:
    (orders,) = load_tables(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("STORM_ID"),
        F.col("o_custkey"),
        F.year("o_orderdate").alias("YEAR"),
        F.month("o_orderdate").alias("MONTH"),
    )


def landfalls(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation = load_tables(spark, folder, "customer", "nation")
    return (
        dated_orders(spark, folder)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("STORM_ID", "YEAR", "MONTH", F.col("n_name").alias("LOCATION"))
    )


EDGES_SQL = """
boxes AS (
  SELECT n_nationkey AS poly_id, n_name AS name_long, r_name AS sovereignt,
         -118.0::DOUBLE + 13 * (n_nationkey % 5) AS x, 7.0::DOUBLE + 10 * (n_nationkey // 5) AS y,
         9.0::DOUBLE AS w, 7.0::DOUBLE AS h
  FROM nation JOIN region ON n_regionkey = r_regionkey),
frames AS (
  SELECT poly_id, name_long, sovereignt, x, y, w, h FROM boxes
  UNION ALL
  SELECT poly_id, name_long, sovereignt, x + 2, y + 2, w - 4, h - 4 FROM boxes WHERE poly_id = 12),
edges AS (
  SELECT poly_id, x AS x1, y AS y1, x + w AS x2, y AS y2 FROM frames UNION ALL
  SELECT poly_id, x + w, y, x + w, y + h FROM frames UNION ALL
  SELECT poly_id, x + w, y + h, x, y + h FROM frames UNION ALL
  SELECT poly_id, x, y + h, x, y FROM frames)"""


def polygons(spark: SparkSession, folder: str) -> DataFrame:
    """One box per nation; nation 12 has a hole."""
    nation, region = load_tables(spark, folder, "nation", "region")
    x = -118.0 + 13 * (F.col("n_nationkey") % 5)
    y = 7.0 + 10 * F.floor(F.col("n_nationkey") / 5)

    def ring(inset: float):
        corners = [(0.0, 0.0), (9.0, 0.0), (9.0, 7.0), (0.0, 7.0)]
        return F.array(*[
            F.struct(
                (x + (dx + inset if dx == 0 else dx - inset)).cast("double").alias("lon"),
                (y + (dy + inset if dy == 0 else dy - inset)).cast("double").alias("lat"),
            )
            for dx, dy in corners
        ])

    holed = F.col("n_nationkey") == 12
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("poly_id"),
        F.col("r_name").alias("sovereignt"),
        F.col("n_name").alias("name_long"),
        F.col("r_name").alias("continent"),
        F.when(holed, F.array(ring(0.0), ring(2.0))).otherwise(F.array(ring(0.0))).alias("rings"),
    )


# --- draws: every customer (or supplier) has an event rate with posterior-like draws ---

CHAINS, ITERATIONS, WARMUP = 3, 50, 10

UNIFORM_SQL = (
    "(CAST(('0x' || substr(md5(concat_ws('|', {key})), 1, 8))::BIGINT AS DOUBLE) + 0.5)"
    " / 4294967296.0::DOUBLE"
)


def uniform_sql(*key: str) -> str:
    return UNIFORM_SQL.format(key=", ".join(key))


CUSTOMER_SQL = """
rates AS (
  SELECT c_custkey + 1 AS idx, c_nationkey, count(o_orderkey) AS n
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""

SUPPLIER_SQL = """
rates AS (
  SELECT s_suppkey + 1 AS idx, s_nationkey, count(l_orderkey) AS n
  FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)"""

DRAWS_SQL = f"""
draws AS (
  SELECT r.*, CAST(c.range + 1 AS INT) AS chain, CAST(i.range + 1 AS INT) AS iteration,
         CAST(c.range * {ITERATIONS} + i.range + 1 AS INT) AS draw, i.range < {WARMUP} AS is_warmup,
         floor(16777216 * (ln((n + 0.5::DOUBLE) / 7) + 0.6::DOUBLE
           * ({uniform_sql('42', 'c.range + 1', 'i.range + 1', 'idx')} - 0.5::DOUBLE)))
           / 16777216.0::DOUBLE AS value
  FROM rates r, range({CHAINS}) c, range({ITERATIONS}) i),
kept AS (SELECT * FROM draws WHERE NOT is_warmup)"""


def customer_rates(spark: SparkSession, folder: str) -> DataFrame:
    customer, orders = load_tables(spark, folder, "customer", "orders")
    counts = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return customer.join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        (F.col("c_custkey") + 1).alias("idx"), "c_nationkey", F.coalesce("n", F.lit(0)).alias("n")
    )


def supplier_rates(spark: SparkSession, folder: str) -> DataFrame:
    supplier, lineitem = load_tables(spark, folder, "supplier", "lineitem")
    counts = lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return supplier.join(counts, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        (F.col("s_suppkey") + 1).alias("idx"), "s_nationkey", F.coalesce("n", F.lit(0)).alias("n")
    )


def draws_of(rates: DataFrame, base: str = "log_lambda", by: str = "idx") -> DataFrame:
    """Long draws around each rate; the noise depends on (chain, iteration, idx) only.

    The rates are spread before they are multiplied: one short row per element moves
    instead of all its draws, and later groupings by the element need no shuffle.
    """
    steps = (
        rates.repartition(task_count(rates.sparkSession), by).withColumn("chain", F.explode(F.sequence(F.lit(1), F.lit(CHAINS))))
        .withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(ITERATIONS))))
    )
    noise = keyed_uniform(42, F.col("chain"), F.col("iteration"), F.col("idx")) - 0.5
    return steps.withColumns({
        "draw": (F.col("chain") - 1) * ITERATIONS + F.col("iteration"),
        "is_warmup": F.col("iteration") <= WARMUP,
        "base": F.lit(base),
        # 24 binary places, so that both engines start from the very same numbers
        "value": F.floor(16777216 * (F.ln((F.col("n") + 0.5) / 7) + 0.6 * noise)) / 16777216.0,
    })
