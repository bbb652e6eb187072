"""Cells and rates of the count models over orders; the customer's nation is the segment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracktally.catalog import Catalog
from tracktally.catalog.inputs import (
    DRAWS_SQL, FIRST_YEAR, HORIZON, LANDFALLS_SQL, LAST_YEAR, dated_orders, draws_of, landfalls,
)
from tracktally.operators.counts import count_by
from tracktally.operators.fit import poisson_regression
from tracktally.operators.grid import months, with_years, zero_filled
from tracktally.operators.regression import Smooth, fit_poisson
from tracktally.plans import models
from tracktally.session import load_tables

catalog = Catalog()

# the years the cells are asked for leave out the first and the last year of the table
INNER_FIRST, INNER_LAST = FIRST_YEAR + 1, LAST_YEAR - 1


def _cells(cells, name):
    return cells.select(name, F.posexplode("y").alias("cell", "n")).select(
        name, (F.col("cell") + 1).alias("cell"), F.col("n").cast("bigint").alias("n")
    )


@catalog.add(f"""
WITH {LANDFALLS_SQL},
counts AS (
  SELECT LOCATION AS nation, MONTH AS m, count(*) AS n FROM landfalls
  WHERE YEAR BETWEEN {INNER_FIRST} AND {INNER_LAST} GROUP BY ALL),
every AS (SELECT nation, c.range AS m FROM (SELECT DISTINCT nation FROM counts), range(1, 13) c)
SELECT nation, CAST(m AS INT) AS cell, coalesce(n, 0) AS n FROM every LEFT JOIN counts USING (nation, m)""")
def month_model_cells(spark, folder):
    source = landfalls(spark, folder).withColumnRenamed("LOCATION", "nation")
    return _cells(models.month_cells(source, "nation", INNER_FIRST, INNER_LAST), "nation")


@catalog.add(f"""
WITH {LANDFALLS_SQL},
counts AS (
  SELECT LOCATION AS nation, (MONTH - 1) * {INNER_LAST - INNER_FIRST + 1} + YEAR - {INNER_FIRST} + 1 AS c, count(*) AS n
  FROM landfalls WHERE YEAR BETWEEN {INNER_FIRST} AND {INNER_LAST} GROUP BY ALL),
every AS (
  SELECT nation, c.range AS c
  FROM (SELECT DISTINCT nation FROM counts), range(1, {12 * (INNER_LAST - INNER_FIRST + 1) + 1}) c)
SELECT nation, CAST(c AS INT) AS cell, coalesce(n, 0) AS n FROM every LEFT JOIN counts USING (nation, c)""")
def month_year_model_cells(spark, folder):
    source = landfalls(spark, folder).withColumnRenamed("LOCATION", "nation")
    return _cells(models.month_year_cells(source, "nation", INNER_FIRST, INNER_LAST), "nation")


@catalog.add(f"""
WITH source AS (
  SELECT c_mktsegment AS market, n_name AS LOCATION
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE year(o_orderdate) BETWEEN {INNER_FIRST} AND {INNER_LAST}),
ids AS (
  SELECT LOCATION, row_number() OVER (ORDER BY LOCATION) AS cell
  FROM (SELECT LOCATION FROM source GROUP BY 1 ORDER BY count(*) DESC, LOCATION LIMIT 30)),
counts AS (SELECT market, LOCATION, count(*) AS n FROM source GROUP BY ALL)
SELECT market, CAST(cell AS INT) AS cell, coalesce(n, 0) AS n
FROM (SELECT DISTINCT market FROM source) CROSS JOIN ids LEFT JOIN counts USING (market, LOCATION)""")
def location_model_cells(spark, folder):
    """Asked for more locations than there are."""
    customer, nation = load_tables(spark, folder, "customer", "nation")
    source = (
        dated_orders(spark, folder).join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_mktsegment").alias("market"), F.col("n_name").alias("LOCATION"), "YEAR")
    )
    cells, _ = models.location_cells(source, "market", INNER_FIRST, INNER_LAST, k=30)
    return _cells(cells, "market")


MODEL_DRAWS_SQL = f"""
rates AS (
  SELECT c_mktsegment AS SEGMENT, CAST(c_nationkey + 1 AS INT) AS idx, count(o_orderkey) AS n
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL), {DRAWS_SQL},
shared AS (SELECT SEGMENT, draw, avg(value) AS m FROM kept GROUP BY ALL)"""


@catalog.add(f"""
WITH {MODEL_DRAWS_SQL},
z AS (
  SELECT SEGMENT, draw, x.range AS t, sum((value - m) * sqrt(sqrt(2 * pi()) * 0.4::DOUBLE) * 0.5::DOUBLE
           * exp(-0.25::DOUBLE * (0.4::DOUBLE * pi() / 2 / 1.2::DOUBLE) ** 2 * idx ** 2)
           * sin(pi() / 2.4::DOUBLE * (x.range / {LAST_YEAR + HORIZON - FIRST_YEAR}::DOUBLE * 2 - 1 + 1.2::DOUBLE) * idx)
           / sqrt(1.2::DOUBLE)) AS f
  FROM kept JOIN shared USING (SEGMENT, draw), range({LAST_YEAR + HORIZON - FIRST_YEAR + 1}) x GROUP BY ALL)
SELECT SEGMENT, draw, idx, CAST({FIRST_YEAR} + t AS INT) AS YEAR, round(m + value - m + f, 6) AS log_lambda
FROM kept JOIN shared USING (SEGMENT, draw) JOIN z USING (SEGMENT, draw)""")
def month_year_rates(spark, folder):
    """Rates read off draws of effects, intercept and smooth weights, per market."""
    customer, orders = load_tables(spark, folder, "customer", "orders")
    rates = (
        customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
        .groupBy(F.col("c_mktsegment").alias("SEGMENT"), (F.col("c_nationkey") + 1).cast("int").alias("idx"))
        .agg(F.count("o_orderkey").alias("n"))
    )
    wide = draws_of(rates).select("SEGMENT", "draw", "is_warmup", "idx", "value")
    means = wide.groupBy("SEGMENT", "draw", "is_warmup").agg(F.avg("value").alias("m"))
    own = wide.join(means, ["SEGMENT", "draw", "is_warmup"]).withColumn(
        "e", F.explode(F.array(
            F.struct(F.lit("beta").alias("base"), F.col("idx").alias("idx"), (F.col("value") - F.col("m")).alias("value")),
            F.struct(F.lit("z").alias("base"), F.col("idx").alias("idx"), (F.col("value") - F.col("m")).alias("value")),
        ))
    ).select("SEGMENT", "draw", "is_warmup", "e.*")
    nothing = F.lit(None).cast("int").alias("idx")
    scalars = means.withColumn("e", F.explode(F.array(
        F.struct(F.lit("beta_0").alias("base"), nothing, F.col("m").alias("value")),
        F.struct(F.lit("gp_lengthscale").alias("base"), nothing, F.lit(0.4).alias("value")),
        F.struct(F.lit("gp_sigma").alias("base"), nothing, F.lit(0.5).alias("value")),
    ))).select("SEGMENT", "draw", "is_warmup", "e.*")
    out = models.month_year_rates(own.unionByName(scalars), FIRST_YEAR, LAST_YEAR, HORIZON, ["SEGMENT"])
    return out.withColumn("log_lambda", F.round("log_lambda", 6))


@catalog.add(f"""
WITH counts AS (
  SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL),
grid AS (SELECT m.range AS m, y.range AS y FROM range(1, 13) m, range({FIRST_YEAR}, {LAST_YEAR + 1}) y)
SELECT monthname(make_date(2000, m, 1)) AS category, round(ln(avg(coalesce(n, 0))), 4) AS coefficient
FROM grid LEFT JOIN counts USING (m, y) GROUP BY m""")
def poisson_glm(spark, folder):
    counts = count_by(dated_orders(spark, folder), "YEAR", "MONTH", name="n").withColumnRenamed(
        "MONTH", "MONTH_ID"
    )
    grid = with_years(months(spark).select("MONTH_ID", "MONTH"), FIRST_YEAR, LAST_YEAR)
    cells = zero_filled(grid, counts, ["MONTH_ID", "YEAR"], "n")
    out = poisson_regression(cells, "MONTH", "n")
    return out.withColumn("coefficient", F.round("coefficient", 4))


TERMS = Smooth("YEAR", FIRST_YEAR, LAST_YEAR, 3)
TERM_SQL = f"sin(pi() / 2.4::DOUBLE * ((YEAR - {FIRST_YEAR}) / {LAST_YEAR - FIRST_YEAR}::DOUBLE * 2 - 1 + 1.2::DOUBLE) * j.range) / sqrt(1.2::DOUBLE)"


@catalog.add(f"""
WITH {LANDFALLS_SQL},
inner_years AS (SELECT * FROM landfalls WHERE YEAR BETWEEN {FIRST_YEAR} AND {LAST_YEAR}),
sums AS (
  SELECT 'MONTH' AS term, CAST(m.range AS VARCHAR) AS level, CAST(count(YEAR) AS DOUBLE) AS n
  FROM range(1, 13) m LEFT JOIN inner_years ON MONTH = m.range GROUP BY ALL
  UNION ALL
  SELECT 'LOCATION', n_name, CAST(count(YEAR) AS DOUBLE) FROM nation LEFT JOIN inner_years ON LOCATION = n_name GROUP BY ALL
  UNION ALL
  SELECT 'YEAR', CAST(j.range AS VARCHAR), sum({TERM_SQL}) FROM inner_years, range(1, 4) j GROUP BY ALL)
SELECT term, level, round(n, 3) + 0.0 AS observed, round(n, 3) + 0.0 AS fitted FROM sums""")
def poisson_terms(spark, folder):
    """Month, location and a smooth year effect together: where fitted equals observed, the score is zero."""
    (nation,) = load_tables(spark, folder, "nation")
    places = nation.select(F.col("n_name").alias("LOCATION"))
    grid = with_years(places.withColumn("MONTH", F.explode(F.sequence(F.lit(1), F.lit(12)))), FIRST_YEAR, LAST_YEAR)
    counts = count_by(landfalls(spark, folder), "LOCATION", "MONTH", "YEAR", name="n")
    cells = zero_filled(grid, counts, ["LOCATION", "MONTH", "YEAR"], "n")
    found = fit_poisson(cells, ["MONTH", "LOCATION"], "n", [TERMS]).moments(cells, "n")
    return found.select("term", "level", *((F.round(c, 3) + 0.0).alias(c) for c in ("observed", "fitted")))
