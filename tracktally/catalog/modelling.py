"""Modelling grids over orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracktally.catalog import Catalog
from tracktally.catalog.inputs import (
    FIRST_YEAR, HORIZON, LANDFALLS_SQL, LAST_YEAR, dated_orders, landfalls,
)
from tracktally.operators.grid import count_cast
from tracktally.plans import modelling as plans

catalog = Catalog()

END_YEAR = LAST_YEAR + HORIZON
SPAN = LAST_YEAR - FIRST_YEAR + 1

MONTH_GRID_SQL = f"""
counts AS (
  SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL),
cells AS (
  SELECT y.range AS y, m.range AS m, monthname(make_date(2000, m.range, 1)) AS name
  FROM range({FIRST_YEAR}, {END_YEAR + 1}) y, range(1, 13) m),
obs AS (
  SELECT y, m, name, coalesce(n, 0) AS c, row_number() OVER (ORDER BY m, y) AS obs_id,
         NULL::BIGINT AS pred_id
  FROM cells LEFT JOIN counts USING (y, m) WHERE y <= {LAST_YEAR}),
pred AS (
  SELECT y, m, name, NULL::BIGINT AS c, NULL::BIGINT AS obs_id,
         row_number() OVER (ORDER BY y, name) AS pred_id
  FROM cells WHERE y > {LAST_YEAR}),
month_grid AS (
  SELECT CAST(y AS INT) AS YEAR, name AS MONTH, CAST(m AS INT) AS MONTH_ID, CAST(c AS INT) AS LANDFALL_COUNT,
         CAST(obs_id AS INT) AS OBS_ID, CAST(pred_id AS INT) AS PRED_ID,
         (y - {FIRST_YEAR}) / {END_YEAR - FIRST_YEAR}.0::DOUBLE * 2 - 1 AS DATE,
         CAST(row_number() OVER (ORDER BY obs_id NULLS LAST, pred_id) AS INT) AS ALL_ID
  FROM (SELECT * FROM obs UNION ALL SELECT * FROM pred))"""


@catalog.add(f"""
WITH {MONTH_GRID_SQL}
SELECT YEAR, MONTH, MONTH_ID, LANDFALL_COUNT, OBS_ID, PRED_ID, round(DATE, 6) AS DATE, ALL_ID
FROM month_grid""")
def month_grid_model(spark, folder):
    grid = plans.monthly_grid(dated_orders(spark, folder), FIRST_YEAR, LAST_YEAR, HORIZON)
    return grid.withColumn("DATE", F.round("DATE", 6))


TOP_SQL = """
top AS (SELECT LOCATION, count(*) AS n FROM landfalls GROUP BY 1 ORDER BY n DESC, LOCATION LIMIT 10),
dim AS (SELECT LOCATION, row_number() OVER (ORDER BY LOCATION) AS loc_id FROM top)"""


@catalog.add(f"""
WITH {LANDFALLS_SQL}, {TOP_SQL},
counts AS (SELECT YEAR AS y, LOCATION, count(*) AS n FROM landfalls SEMI JOIN top USING (LOCATION) GROUP BY ALL),
cells AS (SELECT y.range AS y, LOCATION, loc_id FROM range({FIRST_YEAR}, {END_YEAR + 1}) y, dim),
numbered AS (
  SELECT y, LOCATION, loc_id,
         CASE WHEN y <= {LAST_YEAR} THEN coalesce(n, 0) END AS c,
         CASE WHEN y <= {LAST_YEAR} THEN row_number() OVER (PARTITION BY y <= {LAST_YEAR} ORDER BY LOCATION, y) END AS obs_id,
         CASE WHEN y > {LAST_YEAR} THEN row_number() OVER (PARTITION BY y <= {LAST_YEAR} ORDER BY y, LOCATION) END AS pred_id
  FROM cells LEFT JOIN counts USING (y, LOCATION))
SELECT CAST(row_number() OVER (ORDER BY obs_id NULLS LAST, pred_id) AS INT) AS ALL_ID, CAST(y AS INT) AS YEAR,
       LOCATION, CAST(loc_id AS INT) AS LOC_ID, CAST(c AS INT) AS LANDFALL_NBR, CAST(obs_id AS INT) AS OBS_ID,
       CAST(pred_id AS INT) AS PRED_ID,
       {", ".join(f'CAST(loc_id = {k} AS INT) AS "{k}"' for k in range(1, 11))}
FROM numbered""")
def location_grid_onehot(spark, folder):
    return plans.location_grid(landfalls(spark, folder), FIRST_YEAR, LAST_YEAR, HORIZON)


@catalog.add(f"""
WITH {LANDFALLS_SQL}
SELECT LOCATION, {", ".join(f'count(*) FILTER (YEAR = {y}) AS "{y}"' for y in range(FIRST_YEAR, LAST_YEAR + 1))}
FROM landfalls GROUP BY 1""")
def count_cast_years(spark, folder):
    years = list(range(FIRST_YEAR, LAST_YEAR + 1))
    return count_cast(landfalls(spark, folder), "LOCATION", "YEAR", years)
