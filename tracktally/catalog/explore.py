"""Descriptive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracktally.catalog import Catalog
from tracktally.catalog.inputs import (
    FIRST_YEAR, LANDFALLS_SQL, LAST_YEAR, TRACKS_SQL, dated_orders, landfalls, tracks,
)
from tracktally.functions.text import int_part
from tracktally.operators import counts as ops
from tracktally.plans import explore as plans
from tracktally.session import load_tables

catalog = Catalog()

# Wind-speed break points of the colour scale, in knots.
WIND_BREAKS = (0, 33, 63, 82, 95, 112, 137)

MONTH_AVG_SQL = f"""
WITH counts AS (
  SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ALL),
grid AS (
  SELECT m.range AS m, y.range AS y
  FROM range(1, 13) m, range({FIRST_YEAR}, {LAST_YEAR + 1}) y)
SELECT CAST(grid.m AS INT) AS MONTH_ID, monthname(make_date(2000, grid.m, 1)) AS MONTH,
       round(avg(coalesce(n, 0)), 6) AS AVG_LANDFALLS
FROM grid LEFT JOIN counts USING (m, y) GROUP BY ALL"""


@catalog.add(MONTH_AVG_SQL)
def month_avg_grid(spark, folder):
    out = plans.average_per_month(dated_orders(spark, folder), FIRST_YEAR, LAST_YEAR)
    return out.withColumn("AVG_LANDFALLS", F.round("AVG_LANDFALLS", 6))


@catalog.add("SELECT CAST(year(o_orderdate) AS INT) AS YEAR, count(*) AS CYCLONE_NUM FROM orders GROUP BY 1")
def year_counts(spark, folder):
    return plans.landfalls_per_year(dated_orders(spark, folder)).orderBy("YEAR")


@catalog.add(f"""
WITH {TRACKS_SQL}, per AS (
  SELECT STORM_ID, sum(CASE WHEN RECORD_ID = 'L' THEN 1 ELSE 0 END) AS n FROM tracks GROUP BY 1)
SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' ELSE '>2' END AS CATEGORY,
       count(*) AS NUM
FROM per GROUP BY 1""")
def storm_landfall_classes(spark, folder):
    return plans.tracks_by_landfalls(tracks(spark, folder))


@catalog.add(f"""
WITH {TRACKS_SQL}
SELECT STORM_ID, EVENT_ID, date_trunc('minute', TS) AS DATE_TIME,
       row_number() OVER w AS SEQ, LON, LAT, WIND,
       lead(LON) OVER w AS NEXT_LON, lead(LAT) OVER w AS NEXT_LAT, lead(WIND) OVER w AS NEXT_WIND
FROM tracks WHERE STORM_ID IN (SELECT STORM_ID FROM tracks WHERE RECORD_ID = 'L')
WINDOW w AS (PARTITION BY STORM_ID ORDER BY TS, EVENT_ID)""")
def landfall_paths(spark, folder):
    # the time of day goes through an integer, as a type-inferring CSV reader leaves it
    source = tracks(spark, folder).withColumn("TIME", F.col("TIME").cast("int"))
    out = plans.landfalling_paths(source, ["TS", "EVENT_ID"], "TS")
    return out.select("STORM_ID", "EVENT_ID", "DATE_TIME", "SEQ", "LON", "LAT", "WIND",
                      "NEXT_LON", "NEXT_LAT", "NEXT_WIND")


@catalog.add(f"""
WITH {LANDFALLS_SQL}, counts AS (SELECT LOCATION, count(*) AS n FROM landfalls GROUP BY 1)
SELECT n_name AS name_long, n_nationkey, coalesce(n, 0) AS LANDFALL_NUM
FROM nation LEFT JOIN counts ON n_name = LOCATION
ORDER BY LANDFALL_NUM DESC, name_long LIMIT 10""")
def top_locations(spark, folder):
    (nation,) = load_tables(spark, folder, "nation")
    features = nation.select(F.col("n_name").alias("name_long"), "n_nationkey")
    return plans.top_locations(features, landfalls(spark, folder), "name_long")


@catalog.add(f"""
WITH {LANDFALLS_SQL}, counts AS (SELECT LOCATION, count(*) AS n FROM landfalls GROUP BY 1)
SELECT n_name AS name_long, coalesce(n, 0) AS LANDFALL_NUM
FROM nation LEFT JOIN counts ON n_name = LOCATION""")
def location_totals(spark, folder):
    (nation,) = load_tables(spark, folder, "nation")
    features = nation.select(F.col("n_name").alias("name_long"))
    return plans.location_totals(features, landfalls(spark, folder), "name_long")


# Label offsets in degrees of longitude.
LABEL_SHIFT = {"NATION_3": 10.0, "NATION_5": 5.0, "NATION_7": 2.5, "NATION_11": 9.5}


@catalog.add(f"""
WITH {LANDFALLS_SQL}
SELECT STORM_ID, LOCATION,
       CASE LOCATION WHEN 'NATION_3' THEN 10.0::DOUBLE WHEN 'NATION_5' THEN 5.0
                     WHEN 'NATION_7' THEN 2.5 WHEN 'NATION_11' THEN 9.5 ELSE 0.0 END AS NUDGE_X
FROM landfalls WHERE LOCATION <> 'NATION_0'""")
def label_lookup_default(spark, folder):
    found = landfalls(spark, folder).filter(F.col("LOCATION") != "NATION_0")
    return found.select(
        "STORM_ID", "LOCATION", ops.label_value(F.col("LOCATION"), LABEL_SHIFT).alias("NUDGE_X")
    )


def _wind_band_sql() -> str:
    arms = []
    for i, (lo, hi) in enumerate(zip(WIND_BREAKS, WIND_BREAKS[1:]), start=1):
        last = i == len(WIND_BREAKS) - 1
        arms.append(f"WHEN WIND >= {lo} AND WIND {'<=' if last else '<'} {hi} THEN {i}")
    return " ".join(arms)


@catalog.add(f"""
WITH {TRACKS_SQL}, lim AS (SELECT min(PRESSURE) AS lo, max(PRESSURE) AS hi FROM tracks)
SELECT EVENT_ID, CASE WHEN WIND BETWEEN 0 AND 137 THEN WIND END AS SCALE_WIND,
       round(CASE WHEN WIND BETWEEN 0 AND 137 THEN WIND / 137.0::DOUBLE END, 6) AS SCALE_POSITION,
       CASE {_wind_band_sql()} END AS WIND_BAND,
       round((PRESSURE - lo) / CAST(hi - lo AS DOUBLE), 6) AS PRESSURE_POSITION
FROM tracks, lim""")
def wind_scale_bands(spark, folder):
    source = tracks(spark, folder)
    wind = ops.in_scale(F.col("WIND"), WIND_BREAKS[0], WIND_BREAKS[-1])
    lowest = source.select(F.min("PRESSURE")).scalar()
    highest = source.select(F.max("PRESSURE")).scalar()
    return source.select(
        "EVENT_ID",
        wind.alias("SCALE_WIND"),
        F.round(ops.rescale(wind, WIND_BREAKS[0], WIND_BREAKS[-1]), 6).alias("SCALE_POSITION"),
        ops.band(F.col("WIND"), WIND_BREAKS).alias("WIND_BAND"),
        F.round(ops.rescale(F.col("PRESSURE"), lowest, highest), 6).alias("PRESSURE_POSITION"),
    )


@catalog.add(f"""
WITH {TRACKS_SQL}
SELECT CASE WHEN STORM_ID % 2 = 0 THEN 'atlantic' ELSE 'pacific' END AS BASIN,
       CAST(substr(strftime(TS, '%Y%m%d'), 5, 2) AS INT) AS MONTH,
       CAST(substr(strftime(TS, '%Y%m%d'), 7, 2) AS INT) AS DAY,
       EVENT_ID, STORM_ID, RECORD_ID
FROM tracks WHERE year(TS) >= 2000 AND RECORD_ID = 'L'""")
def union_basins_filter(spark, folder):
    source = tracks(spark, folder).withColumn("DATE", F.date_format("TS", "yyyyMMdd"))
    east = source.filter(F.col("STORM_ID") % 2 == 0).withColumn("BASIN", F.lit("atlantic"))
    west = source.filter(F.col("STORM_ID") % 2 != 0).withColumn("BASIN", F.lit("pacific"))
    both = east.unionByName(west).filter(int_part(F.col("DATE"), 1, 4) >= 2000)
    return both.filter(F.col("RECORD_ID") == "L").select(
        "BASIN",
        int_part(F.col("DATE"), 5, 2).alias("MONTH"),
        int_part(F.col("DATE"), 7, 2).alias("DAY"),
        "EVENT_ID", "STORM_ID", "RECORD_ID",
    )


@catalog.add(f"""
WITH {TRACKS_SQL}
SELECT EVENT_ID, LON, LAT FROM tracks
WHERE LON BETWEEN -100 AND -80 AND LAT BETWEEN 10 AND 30""")
def bbox_window(spark, folder):
    box = ops.bounding_box(tracks(spark, folder), "LON", "LAT", -100, -80, 10, 30)
    return box.select("EVENT_ID", "LON", "LAT")
