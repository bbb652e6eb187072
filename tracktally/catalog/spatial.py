"""Spatial queries over event positions and nation boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracktally.catalog import Catalog
from tracktally.catalog.inputs import EDGES_SQL, TRACKS_SQL, polygons, tracks
from tracktally.operators import spatial as ops
from tracktally.operators.sphere import nearest_on_sphere
from tracktally.plans.explore import location_totals
from tracktally.plans.wrangle import enrich_landfalls
from tracktally.session import written_once
from tracktally.sources import polygons as shapes

catalog = Catalog()

INSIDE_SQL = """
inside AS (
  SELECT EVENT_ID, min(poly_id) AS poly_id FROM (
    SELECT EVENT_ID, poly_id
    FROM tracks JOIN edges ON LAT BETWEEN least(y1, y2) AND greatest(y1, y2)
    GROUP BY ALL
    HAVING count(*) FILTER ((y1 > LAT) <> (y2 > LAT) AND LON < x1 + (LAT - y1) * (x2 - x1) / (y2 - y1)) % 2 = 1
        OR count(*) FILTER (LON BETWEEN least(x1, x2) AND greatest(x1, x2) AND (x2 - x1) * (LAT - y1) = (y2 - y1) * (LON - x1)) > 0
  ) GROUP BY 1)"""

NEAREST_SQL = """
steps AS (
  SELECT EVENT_ID, poly_id, (x1 - LON) * cos(radians(LAT)) AS ax, y1 - LAT AS ay,
         (x2 - x1) * cos(radians(LAT)) AS dx, y2 - y1 AS dy
  FROM tracks ANTI JOIN inside USING (EVENT_ID), edges),
apart AS (
  SELECT EVENT_ID, poly_id, ax, ay, dx, dy,
         greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM steps),
nearest AS (
  SELECT EVENT_ID, min((round(sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2), 9), poly_id)) AS best
  FROM apart GROUP BY 1)"""


@catalog.add(f"""
WITH {TRACKS_SQL}, {EDGES_SQL}, {INSIDE_SQL}
SELECT EVENT_ID, LON, LAT, poly_id, name_long, sovereignt
FROM tracks LEFT JOIN inside USING (EVENT_ID) LEFT JOIN boxes USING (poly_id)""")
def point_in_polygon(spark, folder):
    points = tracks(spark, folder).select("EVENT_ID", "LON", "LAT")
    shape = shapes.on_continents(
        polygons(spark, folder), "AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"
    )
    return ops.contained(points, shape, ["name_long", "sovereignt"], "EVENT_ID")


@catalog.add(f"""
WITH {TRACKS_SQL}, {EDGES_SQL},
corners AS (
  SELECT EVENT_ID, STORM_ID, CAST(-118 + 13 * (STORM_ID % 6) + 9 * (EVENT_ID % 2) AS DOUBLE) AS LON,
         CAST(7 + 10 * (EVENT_ID % 6) + (STORM_ID % 8) AS DOUBLE) AS LAT FROM tracks),
met AS (
  SELECT EVENT_ID, min(poly_id) AS poly_id FROM corners JOIN boxes
    ON LON BETWEEN x AND x + w AND LAT BETWEEN y AND y + h
   AND NOT (poly_id = 12 AND LON > x + 2 AND LON < x + w - 2 AND LAT > y + 2 AND LAT < y + h - 2) GROUP BY 1)
SELECT EVENT_ID, LON, LAT, poly_id, name_long FROM corners LEFT JOIN met USING (EVENT_ID) LEFT JOIN boxes USING (poly_id)""")
def border_points(spark, folder):
    """Events moved onto the borders and corners of the boxes."""
    lon = (-118 + 13 * (F.col("STORM_ID") % 6) + 9 * (F.col("EVENT_ID") % 2)).cast("double")
    lat = (7 + 10 * (F.col("EVENT_ID") % 6) + F.col("STORM_ID") % 8).cast("double")
    points = tracks(spark, folder).select("EVENT_ID", lon.alias("LON"), lat.alias("LAT"))
    return ops.contained(points, polygons(spark, folder), ["name_long"], "EVENT_ID")


@catalog.add(f"""
WITH {TRACKS_SQL}, {EDGES_SQL}, {INSIDE_SQL}, {NEAREST_SQL}
SELECT EVENT_ID, best[2] AS near_id, round(best[1], 6) AS near_distance FROM nearest""")
def nearest_polygon(spark, folder):
    points = tracks(spark, folder).select("EVENT_ID", "LON", "LAT")
    shape = polygons(spark, folder)
    sides = written_once(shapes.edges(shape), "edges")
    inside = ops.contained(points, shape, [], "EVENT_ID", sides=sides)
    outside = inside.filter(F.col("poly_id").isNull())
    near = ops.nearest(outside, shape, sides=sides)
    return outside.join(near, ["LON", "LAT"]).select(
        "EVENT_ID", "near_id", F.round("near_distance", 6).alias("near_distance")
    )


def _vector_sql(name, lon, lat):
    return (f"cos(radians({lat})) * cos(radians({lon})) AS {name}x, cos(radians({lat})) * sin(radians({lon})) AS {name}y, "
            f"sin(radians({lat})) AS {name}z")


def _chord_sql(a, b):
    return f"2 * asin(least(1, sqrt(({a}x - {b}x) ** 2 + ({a}y - {b}y) ** 2 + ({a}z - {b}z) ** 2) / 2))"


@catalog.add(f"""
WITH {TRACKS_SQL}, {EDGES_SQL},
moved AS (SELECT EVENT_ID, LON * 5 + 420 AS lo, LAT * 3 - 90 AS la FROM tracks),
placed AS (SELECT EVENT_ID, CASE WHEN lo > 180 THEN lo - 360 WHEN lo < -180 THEN lo + 360 ELSE lo END AS LON, la AS LAT FROM moved),
p AS (SELECT EVENT_ID, {_vector_sql("p", "LON", "LAT")} FROM placed),
e AS (SELECT poly_id, {_vector_sql("a", "(x1 + 260)", "(y1 * 1.5 - 5)")}, {_vector_sql("q", "(x2 + 260)", "(y2 * 1.5 - 5)")} FROM edges),
n AS (SELECT *, ay * qz - az * qy AS nx, az * qx - ax * qz AS ny, ax * qy - ay * qx AS nz FROM e),
d AS (
  SELECT EVENT_ID, poly_id,
         CASE WHEN px * (ny * az - nz * ay) + py * (nz * ax - nx * az) + pz * (nx * ay - ny * ax) > 0
               AND px * (qy * nz - qz * ny) + py * (qz * nx - qx * nz) + pz * (qx * ny - qy * nx) > 0
              THEN asin(least(1, abs(px * nx + py * ny + pz * nz) / sqrt(nx ** 2 + ny ** 2 + nz ** 2)))
              ELSE least({_chord_sql("p", "a")}, {_chord_sql("p", "q")}) END AS d
  FROM p, n),
best AS (SELECT EVENT_ID, min((round(degrees(d), 9), poly_id)) AS best FROM d GROUP BY 1)
SELECT EVENT_ID, best[2] AS near_id, CAST(floor(best[1] * 1e6 + 0.50025) AS BIGINT) AS near_microdegrees FROM best""")
def nearest_on_globe(spark, folder):
    """Positions around the globe and boxes on both sides of the antimeridian, by great circles."""
    wide = F.col("LON") * 5 + 420
    lon = F.when(wide > 180, wide - 360).when(wide < -180, wide + 360).otherwise(wide)
    points = tracks(spark, folder).select("EVENT_ID", lon.alias("LON"), (F.col("LAT") * 3 - 90).alias("LAT"))
    moved = F.transform("rings", lambda ring: F.transform(
        ring, lambda p: F.struct((p["lon"] + 260).alias("lon"), (p["lat"] * 1.5 - 5).alias("lat"))))
    near = nearest_on_sphere(points, polygons(spark, folder).withColumn("rings", moved))
    return points.join(near, ["LON", "LAT"]).select(
        "EVENT_ID", "near_id", F.floor(F.col("near_distance") * 1e6 + 0.50025).alias("near_microdegrees"))  # no tie of rounded digits


@catalog.add(f"""
WITH {TRACKS_SQL}, {EDGES_SQL}, {INSIDE_SQL}, {NEAREST_SQL}
SELECT EVENT_ID, STORM_ID, LON, LAT, sovereignt AS COUNTRY, name_long AS LOCATION
FROM tracks LEFT JOIN inside USING (EVENT_ID) LEFT JOIN nearest USING (EVENT_ID)
JOIN boxes ON boxes.poly_id = coalesce(inside.poly_id, best[2])
WHERE RECORD_ID = 'L'""")
def landfall_enrich(spark, folder):
    out = enrich_landfalls(tracks(spark, folder), polygons(spark, folder), "EVENT_ID")
    return out.select("EVENT_ID", "STORM_ID", "LON", "LAT", "COUNTRY", "LOCATION")


@catalog.add(f"""
WITH {TRACKS_SQL}, {EDGES_SQL}, {INSIDE_SQL}, {NEAREST_SQL}
SELECT name_long AS LOCATION, count(*) AS N_EVENTS
FROM tracks LEFT JOIN inside USING (EVENT_ID) LEFT JOIN nearest USING (EVENT_ID)
JOIN boxes ON boxes.poly_id = coalesce(inside.poly_id, best[2]) GROUP BY 1""")
def located_event_counts(spark, folder):
    out = ops.locate(tracks(spark, folder), polygons(spark, folder), {"name_long": "LOCATION"}, "EVENT_ID")
    return out.groupBy("LOCATION").agg(F.count("*").alias("N_EVENTS"))


@catalog.add(f"""
WITH {TRACKS_SQL}, {EDGES_SQL}, {INSIDE_SQL}, {NEAREST_SQL},
counts AS (
  SELECT name_long, count(*) AS n
  FROM tracks LEFT JOIN inside USING (EVENT_ID) LEFT JOIN nearest USING (EVENT_ID)
  JOIN boxes ON boxes.poly_id = coalesce(inside.poly_id, best[2]) WHERE RECORD_ID = 'L' GROUP BY 1),
corners AS (
  SELECT poly_id, name_long, CASE WHEN w < 9 THEN 1 ELSE 0 END AS ring, c.o,
         x + w * c.dx AS long, y + h * c.dy AS lat
  FROM frames, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) c(o, dx, dy))
SELECT poly_id, name_long, CAST(ring AS INT) AS "group", CAST(o AS INT) AS ord, long, lat,
       coalesce(n, 0) AS LANDFALL_NUM
FROM corners LEFT JOIN counts USING (name_long)""")
def choropleth_outline(spark, folder):
    """Map table: polygon corners with the number of marked events of the polygon."""
    shape = polygons(spark, folder)
    found = enrich_landfalls(tracks(spark, folder), shape, "EVENT_ID")
    totals = location_totals(shape.select("poly_id", "name_long"), found, "name_long")
    return shapes.outline(shape).join(totals, "poly_id").select(
        "poly_id", "name_long", "group", "ord", "long", "lat", "LANDFALL_NUM"
    )
