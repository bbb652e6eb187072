"""Polygon tables: readers, continent filter, edges and outlines.

A polygon row is ``poly_id, attributes..., rings array<array<struct<lon, lat>>>``.
Outer rings, holes and further parts are all plain rings: containment is by parity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RINGS = "array<array<struct<lon:double,lat:double>>>"


def rings_from_wkt(wkt: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON text, in reading order."""
    def point(text: Column) -> Column:
        xy = F.split(F.trim(text), r"\s+")
        return F.struct(
            F.try_element_at(xy, F.lit(1)).try_cast("double").alias("lon"),
            F.try_element_at(xy, F.lit(2)).try_cast("double").alias("lat"),
        )

    texts = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    return F.transform(texts, lambda ring: F.transform(F.split(ring, ","), lambda p: point(p)))


def read_wkt_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with ``poly_id, sovereignt, name_long, continent, wkt`` columns."""
    table = (
        spark.read.schema(
            "poly_id int, sovereignt string, name_long string, continent string, wkt string"
        )
        .option("header", True)
        .csv(path)
    )
    return table.withColumn("rings", rings_from_wkt(F.col("wkt"))).drop("wkt")


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A GeoJSON feature collection; feature order gives ``poly_id``."""
    # Polygon coordinates are one level shallower than those of a MultiPolygon,
    # so they are first read as text and then parsed by geometry type.
    feature = (
        "struct<properties:struct<sovereignt:string,name_long:string,continent:string>,"
        "geometry:struct<type:string,coordinates:string>>"
    )
    whole = spark.read.schema(f"features array<{feature}>").json(path, multiLine=True)
    rows = whole.select(F.posexplode("features").alias("poly_id", "f"))
    shape = F.col("f.geometry.type")
    text = F.col("f.geometry.coordinates")
    single = F.from_json(text, "array<array<array<double>>>")
    several = F.flatten(F.from_json(text, "array<array<array<array<double>>>>"))
    rings = F.when(shape == "Polygon", single).when(shape == "MultiPolygon", several)
    return rows.select(
        "poly_id", "f.properties.*",
        F.transform(rings, lambda ring: F.transform(
            ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
        )).alias("rings"),
    )


def on_continents(polygons: DataFrame, *continents: str) -> DataFrame:
    return polygons.filter(F.col("continent").isin(*continents))


def outline(polygons: DataFrame) -> DataFrame:
    """Vertex rows ``poly_id, group, ord, long, lat``: one group per ring."""
    rings = polygons.select("poly_id", F.posexplode("rings").alias("group", "ring"))
    return rings.select("poly_id", "group", F.posexplode("ring").alias("ord", "p")).select(
        "poly_id", "group", "ord", F.col("p.lon").alias("long"), F.col("p.lat").alias("lat")
    )


def edges(polygons: DataFrame) -> DataFrame:
    """Edge rows ``poly_id, x1, y1, x2, y2``; every ring is closed."""
    rings = polygons.select("poly_id", F.explode("rings").alias("ring"))
    following = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))),
                         F.slice("ring", 1, 1))
    pairs = rings.filter(F.size("ring") > 0).select(
        "poly_id", F.explode(F.arrays_zip(F.col("ring").alias("a"), following.alias("b"))).alias("e")
    )
    return pairs.select(
        "poly_id",
        F.col("e.a.lon").alias("x1"), F.col("e.a.lat").alias("y1"),
        F.col("e.b.lon").alias("x2"), F.col("e.b.lat").alias("y2"),
    )
