"""Track text, CSV and staging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracktally.catalog import Catalog
from tracktally.catalog.inputs import TRACKS_SQL, tracks
from tracktally.session import shared_path
from tracktally.sources import tables
from tracktally.sources import tracks as T

catalog = Catalog()


def _write_track_text(spark, folder, wrong_every: int = 0) -> str:
    """All events as header/detail text, in globally sorted files.

    The sort key includes the time, so a track with very many rows spreads over
    several files and the parser has to carry its header across them.
    """
    source = tracks(spark, folder)
    announced = F.count(F.lit(1))
    if wrong_every:
        announced = announced + F.when(F.col("STORM_ID") % wrong_every == 0, 1).otherwise(0)
    headers = source.groupBy("STORM_ID").agg(announced.alias("n")).select(
        "STORM_ID", F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("TS"),
        F.lit(-1).cast("bigint").alias("EVENT_ID"),
        F.format_string("EV%06d,          USER %d,   %d,", "STORM_ID", "STORM_ID", "n").alias("value"),
    )
    details = source.select(
        "STORM_ID", F.lit(1).alias("kind"), "TS", "EVENT_ID",
        F.format_string(
            "%s, %s, %s, %s, %.2f%s, %.2f%s, %d, %d, %d",
            F.date_format("TS", "yyyyMMdd"), "TIME", "RECORD_ID", "STATUS",
            F.abs("LAT"), F.when(F.col("LAT") < 0, "S").otherwise("N"),
            F.abs("LON"), F.when(F.col("LON") < 0, "W").otherwise("E"),
            "WIND", "PRESSURE", "EVENT_ID",
        ).alias("value"),
    )
    path = shared_path(spark, "track-text")
    headers.unionByName(details).orderBy("STORM_ID", "kind", "TS", "EVENT_ID").select(
        "value"
    ).write.text(path)
    return path


@catalog.add(f"""
WITH {TRACKS_SQL}
SELECT printf('EV%06d', STORM_ID) AS STORM_ID, 'USER' || STORM_ID AS NAME, DATE, TIME, RECORD_ID,
       STATUS, LAT, LON, WIND, PRESSURE, YEAR, MONTH, DAY
FROM tracks WHERE YEAR >= 2000""")
def parse_track_text(spark, folder):
    path = _write_track_text(spark, folder)
    staged = T.stage_track_lines(T.read_track_lines(spark, path, "events"))
    return T.typed(T.since(T.observations(staged, across_files=True), 2000)).drop("BASIN")


@catalog.add(f"""
WITH {TRACKS_SQL}
SELECT printf('EV%06d', STORM_ID) AS STORM_ID, CAST(count(*) + 1 AS INT) AS N_TRACK, count(*) AS N_FOUND
FROM tracks WHERE STORM_ID % 7 = 0 GROUP BY STORM_ID""")
def track_count_check(spark, folder):
    path = _write_track_text(spark, folder, wrong_every=7)
    staged = T.stage_track_lines(T.read_track_lines(spark, path, "events"))
    return T.rejected_tracks(staged, across_files=True).drop("BASIN")


@catalog.add(f"""
WITH {TRACKS_SQL}
SELECT CAST(STORM_ID AS VARCHAR) AS STORM_ID, 'U' || STORM_ID AS NAME, DATE, TIME, RECORD_ID, STATUS,
       LAT, LON, CASE WHEN WIND <= 137 THEN WIND END AS WIND, PRESSURE, YEAR, MONTH, DAY
FROM tracks""")
def csv_roundtrip(spark, folder):
    source = tracks(spark, folder).select(
        F.col("STORM_ID").cast("string").alias("STORM_ID"),
        F.concat(F.lit("U"), F.col("STORM_ID")).alias("NAME"),
        "DATE", "TIME", "RECORD_ID", "STATUS", "LAT", "LON",
        F.when(F.col("WIND") <= 137, F.col("WIND")).alias("WIND"),
        "PRESSURE", "YEAR", "MONTH", "DAY",
    )
    path = shared_path(spark, "tracks-csv")
    tables.write_csv(source, path)
    return tables.read_csv(spark, path, tables.TRACK_SCHEMA)
