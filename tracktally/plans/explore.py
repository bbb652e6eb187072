"""Descriptive tables: counts per period, per track class, per location; paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracktally.functions.text import observed_at
from tracktally.operators.counts import (
    count_by, landfall_class, marked_per_track, top_by_count, with_counts,
)
from tracktally.operators.grid import months, with_years, zero_filled
from tracktally.operators.paths import having_any, path_steps


def landfalls_per_year(landfalls: DataFrame) -> DataFrame:
    """Counts per year; a year without events has no row."""
    return count_by(landfalls, "YEAR", name="CYCLONE_NUM")


def average_per_month(landfalls: DataFrame, first: int, last: int) -> DataFrame:
    """Mean events per calendar month over all years, empty months counted as 0."""
    counts = count_by(landfalls, "YEAR", "MONTH", name="LANDFALL_NUM").withColumnRenamed(
        "MONTH", "MONTH_ID"
    )
    grid = with_years(months(landfalls.sparkSession).select("MONTH_ID", "MONTH"), first, last)
    filled = zero_filled(grid, counts, ["MONTH_ID", "YEAR"], "LANDFALL_NUM")
    return (
        filled.groupBy("MONTH_ID", "MONTH")
        .agg(F.avg("LANDFALL_NUM").alias("AVG_LANDFALLS"))
        .orderBy("MONTH_ID")
    )


def tracks_by_landfalls(tracks: DataFrame) -> DataFrame:
    """How many tracks made 0, 1, 2 or more landfalls."""
    per_track = marked_per_track(tracks, "STORM_ID", F.col("RECORD_ID") == "L", "LANDFALL_NUM")
    classed = per_track.withColumn("CATEGORY", landfall_class(F.col("LANDFALL_NUM")))
    return count_by(classed, "CATEGORY", name="NUM")


def landfalling_paths(tracks: DataFrame, order: list[str], at: str) -> DataFrame:
    """Step-by-step paths of the tracks with at least one landfall."""
    hit = having_any(tracks, tracks.filter(F.col("RECORD_ID") == "L"), "STORM_ID")
    stamped = hit.withColumn(
        "DATE_TIME",
        observed_at(F.col("YEAR"), F.col("MONTH"), F.col("DAY"), F.col("TIME")),
    )
    return path_steps(stamped, "STORM_ID", order, ["LON", "LAT", "WIND"], at)


def location_totals(features: DataFrame, landfalls: DataFrame, name: str) -> DataFrame:
    """Every polygon with its number of landfalls, 0 included."""
    counts = count_by(landfalls, "LOCATION", name="LANDFALL_NUM")
    return with_counts(features, counts, name, "LOCATION", "LANDFALL_NUM")


def top_locations(features: DataFrame, landfalls: DataFrame, name: str, k: int = 10) -> DataFrame:
    return top_by_count(location_totals(features, landfalls, name), name, "LANDFALL_NUM", k)
