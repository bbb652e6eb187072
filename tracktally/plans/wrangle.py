"""From track text files to the landfall table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracktally.operators.spatial import locate
from tracktally.sources import tracks as T


def wrangle_tracks(spark: SparkSession, basins: dict[str, str], first_year: int = 2000,
                   across_files: bool = False) -> DataFrame:
    """Parse one text file or folder per basin, stack them, keep recent years, type.

    ``across_files``: the files of a folder are parts of one text, in the order of their names.
    """
    lines = reduce(
        DataFrame.unionByName,
        [T.read_track_lines(spark, path, basin) for basin, path in basins.items()],
    )
    staged = T.stage_track_lines(lines)
    return T.typed(T.since(T.observations(staged, across_files), first_year))


def enrich_landfalls(tracks: DataFrame, polygons: DataFrame, row_id: str) -> DataFrame:
    """Landfall observations with COUNTRY and LOCATION of the polygon they fall in.

    Points outside every polygon take the nearest one. One output row per landfall.
    """
    landfalls = tracks.filter(F.col("RECORD_ID") == "L")
    return locate(landfalls, polygons, {"sovereignt": "COUNTRY", "name_long": "LOCATION"}, row_id)
