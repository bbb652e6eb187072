"""Flat tables: CSV with NA text, and Parquet partitioned by year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRACK_SCHEMA = (
    "STORM_ID string, NAME string, DATE date, TIME string, RECORD_ID string, STATUS string, "
    "LAT double, LON double, WIND int, PRESSURE int, YEAR int, MONTH int, DAY int"
)
LANDFALL_SCHEMA = (
    "STORM_ID string, NAME string, DATE date, TIME string, RECORD_ID string, STATUS string, "
    "LAT double, LON double, WIND int, PRESSURE int, YEAR int, MONTH int, DAY int, "
    "COUNTRY string, LOCATION string"
)
MONTHLY_GRID_SCHEMA = (
    "YEAR int, MONTH string, MONTH_ID int, LANDFALL_COUNT int, OBS_ID int, PRED_ID int, "
    "DATE double, ALL_ID int"
)


def location_grid_schema(locations: int = 10) -> str:
    marks = ", ".join(f"`{k}` int" for k in range(1, locations + 1))
    return (
        "ALL_ID int, YEAR int, LOCATION string, LOC_ID int, LANDFALL_NBR int, OBS_ID int, "
        f"PRED_ID int, {marks}"
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header row, ``NA`` as NULL, declared types (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header row, NULL as ``NA``; one file per partition."""
    df.write.option("header", True).option("nullValue", "NA").option("emptyValue", '""').csv(path)


def write_by_year(df: DataFrame, path: str) -> None:
    """Parquet partitioned by YEAR, so year filters prune folders."""
    df.write.partitionBy("YEAR").parquet(path)
