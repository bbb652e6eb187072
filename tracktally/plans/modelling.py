"""Modelling grids: observed counts on complete cells plus the years to forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracktally.operators.counts import count_by, top_by_count
from tracktally.operators.grid import modelling_grid, months, one_hot, ranked


def monthly_grid(landfalls: DataFrame, first: int, last: int, horizon: int = 5) -> DataFrame:
    """Month by year cells with ids and standardised year."""
    counts = count_by(landfalls, "YEAR", "MONTH", name="LANDFALL_COUNT").withColumnRenamed(
        "MONTH", "MONTH_ID"
    )
    grid = modelling_grid(months(landfalls.sparkSession), counts, ["MONTH_ID", "YEAR"], "MONTH_ID",
                          "LANDFALL_COUNT", first, last, horizon)
    return grid.select("YEAR", "MONTH", "MONTH_ID", "LANDFALL_COUNT", "OBS_ID", "PRED_ID",
                       "DATE", "ALL_ID").orderBy(F.asc_nulls_last("OBS_ID"), "ALL_ID")


def location_grid(landfalls: DataFrame, first: int, last: int, horizon: int = 5,
                  k: int = 10) -> DataFrame:
    """Location by year cells of the k locations with most events, one-hot encoded.

    Events of the observed years are counted once per (location, year); totals and
    top-k come from that small table. With fewer than ``k`` locations the grid and its
    indicators have as many as there are.
    """
    seen = landfalls.filter(F.col("YEAR").between(first, last) & F.col("LOCATION").isNotNull())
    cells = count_by(seen, "LOCATION", "YEAR", name="LANDFALL_NBR")
    totals = cells.groupBy("LOCATION").agg(F.sum("LANDFALL_NBR").alias("TOTAL"))
    dim = ranked(top_by_count(totals, "LOCATION", "TOTAL", k), "LOCATION", "LOC_ID")
    grid = modelling_grid(dim, cells, ["LOCATION", "YEAR"], "LOC_ID", "LANDFALL_NBR",
                          first, last, horizon)
    rows = grid.select("ALL_ID", "YEAR", "LOCATION", "LOC_ID", "LANDFALL_NBR", "OBS_ID", "PRED_ID")
    return one_hot(rows, "LOC_ID", dim.count()).orderBy("ALL_ID")


def observed(grid: DataFrame) -> DataFrame:
    return grid.filter(F.col("OBS_ID").isNotNull())


def forecast_cells(grid: DataFrame) -> DataFrame:
    return grid.filter(F.col("PRED_ID").isNotNull())
