"""Forecast tables from draws of the forecast rates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracktally.operators.matching import join_same
from tracktally.operators.predict import density_histogram, predictive_draws, predictive_mass
from tracktally.operators.quantiles import count_quantiles, named
from tracktally.session import written_once

# Probabilities and column names of the forecast tables.
SIMPLE_PROBS = (0.025, 0.5, 0.975)
SIMPLE_NAMES = ("2.5% quantile", "median", "97.5% quantile")
FULL_PROBS = (0.025, 0.25, 0.5, 0.75, 0.975)
FULL_NAMES = ("2.5% quantile", "IQR_lower", "median", "IQR_upper", "97.5% quantile")


def _with_cells(df: DataFrame, cells: DataFrame, keys: Sequence[str], names: Sequence[str],
                how: str = "inner") -> DataFrame:
    """Attributes of the forecast cell; cells without the segment keys serve every segment."""
    shared = [k for k in keys if k in cells.columns]
    return join_same(df, cells.select(*shared, "PRED_ID", *names), [*shared, "PRED_ID"], how)


def forecast_rows(predicted: DataFrame, cells: DataFrame, category: str,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Median and 95% interval per segment and forecast cell."""
    boxes = count_quantiles(predicted, [*keys, "PRED_ID"], "post_pred", SIMPLE_PROBS)
    return _with_cells(boxes, cells, keys, [category, "YEAR"]).select(
        *keys, category, "YEAR", *named(F.col("q"), SIMPLE_NAMES)
    )


def category_totals(predicted: DataFrame, cells: DataFrame, category: str,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Total per segment, draw and category over the horizon."""
    return (
        _with_cells(predicted, cells, keys, [category], "left")
        .groupBy(*keys, "draw", category)
        .agg(F.sum("post_pred").alias("group_total"))
    )


def total_quantiles(totals: DataFrame, category: str, full: bool = True,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles over draws of the per-draw totals, per segment."""
    probs, names = (FULL_PROBS, FULL_NAMES) if full else (SIMPLE_PROBS, SIMPLE_NAMES)
    return count_quantiles(totals, [*keys, category], "group_total", probs).select(
        *keys, category, *named(F.col("q"), names)
    )


def in_year(predicted: DataFrame, cells: DataFrame, category: str, year: int,
            keys: Sequence[str] = ()) -> DataFrame:
    """Predictive draws of one forecast year with their category."""
    return _with_cells(predicted, cells.filter(F.col("YEAR") == year), keys, [category, "YEAR"])


def category_order(category: str) -> Column:
    """Calendar order for months, name order for all else."""
    if category != "MONTH":
        return F.col(category)
    return F.month(F.try_to_timestamp(F.concat(F.lit("1 "), F.col("MONTH"), F.lit(" 2000")),
                                      F.lit("d MMMM yyyy")))


@dataclass(frozen=True)
class Forecast:
    rows: DataFrame
    totals: DataFrame
    simple_totals: DataFrame
    first_year: DataFrame


def forecast(draws: DataFrame, grid: DataFrame, category: str, parameter: str = "log_lambda_star",
             seed: int = 42, keys: Sequence[str] = ()) -> Forecast:
    """All forecast tables of one model, for each segment named by ``keys``.

    ``draws`` has ``keys, draw, PRED_ID`` and the log rate, as ``parameter_draws`` reads
    them off a saved table; ``grid`` is a modelling grid, one for all segments or with
    the keys as columns. Draws are numbered within a segment. Month tables come in calendar order. The predictive draws and the per-draw totals
    are saved once, since several tables read them.
    """
    cells = grid.filter(F.col("PRED_ID").isNotNull())
    predicted = written_once(
        predictive_draws(draws, "PRED_ID", parameter, seed, keys)
        .select(*keys, "draw", "PRED_ID", "post_pred"),
        "predicted",
    )
    totals = written_once(category_totals(predicted, cells, category, keys), "totals")
    year = cells.agg(F.min("YEAR")).first()[0]
    first = density_histogram(
        in_year(predicted, cells, category, year, keys), [*keys, category], "post_pred"
    )

    def ordered(table: DataFrame) -> DataFrame:
        return table.orderBy(*keys, category_order(category))

    return Forecast(
        rows=forecast_rows(predicted, cells, category, keys),
        totals=ordered(total_quantiles(totals, category, True, keys)),
        simple_totals=ordered(total_quantiles(totals, category, False, keys)),
        first_year=ordered(first),
    )


def first_year_mass(draws: DataFrame, cells: DataFrame, category: str, year: int,
                    parameter: str = "log_lambda_star", keys: Sequence[str] = ()) -> DataFrame:
    """Closed-form predictive distribution of one forecast year per segment and category."""
    chosen = in_year(draws, cells, category, year, keys)
    return predictive_mass(chosen, [*keys, category], parameter)
