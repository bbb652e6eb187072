"""Cells that the count models are fitted to, and rates read off their draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracktally.operators.counts import count_by, top_by_count
from tracktally.operators.fit import segment_cells
from tracktally.operators.grid import ranked
from tracktally.operators.matching import join_same
from tracktally.operators.predict import basis_boundary, basis_function, spectral_weight


def within_years(landfalls: DataFrame, first: int, last: int) -> DataFrame:
    """Events of the modelled years; the exposure of a fit counts these years only."""
    return landfalls.filter(F.col("YEAR").between(first, last))


def month_cells(landfalls: DataFrame, segment: str, first: int, last: int) -> DataFrame:
    """``segment, y``: events per calendar month over all modelled years."""
    counts = count_by(within_years(landfalls, first, last), segment, "MONTH", name="n")
    return segment_cells(counts, segment, "MONTH", "n", 12)


def location_cells(landfalls: DataFrame, segment: str, first: int, last: int,
                   k: int = 10) -> tuple[DataFrame, DataFrame]:
    """``segment, y`` over the busiest locations, and their ids.

    Locations are ranked by their events of the modelled years. Where there are fewer
    than ``k``, the cells are as many as the locations.
    """
    per_cell = count_by(within_years(landfalls, first, last), segment, "LOCATION", name="n")
    totals = per_cell.filter(F.col("LOCATION").isNotNull()).groupBy("LOCATION").agg(F.sum("n").alias("total"))
    ids = ranked(top_by_count(totals, "LOCATION", "total", k), "LOCATION", "LOC_ID")
    counts = per_cell.join(ids.select("LOCATION", "LOC_ID"), "LOCATION")
    return segment_cells(counts, segment, "LOC_ID", "n", ids.count()), ids


def month_year_cells(landfalls: DataFrame, segment: str, first: int, last: int) -> DataFrame:
    """``segment, y``: events per month and year, month by month."""
    span = last - first + 1
    cell = (F.col("MONTH") - 1) * span + F.col("YEAR") - first + 1
    placed = within_years(landfalls, first, last).withColumn("cell", cell)
    return segment_cells(count_by(placed, segment, "cell", name="n"), segment, "cell", "n", 12 * span)


def standard_years(first: int, last: int, horizon: int) -> list[float]:
    span = last + horizon - first
    return [(y - first) / span * 2 - 1 for y in range(first, last + horizon + 1)]


def category_rates(draws: DataFrame, keys: Sequence[str] = (), effect: str = "beta",
                   intercept: str = "beta_0") -> DataFrame:
    """Log rate per kept draw and category: ``keys, draw, idx, log_lambda``.

    The intercept, where the model has one, is spread over the elements of its own draw,
    a group as large as the model.
    """
    one = W.partitionBy(*keys, "draw")
    shift = F.coalesce(F.max(F.when(F.col("base") == intercept, F.col("value"))).over(one), F.lit(0.0))
    kept = draws.filter(~F.col("is_warmup") & F.col("base").isin(effect, intercept))
    return kept.withColumn("__shift", shift).filter(F.col("base") == effect).select(
        *keys, "draw", "idx", (F.col("__shift") + F.col("value")).alias("log_lambda")
    )


def year_effects(draws: DataFrame, first: int, last: int, horizon: int = 5, keys: Sequence[str] = (),
                 compat: bool = False) -> DataFrame:
    """Smooth effect per kept draw and year: ``keys, draw, YEAR, f``.

    Reads ``gp_lengthscale``, ``gp_sigma`` and the weights ``z`` of the basis functions.
    """
    years = standard_years(first, last, horizon)
    boundary = basis_boundary(years[:last - first + 1] if compat else years, compat=compat)
    one = W.partitionBy(*keys, "draw")

    def scalar(name: str):
        return F.max(F.when(F.col("base") == name, F.col("value"))).over(one)

    kept = draws.filter(~F.col("is_warmup") & F.col("base").isin("gp_lengthscale", "gp_sigma", "z"))
    weighted = kept.withColumns({"__rho": scalar("gp_lengthscale"), "__sigma": scalar("gp_sigma")}).filter(
        "base = 'z'"
    ).withColumn("w", F.col("value") * spectral_weight(F.col("idx"), F.col("__sigma"), F.col("__rho"), boundary))
    # the sums combine map-side: a draw ships one row, whatever its number of functions
    sums = [F.sum(F.col("w") * basis_function(F.lit(x), F.col("idx"), boundary)).alias(f"__f{i}")
            for i, x in enumerate(years)]
    wide = weighted.groupBy(*keys, "draw").agg(*sums)
    effects = F.array(*[f"__f{i}" for i in range(len(years))])
    return wide.select(*keys, "draw", F.posexplode(effects).alias("__t", "f")).select(
        *keys, "draw", (F.col("__t") + first).alias("YEAR"), "f"
    )


def month_year_rates(draws: DataFrame, first: int, last: int, horizon: int = 5, keys: Sequence[str] = (),
                     compat: bool = False) -> DataFrame:
    """Log rates of fit and forecast years: ``keys, draw, idx, YEAR, log_lambda``."""
    months = category_rates(draws, keys)
    effects = year_effects(draws, first, last, horizon, keys, compat)
    return join_same(months, effects, [*keys, "draw"]).select(
        *keys, "draw", "idx", "YEAR", (F.col("log_lambda") + F.col("f")).alias("log_lambda")
    )


def cell_rates(rates: DataFrame, grid: DataFrame, category_id: str, row: str,
               name: str = "log_lambda") -> DataFrame:
    """Rates looked up for the grid rows that have ``row`` set: ``draw, row, name``."""
    keys = ["idx", "YEAR"] if "YEAR" in rates.columns else ["idx"]
    cells = grid.filter(F.col(row).isNotNull()).withColumnRenamed(category_id, "idx")
    extra = [c for c in rates.columns if c not in ("idx", "YEAR", "log_lambda")]
    return rates.join(cells.select(row, *keys), keys).select(
        *extra, row, F.col("log_lambda").alias(name)
    )
