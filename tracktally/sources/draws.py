"""Posterior draws as one long table.

Columns: ``model, chain, iteration, draw, is_warmup, base, idx, value``; an element
such as ``beta[3]`` has base ``beta`` and idx 3, a scalar has idx NULL.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRAW_IDS = [".chain", ".iteration", ".draw"]


def save_draws(draws: DataFrame, path: str) -> None:
    """Parquet partitioned by model and base, so selecting variables prunes folders."""
    draws.write.partitionBy("model", "base").parquet(path)


def load_draws(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def melt(wide: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Wide draws, one column per element, to ``ids, variable, value`` rows."""
    ids = DRAW_IDS if ids is None else ids
    values = [f"`{c}`" for c in wide.columns if c not in ids]
    return wide.unpivot([f"`{c}`" for c in ids], values, "variable", "value")


def base_of(variable: Column) -> Column:
    return F.regexp_extract(variable, r"^([^\[]+)", 1)


def index_of(variable: Column) -> Column:
    """The number in square brackets, NULL for a scalar."""
    return F.regexp_extract(variable, r"\[([0-9]+)\]", 1).try_cast("int")


def variable_name() -> Column:
    """``base`` or ``base[idx]`` of a long row."""
    indexed = F.concat("base", F.lit("["), F.col("idx").cast("string"), F.lit("]"))
    return F.when(F.col("idx").isNull(), F.col("base")).otherwise(indexed)


def select_draws(draws: DataFrame, variables: Iterable[str], warmup: bool = False) -> DataFrame:
    """Draws of the named bases; an unknown name raises.

    One pass collects the names that exist, at most as many as were asked for; of a
    saved table it reads the folders of these names only.
    """
    names = list(variables)
    kept = draws.filter(F.col("base").isin(names))
    found = {r[0] for r in kept.select("base").distinct().collect()}
    missing = [n for n in names if n not in found]
    if missing:
        raise ValueError(f"unknown variables: {', '.join(missing)}")
    return kept if warmup else kept.filter(~F.col("is_warmup"))


def parameter_draws(draws: DataFrame, parameter: str, row: str, keys: Sequence[str] = ()) -> DataFrame:
    """Kept draws of one vector parameter as the plans read them: ``keys, draw, row, parameter``.

    ``row`` names the id that the element's number stands for, such as an observation
    or a forecast cell.
    """
    kept = select_draws(draws, [parameter])
    return kept.select(*keys, "draw", F.col("idx").alias(row), F.col("value").alias(parameter))
