"""Sufficient statistics of the count models, and point estimates.

Sampling the models is left to a sampler of the user's choice; its input per segment
are these cells, its output a long draw table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_cells(counts: DataFrame, segment: str, cell: str, count: str, cells: int) -> DataFrame:
    """One row per segment with its zero-filled counts ``y`` in cell order (1..cells).

    Counts without a cell, or of a cell outside the range, belong to none.
    """
    table = counts.groupBy(segment).agg(F.map_from_entries(  # at most ``cells`` entries
        F.collect_list(F.when(F.col(cell).between(1, cells), F.struct(cell, count)))
    ).alias("m"))
    y = F.transform(
        F.sequence(F.lit(1), F.lit(cells)), lambda c: F.coalesce(F.col("m")[c], F.lit(0)).cast("double")
    )
    return table.select(segment, y.alias("y"))


def poisson_regression(cells: DataFrame, category: str, count: str) -> DataFrame:
    """Estimates of the category log rates: ``category, coefficient``.

    With one indicator per category the likelihood has its maximum at the log of the
    category's mean count. A category without any event has no finite estimate: NULL.
    """
    mean = F.avg(count)
    return cells.groupBy(F.col(category).cast("string").alias("category")).agg(
        F.when(mean > 0, F.ln(mean)).alias("coefficient")
    )
