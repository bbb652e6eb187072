"""Complete period grids with ids computed in closed form.

A grid has one row per category and year, so ids follow from the category rank
and the year by arithmetic. No global sort or single-partition window is needed,
whatever the number of categories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracktally.functions.text import month_name


def months(spark: SparkSession) -> DataFrame:
    """The twelve months: chronological id and rank of the English name."""
    # Month ids in alphabetical order of their English names.
    by_name = [4, 8, 12, 2, 1, 7, 6, 3, 5, 11, 10, 9]
    rank = F.array_position(F.array(*[F.lit(m) for m in by_name]), F.col("MONTH_ID")).cast("int")
    return (
        spark.range(1, 13, numPartitions=1)
        .select(F.col("id").cast("int").alias("MONTH_ID"))
        .withColumn("MONTH", month_name(F.col("MONTH_ID")))
        .withColumn("PRED_RANK", rank)
        .withColumn("SIZE", F.lit(12))
    )


def ranked(names: DataFrame, name: str, id_name: str) -> DataFrame:
    """Alphabetical ids for a short list of names (a top-k result)."""
    everything = W.partitionBy(F.lit(0))
    return names.select(name).select(
        name,
        F.row_number().over(everything.orderBy(name)).alias(id_name),
        F.count(F.lit(1)).over(everything).cast("int").alias("SIZE"),
    ).withColumn("PRED_RANK", F.col(id_name))


def with_years(dim: DataFrame, first: int, last: int) -> DataFrame:
    return dim.withColumn("YEAR", F.explode(F.sequence(F.lit(first), F.lit(last))))


def zero_filled(grid: DataFrame, counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Left join the counts and put 0 where a cell saw no event."""
    return grid.join(counts, keys, "left").withColumn(
        count, F.coalesce(F.col(count), F.lit(0)).cast("int")
    )


def unit_interval_year(year: Column, first: int, last: int) -> Column:
    """Years mapped to [-1, 1] over the whole span, forecast years included; -1 where it is one year."""
    return (year - first) / F.lit(float(max(1, last - first))) * 2.0 - 1.0


def modelling_grid(dim: DataFrame, counts: DataFrame, keys: list[str], id_name: str, count: str,
                   first: int, last: int, horizon: int) -> DataFrame:
    """Observed years zero-filled, then ``horizon`` years with unknown counts.

    ``OBS_ID`` runs category-major over the observed cells, ``PRED_ID`` year-major
    over the forecast cells with categories in name order, and ``ALL_ID`` numbers
    the observed cells first.
    """
    observed = F.col("YEAR") <= last
    span = last - first + 1
    obs_id = (F.col(id_name) - 1) * span + (F.col("YEAR") - first) + 1
    pred_id = (F.col("YEAR") - last - 1) * F.col("SIZE") + F.col("PRED_RANK")
    return (
        with_years(dim, first, last + horizon)
        .join(counts, keys, "left")
        .withColumn(count, F.when(observed, F.coalesce(F.col(count), F.lit(0))).cast("int"))
        .withColumn("OBS_ID", F.when(observed, obs_id).cast("int"))
        .withColumn("PRED_ID", F.when(~observed, pred_id).cast("int"))
        .withColumn("DATE", unit_interval_year(F.col("YEAR"), first, last + horizon))
        .withColumn("ALL_ID", F.coalesce("OBS_ID", F.col("SIZE") * span + F.col("PRED_ID")).cast("int"))
        .drop("SIZE", "PRED_RANK")
    )


def one_hot(df: DataFrame, key: str, size: int) -> DataFrame:
    """Indicator columns "1".."size"; arithmetic on the row, no pivot shuffle."""
    return df.withColumns({str(k): (F.col(key) == k).cast("int") for k in range(1, size + 1)})


def count_cast(df: DataFrame, row: str, key: str, values: list) -> DataFrame:
    """Row by key table of row counts, 0 where absent, for any set of key values."""
    wide = df.groupBy(row).pivot(key, values).count()
    return wide.na.fill(0, [str(v) for v in values])
