"""Exact interpolated quantiles per group."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import cycle

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracktally.operators.matching import join_same
from tracktally.session import written_once


def count_quantiles(df: DataFrame, keys: list[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles of a discrete value: ``keys, q`` with ``q`` an array.

    Equal values are counted first with map-side combining, so a group ships its
    distinct values and their counts, however many rows it has.
    """
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(*keys).agg(
        F.percentile(value, F.array(*[F.lit(p) for p in probs]), F.col("__n")).alias("q")
    )


def named(q: Column, names: Sequence[str]) -> list[Column]:
    """The entries of a quantile array as named columns (no pivot, no shuffle)."""
    return [q[i].alias(n) for i, n in enumerate(names)]


def long_form(df: DataFrame, keys: list[str], names: Sequence[str]) -> DataFrame:
    """``keys, summary_name, summary_value`` rows of a quantile array."""
    labels = F.array(*[F.lit(n) for n in names])
    return df.select(*keys, F.posexplode("q").alias("__i", "summary_value")).select(
        *keys, labels[F.col("__i")].alias("summary_name"), "summary_value"
    )


def wide_form(df: DataFrame, keys: list[str], names: Sequence[str]) -> DataFrame:
    """Long quantile rows cast to one column per name."""
    return df.groupBy(*keys).pivot("summary_name", list(names)).agg(F.first("summary_value"))


def spread_quantiles(df: DataFrame, keys: list[str], value: str, probs: Sequence[float],
                     bins: int = 65_536, most: int = 65_536) -> DataFrame:
    """Exact quantiles of a continuous value when one group may be very large.

    A group starts as one segment, from its least to its greatest value. While a segment
    has more than ``most`` rows of different values, its rows are counted in ``bins`` equal
    bins, with map-side combining, and the bins that hold a wanted rank become the new
    segments, each from its own least to its own greatest value. Outliers thus cost a
    round, not a full bin. Every round parts the two ends of a segment, so the rounds
    end. Only rows of the last segments are sorted: at most ``most`` different values each.
    """
    number = F.col(value).cast("double")
    rows = written_once(df.select(*keys, number.alias("__x")).filter(F.col("__x").isNotNull()), "values")
    ranks = F.array_distinct(F.flatten(F.array(*[_ranks(p) for p in probs])))

    def bounds(grouped: GroupedData) -> DataFrame:
        return grouped.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"),
                           F.count(F.lit(1)).alias("__size"))

    segments = bounds(rows.groupBy(*keys)).withColumns({"__n": F.col("__size"), "__before": F.lit(0).cast("long")})
    scales = cycle((_half, _signed_log))
    while not segments.filter((F.col("__size") > most) & (F.col("__hi") > F.col("__lo"))).isEmpty():
        counted = bounds(
            _within(rows, segments, keys).groupBy(*keys, "__n", "__before", _bin(bins, most, next(scales)).alias("__bin"))
        )
        upto = W.partitionBy(*keys, "__before").orderBy("__bin").rowsBetween(W.unboundedPreceding, 0)
        placed = counted.withColumn("__before", F.col("__before") + F.sum("__size").over(upto) - F.col("__size"))
        wanted = F.exists(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__size")))
        segments = written_once(placed.filter(wanted).drop("__bin"), "segments")

    values = _within(rows, segments, keys).groupBy(*keys, "__n", "__before", "__x").agg(
        F.count(F.lit(1)).alias("__c")
    )
    so_far = W.partitionBy(*keys, "__before").orderBy("__x").rowsBetween(W.unboundedPreceding, 0)
    ends = values.withColumn("__to", F.col("__before") + F.sum("__c").over(so_far))
    ends = ends.withColumn("__from", F.col("__to") - F.col("__c"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__from")) & (rank < F.col("__to")), F.col("__x")))

    entries = []
    for p in probs:
        low, high = (at(_ranks(p)[i]) for i in (0, 1))
        part = F.max((F.col("__n") - 1) * p - _ranks(p)[0])
        entries.append(F.when(part > 0, low + part * (high - low)).otherwise(low))
    return ends.groupBy(*keys).agg(F.array(*entries).alias("q"))


def _ranks(p: float) -> Column:
    """The two ranks, from 0, between which a quantile of ``__n`` values lies."""
    low = F.floor((F.col("__n") - 1) * p).cast("long")
    return F.array(low, F.least(low + 1, F.col("__n") - 1))


def _within(rows: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the segment that holds them; a group has at most two segments a probability."""
    return join_same(rows, segments, keys).filter(F.col("__x").between(F.col("__lo"), F.col("__hi")))


def _bin(bins: int, most: int, scale: Callable[[Column], Column]) -> Column:
    """Bin of a row in its segment: infinities and NaN apart, small segments in one piece."""
    x, endless = F.col("__x"), F.lit(float("inf"))
    largest = F.lit(1.7976931348623157e308)
    low, high = scale(F.greatest("__lo", -largest)), scale(F.least("__hi", largest))
    place = F.when(high > low, F.least(F.floor((scale(x) - low) / (high - low) * bins), F.lit(bins - 1)))
    return (
        F.when(F.col("__size") <= most, 0)
        .when(x == -endless, -1).when(x == endless, bins).when(F.isnan(x), bins + 1)
        .otherwise(F.coalesce(place, F.when(x > F.col("__lo"), bins - 1).otherwise(0)))
        .cast("int")
    )


def _half(x: Column) -> Column:
    return x / 2  # differences of halves do not overflow


def _signed_log(x: Column) -> Column:
    """Grows with x; 746 is above minus the logarithm of the least positive double."""
    return F.coalesce(F.signum(x) * (F.ln(F.abs(x)) + 746), F.lit(0.0))
