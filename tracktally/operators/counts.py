"""Event counting, ranking and banding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str, name: str) -> DataFrame:
    """Rows per key; map-side combined, so a hot key costs one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def marked_per_track(tracks: DataFrame, track: str, marker: Column, name: str) -> DataFrame:
    """Marked observations per track, tracks without any included as 0."""
    return tracks.groupBy(track).agg(F.count_if(marker).alias(name))


def landfall_class(count: Column) -> Column:
    return (
        F.when(count == 0, "0").when(count == 1, "1").when(count == 2, "2").when(count > 2, ">2")
    )


def top_by_count(counts: DataFrame, name: str, count: str, k: int = 10) -> DataFrame:
    """The k largest counts; equal counts are cut in name order."""
    return counts.orderBy(F.desc(count), F.asc(name)).limit(k)


def with_counts(features: DataFrame, counts: DataFrame, name: str, key: str, count: str) -> DataFrame:
    """Every feature with its count, 0 where nothing was counted."""
    keyed = counts.withColumnRenamed(key, "__key")
    return (
        features.join(keyed, features[name] == F.col("__key"), "left")
        .drop("__key")
        .withColumn(count, F.coalesce(F.col(count), F.lit(0)))
    )


def label_value(name: Column, values: dict[str, float], default: float = 0.0) -> Column:
    """Ordered lookup with a default, as one searched case."""
    out = None
    for label, value in values.items():
        out = F.when(name == label, value) if out is None else out.when(name == label, value)
    return F.lit(default) if out is None else out.otherwise(default)


def in_scale(value: Column, low: float, high: float) -> Column:
    """Values outside the scale count as missing."""
    return F.when(value.between(low, high), value)


def rescale(value: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return (value - low) / (high - low)


def band(value: Column, breaks: Sequence[float]) -> Column:
    """1-based index of the half-open band [break, next); the last is closed."""
    out = None
    for i, (lo, hi) in enumerate(zip(breaks, breaks[1:]), start=1):
        inside = (value >= lo) & ((value < hi) if i < len(breaks) - 1 else (value <= hi))
        out = F.when(inside, i) if out is None else out.when(inside, i)
    return out


def bounding_box(df: DataFrame, lon: str, lat: str, west: float, east: float,
                 south: float, north: float) -> DataFrame:
    return df.filter(F.col(lon).between(west, east) & F.col(lat).between(south, north))
