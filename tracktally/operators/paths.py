"""Ordered observation paths that hold up when one track owns most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def having_any(tracks: DataFrame, marked: DataFrame, track: str) -> DataFrame:
    """Tracks that occur in ``marked``: a semi join on distinct keys."""
    return tracks.join(marked.select(track).distinct(), track, "left_semi")


def _seconds(df: DataFrame, at: str) -> Column:
    """Whole seconds on a scale that rises with the column, free of daylight-saving jumps."""
    if df.schema[at].dataType.simpleString() == "timestamp":
        return F.unix_seconds(at)
    clock = F.hour(at) * 3600 + F.minute(at) * 60 + F.floor(F.second(at))
    return F.unix_date(F.to_date(at)).cast("bigint") * 86_400 + clock


def path_steps(tracks: DataFrame, track: str, order: list[str], carry: list[str],
               at: str, bucket_seconds: int = 86_400) -> DataFrame:
    """Position in the track (``SEQ``) and the following point of each observation.

    Rows are ordered inside (track, time bucket) pieces. What crosses a piece, the
    rows before it and the first point after it, comes from a table with one row per
    piece. So no task ever orders a whole long track. The order is by ``at`` first,
    then by the other names of ``order``.
    """
    order = [at, *[c for c in order if c != at]]
    pieces = tracks.withColumn("__piece", F.floor(_seconds(tracks, at) / bucket_seconds))
    head = F.struct(*order, *carry)

    inside = W.partitionBy(track, "__piece").orderBy(*order)
    stepped = pieces.withColumn("__row", F.row_number().over(inside)).withColumn(
        "__next", F.lead(F.struct(*carry)).over(inside)
    )
    along = W.partitionBy(track).orderBy("__piece")
    seams = (
        pieces.groupBy(track, "__piece")
        .agg(F.count(F.lit(1)).alias("__size"), F.min(head).alias("__head"))
        .withColumn(
            "__before",
            F.coalesce(
                F.sum("__size").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn("__after", F.lead("__head").over(along))
        .select(F.col(track).alias("__track"), F.col("__piece").alias("__seam"), "__before", "__after")
    )
    # rows without a time are a piece of their own, the first
    same = F.col(track).eqNullSafe(F.col("__track")) & F.col("__piece").eqNullSafe(F.col("__seam"))
    out = stepped.join(seams, same).drop("__track", "__seam")
    following = {
        # a following point may have missing values of its own
        f"NEXT_{c}": F.when(F.col("__next").isNotNull(), F.col("__next")[c]).otherwise(F.col("__after")[c])
        for c in carry
    }
    return (
        out.withColumn("SEQ", (F.col("__before") + F.col("__row")).cast("bigint"))
        .withColumns(following)
        .drop("__piece", "__row", "__next", "__before", "__after")
    )
