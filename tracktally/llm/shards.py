"""Shards by jump consistent hashing, with gapless slots inside every shard.

The shard follows from the key and the number of shards alone; one more shard takes rows
only into itself. A NULL key is a key of its own. Slots come from counts of small cells:
rows are numbered inside (shard, cell) and shifted by what the shard's earlier cells hold,
so no task numbers a whole shard. A cell is named by the hash of all columns, so rows of one
key fill all cells of their shard. Rows that agree in all columns are counted first and
spread again in runs of ``RUN`` rows, so they are no hot task either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracktally.llm.common import exact

#: Cells of a shard.
CELLS = 4096
#: Equal rows that one task writes at once.
RUN = 65_536


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5 as a long; NULL is hashed as a text that no number has."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys, all rows at once."""
    state = keys.astype(np.uint64)
    here = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        here[live] = ahead[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = 2147483648.0 / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[live] = ((here[live] + 1) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return here


def shard_of(key: Column, shards: int) -> Column:
    """The shard (int) of each key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for keys in batches:
            yield pd.Series(jump(keys.to_numpy(), shards).astype(np.int32))

    return place(key_hash(key))


def number_slots(df: DataFrame, shard: str, slot: str = "slot") -> DataFrame:
    """``df`` with a gapless number from 0 in each shard.

    The order is by a hash of all columns of ``df``, then by the columns, so reruns agree;
    equal rows are interchangeable. ``df`` must hold no column named ``slot``; keep it
    narrow, since it is what gets shuffled.
    """
    columns = [exact(c) for c in df.columns]
    hashed = (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__h", F.xxhash64(*columns))
        .withColumn("__cell", F.pmod("__h", F.lit(CELLS)))
    )
    inside = Window.partitionBy(exact(shard), "__cell").orderBy("__h", *columns).rowsBetween(Window.unboundedPreceding, -1)
    counted = hashed.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    # at most CELLS rows for each shard
    cells = hashed.groupBy(exact(shard).alias("__shard"), F.col("__cell").alias("__c")).agg(F.sum("__n").alias("__in"))
    earlier = Window.partitionBy("__shard").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("__shard", "__c", F.coalesce(F.sum("__in").over(earlier), F.lit(0)).alias("__offset"))
    first = F.col("__offset") + F.col("__before")
    runs = (
        counted.join(cells, exact(shard).eqNullSafe(F.col("__shard")) & (F.col("__cell") == F.col("__c")))
        .withColumn("__run", F.explode(F.sequence(first, first + F.col("__n") - 1, F.lit(RUN).cast("long"))))
        .withColumn("__end", F.least(F.col("__run") + RUN, first + F.col("__n")) - 1)
        .repartition(exact(shard), "__run")
    )
    return runs.select(*columns, F.explode(F.sequence("__run", "__end")).alias(slot))
