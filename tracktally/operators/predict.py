"""Linear predictors, likelihoods and predictive draws over long draw tables."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracktally.functions.numeric import keyed_uniform, log_masses, poisson_log_mass, poisson_quantile
from tracktally.operators.matching import join_same
from tracktally.session import broadcast_if_small, task_count


def contrast_weights(size: int) -> list[list[float]]:
    """Orthonormal columns that each sum to zero: row k holds the weights of effect k."""
    rows = [[0.0] * (size - 1) for _ in range(size)]
    for j in range(1, size):
        scale = 1.0 / math.sqrt(j * (j + 1))
        for k in range(j):
            rows[k][j - 1] = scale
        rows[j][j - 1] = -j * scale
    return rows


def contrast_prior_sd(size: int) -> float:
    """Scale of the contrasts that gives every effect unit prior variance."""
    return 1.0 / math.sqrt(1.0 - 1.0 / size)


def sum_to_zero_effects(contrasts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``keys, idx, value`` contrasts (idx 1..size-1) to ``size`` effects summing to 0."""
    weights = contrast_weights(size)
    at = F.col("idx").cast("int") - 1
    sums = [
        F.sum(F.array(*[F.lit(w) for w in row])[at] * F.col("value")) for row in weights
    ]
    # the sums combine map-side, so a draw ships one row instead of size x (size - 1)
    wide = contrasts.groupBy(*keys).agg(*[s.alias(f"__e{k}") for k, s in enumerate(sums)])
    effects = F.array(*[f"__e{k}" for k in range(size)])
    return wide.select(*keys, F.posexplode(effects).alias("__k", "value")).select(
        *keys, (F.col("__k") + 1).alias("idx"), "value"
    )


def basis_boundary(inputs: list[float], factor: float = 1.2, compat: bool = False) -> float:
    """Half-width of the basis domain.

    The default covers every input of fit and forecast. ``compat`` takes the largest
    input instead of the largest absolute one.
    """
    return factor * (max(inputs) if compat else max(abs(x) for x in inputs))


def basis_function(x: Column, m: Column | int, boundary: float) -> Column:
    """m-th eigenfunction on [-boundary, boundary]."""
    return F.sin(math.pi / (2 * boundary) * (x + boundary) * m) / math.sqrt(boundary)


def spectral_weight(m: Column, sigma: Column, lengthscale: Column, boundary: float) -> Column:
    """Square root of the squared-exponential spectral density at frequency m."""
    return (
        sigma
        * F.sqrt(math.sqrt(2 * math.pi) * lengthscale)
        * F.exp(-0.25 * F.pow(lengthscale * (math.pi / 2 / boundary), 2) * m * m)
    )


def basis_table(points: DataFrame, x: str, boundary: float, functions: int = 30) -> DataFrame:
    """One row per point and basis function: ``m, phi``."""
    return points.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(functions)))).withColumn(
        "phi", basis_function(F.col(x), F.col("m"), boundary)
    )


def smooth_effect(x: Column, weights: list[Column], boundary: float) -> Column:
    """Sum of weighted basis functions at x, as one row-level expression."""
    total = F.lit(0.0)
    for m, w in enumerate(weights, start=1):
        total = total + w * basis_function(x, m, boundary)
    return total


def linear_predictor(design: DataFrame, effects: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """Sparse product: design ``row, idx, x`` times draws ``keys, idx, value``.

    Effects are few (draws x coefficients) and are broadcast after a count. The design
    is placed by row before it is multiplied, so the sum over a row's entries needs no
    shuffle of the rows x draws product and a crowded coefficient, such as an intercept
    shared by all rows, gathers nowhere. Larger effects fall back to a shuffled join.
    """
    placed = design.repartition(task_count(design.sparkSession), row)
    return (
        placed.join(broadcast_if_small(effects, 500_000), "idx")
        .groupBy(*keys, row)
        .agg(F.sum(F.col("x") * F.col("value")).alias("log_lambda"))
    )


def fitted_and_forecast(fitted: DataFrame, forecast: DataFrame) -> DataFrame:
    """Rows of both predictors, fitted first in id order."""
    return fitted.unionByName(forecast)


def pointwise_log_lik(draws: DataFrame, counts: DataFrame, row: str, count: str,
                      log_rate: str = "log_lambda") -> DataFrame:
    """Adds ``log_lik`` of the observed count under every draw.

    Draws made from a few short rows look small to the planner, which would broadcast all of
    them; the counts, one row an observation, are broadcast instead where a count shows that they are few.
    """
    return draws.join(broadcast_if_small(counts.select(row, count)), row).withColumn(
        "log_lik", poisson_log_mass(F.col(count), F.col(log_rate))
    )


def predictive_draws(draws: DataFrame, row: str, log_rate: str = "log_lambda",
                     seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``post_pred``, one Poisson draw per row keyed by (seed, draw, keys, row).

    ``keys`` name the segments of a table that holds several fits.
    """
    u = keyed_uniform(seed, F.col("draw"), *[F.col(k) for k in keys], F.col(row))
    return draws.withColumn("post_pred", poisson_quantile(F.col(log_rate), u))


#: Rates of this size and more have counts that no int holds.
LARGEST_RATE = 2.0e9


#: Entries of bands that a vectorised step holds at once.
BAND_ENTRIES = 500_000


def _band_sums(draws: DataFrame, keys: list[str], log_rate: str) -> DataFrame:
    """``keys, k, __s``: masses in the bands of the draws' rates, added up batch by batch.

    Draws with a rate are counted as k = -1.
    """
    names = [*(f"k{i}" for i in range(len(keys))), "k", "s"]
    sent = draws.select(*[F.col(c).alias(n) for c, n in zip(keys, names)], F.col(log_rate).cast("double").alias("ll"))
    schema = T.StructType([*sent.schema.fields[: len(keys)], T.StructField("k", T.LongType()), T.StructField("s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ll = batch.column(len(keys)).to_numpy(zero_copy_only=False)  # NaN where there is none
            with np.errstate(over="ignore"):
                batch = batch.filter(pa.array(np.exp(ll) < LARGEST_RATE))
            columns = [batch.column(i) for i in range(len(keys))]
            group = np.zeros(batch.num_rows, np.int64)
            for c in columns:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
                group = np.unique(group * batch.num_rows + codes, return_inverse=True)[1]
            first = np.unique(group, return_index=True)[1]
            for g, k, s in band_masses(group, batch.column(len(keys)).to_numpy(zero_copy_only=False)):
                taken = pa.array(first[g])
                yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in columns), pa.array(k), pa.array(s)], names=names)

    return sent.mapInArrow(run, schema).toDF(*keys, "k", "__s")


def band_masses(group: np.ndarray, ll: np.ndarray) -> Iterator[tuple]:
    """Group, count and mass over the band of each rate, added up by group and count; -1 has the number of rates.

    Bands from 0 follow from count to count by one product; others start from their own logarithms.
    """
    rate = np.exp(ll)
    reach = 10.0 * np.sqrt(rate) + 20.0
    low, high = np.maximum(np.floor(rate - reach), 0.0).astype(np.int64), np.ceil(rate + reach).astype(np.int64)
    total = np.bincount(group).astype(float)
    yield np.arange(len(total)), np.full(len(total), -1), total
    at = np.flatnonzero(low == 0)
    at = at[np.argsort(-high[at], kind="stable")]
    of, top, r = group[at], high[at], rate[at]
    mass = np.exp(-r)
    k, found = 0, []
    while len(of):
        sums = np.bincount(of, mass)
        some = np.flatnonzero(np.bincount(of))
        found.append((some, np.full(len(some), k), sums[some]))
        k += 1
        live = np.searchsorted(-top, -k, "right")  # bands in descending order of their ends
        of, top, r, mass = of[:live], top[:live], r[:live], mass[:live] * r[:live] / k
    if found:
        yield tuple(np.concatenate(c) for c in zip(*found))
    wide = low > 0
    _, at, weight = np.unique(np.column_stack([group, ll.view(np.int64)])[wide], axis=0, return_index=True, return_counts=True)
    at = np.flatnonzero(wide)[at]
    width = (high - low + 1)[at]
    step = (np.cumsum(width) - width) // BAND_ENTRIES
    for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(step)) + 1):
        rows, times = np.repeat(at[some], width[some]), np.repeat(weight[some], width[some])
        if not len(rows):
            continue
        k = np.arange(len(rows)) - np.repeat(np.cumsum(width[some]) - width[some], width[some]) + low[rows]
        mass = times * np.exp(log_masses(k.astype(float), ll[rows], rate[rows]))
        place, inverse = np.unique(group[rows] << 32 | k, return_inverse=True)
        yield place >> 32, place & 0xFFFFFFFF, np.bincount(inverse, mass)


def predictive_mass(draws: DataFrame, keys: list[str], log_rate: str = "log_lambda") -> DataFrame:
    """Average Poisson mass over draws for each count: ``keys, k, mass``.

    Bands are added up where the draws are; equal rates of a batch whose bands do not start
    at 0 are counted first. A rate contributes to the band of counts outside
    which its mass is negligible (below 1e-20), so work grows with the root of the rate;
    counts that no band holds have no row. The average divides by all draws of the group.
    Rates that are not finite, or whose counts are beyond the type of ``k``, count as NULL.
    """
    sums = _band_sums(draws, keys, log_rate).groupBy(*keys, "k").agg(F.sum("__s").alias("__s"))
    n = F.max(F.when(F.col("k") == -1, F.col("__s"))).over(W.partitionBy(*keys))  # a few hundred counts a group
    out = sums.withColumn("__n", n).where("k >= 0")
    return out.select(*keys, F.col("k").cast("int").alias("k"), (F.col("__s") / F.col("__n")).alias("mass"))


def density_histogram(df: DataFrame, facets: Sequence[str], value: str, width: float = 1.0) -> DataFrame:
    """Histogram density per group of facets: bins of ``width`` centred on its multiples."""
    binned = df.groupBy(*facets, F.floor(F.col(value) / width + 0.5).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    total = F.sum("n").over(W.partitionBy(*facets))
    return binned.select(
        *facets, (F.col("bin") * width).alias("centre"), "n",
        (F.col("n") / total / width).alias("density"),
    )
