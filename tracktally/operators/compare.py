"""Predictive accuracy per observation and model comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracktally.functions.numeric import log_factorials
from tracktally.session import cut_lineage

OBSERVATIONS_PER_STEP = 64


def importance_loo(log_lik: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plain importance-sampling LOO and WAIC per observation.

    Both averages are stabilised by the group's extreme value.
    """
    group = W.partitionBy(*keys)
    shifted = log_lik.withColumns({
        "__top": F.max("log_lik").over(group), "__low": F.min("log_lik").over(group),
    })
    return shifted.groupBy(*keys).agg(
        (F.first("__low") - F.ln(F.avg(F.exp(F.col("__low") - F.col("log_lik"))))).alias("elpd_loo"),
        (F.first("__top") + F.ln(F.avg(F.exp(F.col("log_lik") - F.col("__top"))))
         - F.var_samp("log_lik")).alias("elpd_waic"),
    )


def _tail_shape(excess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Generalised Pareto shape and scale of each row of sorted exceedances.

    Profile posterior mean over a grid of candidates, with a weak pull of the shape
    towards one half.
    """
    n = excess.shape[1]
    m = 30 + int(math.sqrt(n))
    grid = 1.0 / excess[:, -1:] + (1.0 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (
        3.0 * excess[:, [int(n / 4 + 0.5) - 1]]
    )
    shapes = np.log1p(-grid[:, :, None] * excess[:, None, :]).mean(axis=2)
    score = n * (np.log(-grid / shapes) - shapes - 1.0)
    with np.errstate(over="ignore"):
        weight = 1.0 / np.exp(score[:, None, :] - score[:, :, None]).sum(axis=2)
    theta = (grid * weight).sum(axis=1) / weight.sum(axis=1)
    k = np.log1p(-theta[:, None] * excess).mean(axis=1)
    sigma = -k / theta
    return (k * n + 5.0) / (n + 10.0), sigma


def _smoothed(log_lik: np.ndarray) -> np.ndarray:
    """elpd and tail shape of each row: one observation's ascending log likelihoods."""
    rows, size = log_lik.shape
    ordered = log_lik[:, ::-1]  # importance ratios ascend
    ratio = ordered[:, -1:] - ordered
    tail = int(math.ceil(min(0.2 * size, 3.0 * math.sqrt(size))))
    k = np.full(rows, math.inf)
    if tail >= 5:
        top, cutoff = ratio[:, -tail:], np.exp(ratio[:, [-tail - 1]])
        excess = np.exp(top) - cutoff
        fits = np.flatnonzero((excess[:, -1] > 0) & (top[:, -1] - top[:, 0] > np.finfo(float).eps))
        if len(fits):
            k[fits], sigma = _tail_shape(np.maximum(excess[fits], np.finfo(float).tiny))
            p = -np.log1p(-(np.arange(1, tail + 1) - 0.5) / tail)
            shape = np.where(np.abs(k[fits]) < 1e-30, 1e-30, k[fits])[:, None]  # the limit at 0
            fitted = sigma[:, None] * np.expm1(shape * p) / shape
            ratio[fits, -tail:] = np.log(fitted + cutoff[fits])
    ratio = np.minimum(ratio, 0.0)
    weight = np.exp(ratio - ratio.max(axis=1, keepdims=True))
    weight = weight / weight.sum(axis=1, keepdims=True)
    high = ordered[:, 0]
    elpd = high + np.log((weight * np.exp(ordered - high[:, None])).sum(axis=1))
    return np.column_stack([elpd, k])


def smoothed_loo(log_lik: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pareto-smoothed LOO: ``elpd_loo`` and ``pareto_k`` per observation.

    A group is one observation's draws, so its size is the sampler's, not the data's.
    Observations with equally many draws are smoothed together, some at a time. A
    log likelihood that is NULL or not finite makes both results NULL.
    """
    known = F.coalesce("log_lik", F.lit(float("nan")))
    packed = log_lik.groupBy(*keys).agg(F.collect_list(known).alias("ll"))
    return packed.select(*keys, _smooth("ll").alias("s")).select(*keys, "s.*")


def smoothed_loo_of_rates(rates: DataFrame, counts: DataFrame, keys: Sequence[str], row: str, count: str,
                          log_rate: str = "log_lambda") -> DataFrame:
    """``smoothed_loo`` of ``pointwise_log_lik``, with ``row`` among ``keys``.

    The rates of a group are gathered before they meet the counts of their observation: one
    row a group is joined, not all draws.
    """
    packed = rates.groupBy(*keys).agg(F.collect_list(F.coalesce(log_rate, F.lit(float("nan")))).alias("r"))
    seen = counts.groupBy(row).agg(F.collect_list(F.coalesce(F.col(count).cast("double"), F.lit(float("nan")))).alias("c"))
    return packed.join(seen, row).select(*keys, _smooth_rates("r", "c").alias("s")).select(*keys, "s.*")


SMOOTHED = T.StructType([T.StructField("elpd_loo", T.DoubleType()), T.StructField("pareto_k", T.DoubleType())])


def _smoothed_rows(values: Sequence[np.ndarray]) -> pa.StructArray:
    out = np.full((len(values), 2), np.nan)
    sizes = np.array([len(v) for v in values], np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for start in range(0, len(rows), OBSERVATIONS_PER_STEP):
            at = rows[start:start + OBSERVATIONS_PER_STEP]
            ll = np.sort(np.stack([values[i] for i in at]).astype(float), axis=1)
            known = np.isfinite(ll).all(axis=1)
            if known.any():
                out[at[known]] = _smoothed(ll[known])
    null = np.isnan(out)
    return pa.StructArray.from_arrays([pa.array(out[:, i], mask=null[:, i]) for i in (0, 1)], SMOOTHED.names)


def _lists(column: pa.Array) -> list[np.ndarray]:
    if not len(column):
        return []
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1])


@F.arrow_udf(SMOOTHED)
def _smooth(log_lik: pa.Array) -> pa.Array:
    return _smoothed_rows(_lists(log_lik))


@F.arrow_udf(SMOOTHED)
def _smooth_rates(log_rate: pa.Array, count: pa.Array) -> pa.Array:
    seen, rates = _lists(count), _lists(log_rate)
    if not rates:
        return _smoothed_rows([])
    sizes = np.array([len(r) * len(c) for r, c in zip(rates, seen)])
    n = np.concatenate([np.repeat(c, len(r)) for r, c in zip(rates, seen)])
    ll = np.concatenate([np.tile(r, len(c)) for r, c in zip(rates, seen)])
    with np.errstate(invalid="ignore", over="ignore"):
        log_lik = np.where(n == 0, 0.0, n * ll) - np.exp(ll) - log_factorials(n)
    return _smoothed_rows(np.split(np.where(np.isnan(ll) | np.isnan(n), np.nan, log_lik), np.cumsum(sizes)[:-1]))


def model_totals(pointwise: DataFrame, elpd: str = "elpd_loo") -> DataFrame:
    """Sum and standard error per model."""
    return pointwise.groupBy("model").agg(
        F.sum(elpd).alias("elpd_loo"),
        (F.sqrt(F.count(F.lit(1)).cast("double")) * F.stddev_samp(elpd)).alias("se_elpd_loo"),
    )


def compare_models(pointwise: DataFrame, row: str, elpd: str = "elpd_loo") -> DataFrame:
    """Differences to the best model, best first.

    The pointwise table has one row per model and observation and is read three times,
    so it is fixed by a checkpoint first. Models of different observations are refused.
    """
    pointwise = cut_lineage(pointwise)
    each = pointwise.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(row).alias("d"))
    sizes = each.agg(F.max("n"), F.min("d")).first()
    observed = pointwise.agg(F.count_distinct(row)).first()[0]
    if observed and set(sizes) != {observed}:
        raise ValueError("models must have the same observations, each once")
    totals = model_totals(pointwise, elpd)
    best = totals.orderBy(F.desc("elpd_loo"), "model").limit(1).select("model")
    reference = pointwise.join(F.broadcast(best), "model", "left_semi").select(  # one row
        row, F.col(elpd).alias("__best")
    )
    d = F.col(elpd) - F.col("__best")
    differences = pointwise.join(reference, row).groupBy("model").agg(
        F.sum(d).alias("elpd_diff"),
        (F.sqrt(F.count(F.lit(1)).cast("double")) * F.stddev_samp(d)).alias("se_diff"),
    )
    return differences.join(totals, "model").select(
        "model", "elpd_diff", "se_diff", "elpd_loo", "se_elpd_loo"
    ).orderBy(F.desc("elpd_loo"), "model")
