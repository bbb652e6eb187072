"""Arithmetic the SQL dialect lacks, as plain column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Coefficients of the published rational approximation to the
# inverse normal distribution function (relative error below 1.15e-9).
PROBIT_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PROBIT_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01)
PROBIT_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PROBIT_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00)
PROBIT_LOW = 0.02425


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def probit(p: Column) -> Column:
    """Inverse of the standard normal distribution function."""
    def tail(t: Column) -> Column:
        q = F.sqrt(-2.0 * F.ln(t))
        return horner(q, PROBIT_C) / horner(q, (*PROBIT_D, 1.0))

    q = p - 0.5
    centre = horner(q * q, PROBIT_A) * q / horner(q * q, (*PROBIT_B, 1.0))
    return (
        F.when(p < PROBIT_LOW, tail(p))
        .when(p > 1 - PROBIT_LOW, -tail(1.0 - p))
        .otherwise(centre)
    )


def probits(p: np.ndarray) -> np.ndarray:
    """The same of an array."""
    q = np.sqrt(-2.0 * np.log(np.minimum(p, 1.0 - p)))
    tail = np.polyval(PROBIT_C, q) / np.polyval((*PROBIT_D, 1.0), q)
    q = p - 0.5
    centre = np.polyval(PROBIT_A, q * q) * q / np.polyval((*PROBIT_B, 1.0), q * q)
    return np.where(p < PROBIT_LOW, tail, np.where(p > 1 - PROBIT_LOW, -tail, centre))


def ln_factorial(k: Column) -> Column:
    """ln(k!): exact integers up to 20, the Stirling series beyond."""
    x = k.cast("double")
    series = (
        (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi)
        + 1.0 / (12.0 * x) - 1.0 / (360.0 * x * x * x) + 1.0 / (1260.0 * F.pow(x, 5))
    )
    return F.when(k <= 20, F.ln(F.factorial(k.cast("int")).cast("double"))).otherwise(series)


def poisson_log_mass(count: Column, log_rate: Column) -> Column:
    weighed = F.when(count == 0, 0.0).otherwise(count * log_rate)  # a rate of zero has the logarithm -inf
    return weighed - F.exp(log_rate) - ln_factorial(count)


def keyed_uniform(*key: Column | int | str) -> Column:
    """Uniform number in (0, 1) that depends on the key values alone.

    The same key gives the same number in any partitioning and after any retry.
    """
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") + 0.5) / 4294967296.0


def log_factorials(k: np.ndarray) -> np.ndarray:
    x = np.maximum(k, 21.0)
    series = ((x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi)
              + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5))
    exact = np.array([math.lgamma(i + 1.0) for i in range(21)])
    return np.where(k <= 20, exact[np.nan_to_num(np.clip(k, 0, 20)).astype(int)], series)


def log_masses(k: np.ndarray, ll: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Log Poisson mass; large counts by their deviance, which loses no digits."""
    n = np.maximum(k, 1.0)
    deviance = k * np.log1p((rate - k) / n) - (rate - k)
    stirling = 0.5 * np.log(2.0 * np.pi * n) + 1.0 / (12.0 * n) - 1.0 / (360.0 * n**3) + 1.0 / (1260.0 * n**5)
    return np.where(k > 20, deviance - stirling, k * ll - rate - log_factorials(k))


@F.pandas_udf(T.LongType())
def poisson_quantile(log_rate: pd.Series, u: pd.Series) -> pd.Series:
    """Smallest k with CDF(k) >= u: a Poisson draw when ``u`` is uniform.

    The sum of masses starts at a count below which less than the smallest step of
    ``keyed_uniform`` lies, so the answer is exact and a row costs about the root of
    its rate. A batch advances together, which a fold over arrays on the JVM side
    does some hundred times slower; only rows that go on are kept from step to step.
    """
    with np.errstate(over="ignore"):
        finite = np.isfinite(np.exp(log_rate.to_numpy(dtype=float, na_value=np.nan)))
    known = (log_rate.notna() & u.notna()).to_numpy() & finite
    ll = log_rate.to_numpy(dtype=float)[known]
    goal = u.to_numpy(dtype=float)[known]
    rate = np.exp(ll)
    k = np.maximum(0.0, np.floor(rate - 7.0 * np.sqrt(rate) - 10.0))
    mass = np.exp(-rate)
    high = np.flatnonzero(k)
    mass[high] = np.exp(log_masses(k[high], ll[high], rate[high]))
    live = np.flatnonzero(mass < goal)
    rate, goal, count, mass = rate[live], goal[live], k[live], mass[live]
    reached = mass
    while len(live):
        count = count + 1.0
        mass = mass * (rate / count)
        before, reached = reached, reached + mass
        # beyond the mode a mass too small to count ends the sum, whatever rounding left short
        going = (reached < goal) & ((count < rate) | (reached > before))
        k[live[~going]] = count[~going]
        live, rate, goal, count, mass, reached = (x[going] for x in (live, rate, goal, count, mass, reached))
    out = pd.Series(pd.NA, index=log_rate.index, dtype="Int64")
    out[known] = k.astype("int64")
    return out
