"""Poisson regression with several terms: sum-to-zero factors and smooth bases of a number.

Cells collapse to one row for each combination of levels and numbers first. The fit is
iteratively reweighted least squares: in each step every task adds up the weighted Gram
matrix, the score and the log likelihood of its rows, the sums are added by entry, and the
driver solves a system as large as the number of columns, whatever the number of cells.

A NULL level is a level. A level without any event has no finite estimate: NULL, with a
fitted count of zero; its rows take no part. Rows whose count is NULL are left out. Columns
that say the same get the smallest of their possible weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracktally.session import written_once

#: Columns of a fit: its Gram matrix has the square of that many entries.
MAX_COLUMNS = 500
MAX_STEPS = 100
SLICE_VALUES = 1 << 21
COEFFICIENTS = "term string, level string, coefficient double, std_error double"


@dataclass(frozen=True)
class Smooth:
    """Sine functions of a number that is scaled from [first, last] to [-1, 1]."""

    column: str
    first: float
    last: float
    functions: int
    boundary: float = 1.2

    def values(self, x: Column) -> list[Column]:
        span = self.last - self.first
        scaled = (x - self.first) / span * 2 - 1 if span else F.lit(0.0) * x
        angle = (scaled + self.boundary) * (math.pi / (2 * self.boundary))
        return [F.sin(angle * j) / math.sqrt(self.boundary) for j in range(1, self.functions + 1)]


@dataclass(frozen=True)
class PoissonFit:
    """``coefficients`` has a row for the intercept, each level and each basis function."""

    coefficients: DataFrame
    factors: tuple[str, ...]
    smooths: tuple[Smooth, ...]
    log_likelihood: float
    steps: int

    def predict(self, cells: DataFrame, name: str = "fitted") -> DataFrame:
        """Cells with their fitted mean: zero at a level without events, NULL at an unknown one."""
        known = {(r.term, r.level): r.coefficient for r in self.coefficients.collect() if r.term not in self.factors}
        eta, empty, unknown = F.lit(known["intercept", None]), F.lit(False), F.lit(False)
        out = cells
        for i, factor in enumerate(self.factors):
            levels = self.coefficients.filter(F.col("term") == factor).select(
                F.col("level").alias(f"__l{i}"), F.col("coefficient").alias(f"__c{i}"), F.lit(True).alias(f"__k{i}"))
            out = out.join(F.broadcast(levels), F.col(factor).cast("string").eqNullSafe(F.col(f"__l{i}")), "left")
            unknown = unknown | F.col(f"__k{i}").isNull()
            empty = empty | F.col(f"__c{i}").isNull()
            eta = eta + F.coalesce(F.col(f"__c{i}"), F.lit(0.0))
        for smooth in self.smooths:
            for j, value in enumerate(smooth.values(F.col(smooth.column)), start=1):
                eta = eta + value * known[smooth.column, str(j)]
        mean = F.when(unknown, None).when(empty, 0.0).otherwise(F.exp(eta))
        return out.withColumn(name, mean).select(*cells.columns, name)

    def moments(self, cells: DataFrame, count: str) -> DataFrame:
        """``term, level, observed, fitted``: what the score equations of the fit make equal.

        The counts of each level and the counts weighted by each basis function, once as they
        are and once as fitted.
        """
        fitted = self.predict(cells).filter(F.col(count).isNotNull())
        sums = lambda w: [F.sum(w * F.col(c)).alias(n) for c, n in ((count, "observed"), ("fitted", "fitted"))]
        parts = [
            fitted.groupBy(F.col(f).cast("string").alias("level")).agg(*sums(F.lit(1.0))).select(F.lit(f).alias("term"), "level", "observed", "fitted")
            for f in self.factors
        ]
        for smooth in self.smooths:
            weights = F.posexplode(F.array(*smooth.values(F.col(smooth.column)))).alias("at", "w")
            each = fitted.select(count, "fitted", weights).groupBy((F.col("at") + 1).cast("string").alias("level"))
            parts.append(each.agg(*sums(F.col("w"))).select(F.lit(smooth.column).alias("term"), "level", "observed", "fitted"))
        return reduce(DataFrame.unionByName, parts)


def _levels(table: DataFrame, factor: str) -> list[tuple[str | None, bool]]:
    """Levels in order, NULL first, and whether each has events; their number is checked."""
    found = table.groupBy(F.col(factor).cast("string").alias("level")).agg((F.sum("n") > 0).alias("seen"))
    rows = found.limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"{factor} has more than {MAX_COLUMNS} levels")
    return sorted(((r.level, r.seen) for r in rows), key=lambda x: (x[0] is not None, x[0]))


def _design(batch: pa.RecordBatch, sizes: Sequence[int], functions: int) -> np.ndarray:
    """Intercept, factor columns (the last level is minus all others) and basis values."""
    rows, column = batch.num_rows, 1
    x = np.zeros((rows, 1 + sum(n - 1 for n in sizes) + functions))
    x[:, 0] = 1.0
    for i, n in enumerate(sizes):
        level = batch.column(f"f{i}").to_numpy()
        last = level == n - 1
        x[np.flatnonzero(~last), column + level[~last]] = 1.0
        x[last, column : column + n - 1] = -1.0
        column += n - 1
    for j in range(functions):
        x[:, column + j] = batch.column(f"s{j}").to_numpy()
    return x


def _sums(rows: DataFrame, beta: np.ndarray, sizes: Sequence[int], functions: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted Gram matrix, score and log likelihood at ``beta``."""
    p = len(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, score, likelihood = np.zeros((p, p)), np.zeros(p), 0.0
        for batch in batches:
            for start in range(0, batch.num_rows, max(1, SLICE_VALUES // p)):
                part = batch.slice(start, max(1, SLICE_VALUES // p))
                x = _design(part, sizes, functions)
                n, m = part.column("n").to_numpy(), part.column("m").to_numpy()
                eta = x @ beta
                mean = m * np.exp(eta)
                gram += x.T @ (x * mean[:, None])
                score += x.T @ (n - mean)
                likelihood += float(n @ eta - mean.sum())
        values = np.concatenate([gram.ravel(), score, [likelihood]])
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(values)), "v": values})

    with np.errstate(over="ignore"):
        total = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(p * p + p + 1)
    flat[total["i"].to_numpy()] = total["v"].to_numpy()
    return flat[: p * p].reshape(p, p), flat[p * p : -1], float(flat[-1])


def fit_poisson(cells: DataFrame, factors: Sequence[str], count: str, smooths: Sequence[Smooth] = ()) -> PoissonFit:
    """Maximum likelihood of ``count`` on an intercept, the factors and the smooth terms."""
    spark, numbers = cells.sparkSession, [s.column for s in smooths]
    table = written_once(
        cells.filter(F.col(count).isNotNull()).groupBy(*dict.fromkeys([*factors, *numbers])).agg(
            F.sum(F.col(count).cast("double")).alias("n"), F.count(F.lit(1)).cast("double").alias("m")),
        "regression",
    )
    listed = {f: _levels(table, f) for f in factors}
    seen = {f: [level for level, known in rows if known] for f, rows in listed.items()}
    if not all(seen.values()) or table.filter("n > 0").isEmpty():
        raise ValueError("no events to fit")
    live = table
    for i, factor in enumerate(factors):
        numbered = spark.createDataFrame([(level, k) for k, level in enumerate(seen[factor])], f"__l{i} string, f{i} int")
        live = live.join(F.broadcast(numbered), F.col(factor).cast("string").eqNullSafe(F.col(f"__l{i}")))
    values = [v for s in smooths for v in s.values(F.col(s.column))]
    rows = written_once(
        live.select("n", "m", *(f"f{i}" for i in range(len(factors))), *(v.alias(f"s{j}") for j, v in enumerate(values))), "regression-design"
    )
    sizes = [len(seen[f]) for f in factors]
    p = 1 + sum(n - 1 for n in sizes) + len(values)
    if p > MAX_COLUMNS:
        raise ValueError(f"{p} columns; at most {MAX_COLUMNS}")
    whole = rows.agg(F.sum("n"), F.sum("m")).first()
    beta = np.zeros(p)
    beta[0] = math.log(whole[0] / whole[1])
    gram, score, likelihood = _sums(rows, beta, sizes, len(values))
    for step in range(MAX_STEPS):
        change = np.linalg.lstsq(gram, score, rcond=None)[0]
        settled = float(score @ change) <= 1e-12 * max(1.0, whole[0])
        new = _sums(rows, beta + change, sizes, len(values))
        while not new[2] >= likelihood - 1e-9 * abs(likelihood):  # also where it is not a number
            change /= 2
            new = _sums(rows, beta + change, sizes, len(values))
        beta, (gram, score, likelihood) = beta + change, new
        if settled:
            break
    else:
        raise ValueError(f"no convergence in {MAX_STEPS} steps")
    covariance = np.linalg.pinv(gram, hermitian=True)
    out: list[tuple] = [("intercept", None, float(beta[0]), math.sqrt(max(0.0, covariance[0, 0])))]
    at = 1
    for factor, n in zip(factors, sizes, strict=True):
        spread = np.vstack([np.eye(n - 1), -np.ones((1, n - 1))])
        estimate = spread @ beta[at : at + n - 1]
        error = np.sqrt(np.maximum(0.0, np.einsum("ij,jk,ik->i", spread, covariance[at : at + n - 1, at : at + n - 1], spread)))
        made = dict(zip(seen[factor], zip(estimate.tolist(), error.tolist(), strict=True), strict=True))
        out += [(factor, level, *made.get(level, (None, None))) for level, _ in listed[factor]]
        at += n - 1
    for smooth in smooths:
        for j in range(smooth.functions):
            out.append((smooth.column, str(j + 1), float(beta[at + j]), math.sqrt(max(0.0, covariance[at + j, at + j]))))
        at += smooth.functions
    return PoissonFit(spark.createDataFrame(out, COEFFICIENTS), tuple(factors), tuple(smooths), likelihood, step + 1)
