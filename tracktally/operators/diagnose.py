"""Convergence measures and plot tables of posterior draws.

A variable's group is its kept draws (chains x iterations of the sampler), which is
a setting of the fit and does not grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracktally.functions.numeric import probits


#: Draws that a vectorised step takes at once, whatever the Arrow batch holds.
DRAWS_PER_STEP = 262_144


def gathered(value: str = "value") -> Column:
    """Aggregate: the draws of a group as ``chain, iteration, value`` structs."""
    return F.collect_list(F.struct("chain", "iteration", F.col(value).alias("value")))  # bounded, as all groups here


def _steps(draws: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.StructArray]]:
    """Some groups of a batch at a time: their numbers, their sizes and their draws end to end."""
    sizes = pc.fill_null(pc.list_value_length(draws), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    step = (np.cumsum(sizes) - sizes) // DRAWS_PER_STEP
    for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(step)) + 1):
        if len(rows):
            yield rows, sizes[rows], pc.list_flatten(draws.slice(rows[0], len(rows)))


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, NaN where there is none, and where that is."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False), missing


def _struct(out: np.ndarray, null: np.ndarray, names: Sequence[str], none: np.ndarray | None = None) -> pa.StructArray:
    fields = [pa.array(out[:, i], mask=null[:, i]) for i in range(out.shape[1])]
    return pa.StructArray.from_arrays(fields, list(names), mask=None if none is None else pa.array(none))


def _percentile(ordered: np.ndarray, p: float) -> np.ndarray:
    """Interpolated percentile of each row of ascending values."""
    at = (ordered.shape[1] - 1) * p
    low, high = ordered[:, math.floor(at)], ordered[:, math.ceil(at)]
    with np.errstate(invalid="ignore"):
        between = (math.ceil(at) - at) * low + (at - math.floor(at)) * high
    return np.where((low == high) | (at == math.floor(at)), low, between)


def _doubles(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


SUMMARY = ("mean", "median", "sd", "mad", "q5", "q95")


@F.arrow_udf(_doubles(SUMMARY))
def _summaries(draws: pa.Array) -> pa.Array:
    out = np.full((len(draws), len(SUMMARY)), np.nan)
    null = np.ones(out.shape, bool)
    for rows, sizes, flat in _steps(draws):
        value, missing = _numbers(flat.field("value"))
        known = np.bincount(np.repeat(np.arange(len(rows)), sizes)[~missing], minlength=len(rows))
        value, ends = value[~missing], np.cumsum(known)
        for n in np.unique(known[known > 0]):
            some = np.flatnonzero(known == n)
            x = value[(ends[some] - n)[:, None] + np.arange(n)]
            ordered = np.sort(x, axis=1)
            median = _percentile(ordered, 0.5)
            with np.errstate(invalid="ignore"):
                away = np.sort(np.abs(x - median[:, None]), axis=1)
                sd = x.std(axis=1, ddof=1) if n > 1 else np.full(len(x), np.nan)
                mad = 1.4826 * ((away[:, (n - 1) // 2] + away[:, n // 2]) / 2)
                mean = x.mean(axis=1)
            at = rows[some]
            out[at] = np.column_stack([mean, median, sd, mad, _percentile(ordered, 0.05), _percentile(ordered, 0.95)])
            null[at] = False
            null[at, SUMMARY.index("sd")] = n == 1
    return _struct(out, null, SUMMARY)


def summarise(draws: DataFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    """mean, median, sd, mad, q5, q95 per variable, from one gathering of its draws."""
    packed = draws.groupBy(variable).agg(gathered(value).alias("__d"))
    return packed.select(variable, _summaries("__d").alias("e")).select(variable, "e.*")


def split_chains(draws: DataFrame, variable: str = "variable") -> DataFrame:
    """Number the kept iterations and cut every chain in two: adds ``half`` and ``t``.

    With an odd length the middle iteration is left out.
    """
    along = W.partitionBy(variable, "chain").orderBy("iteration")
    place = F.row_number().over(along)
    length = F.count(F.lit(1)).over(
        along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    late = F.col("__len") - F.floor(F.col("__len") / 2)
    return (
        draws.withColumns({"__at": place, "__len": length})
        .withColumn("half", F.when(F.col("__at") <= F.floor(F.col("__len") / 2), F.col("chain") * 2)
                    .when(F.col("__at") > late, F.col("chain") * 2 + 1))
        .filter(F.col("half").isNotNull())
        .withColumn("t", F.when(F.col("half") % 2 == 0, F.col("__at")).otherwise(F.col("__at") - late))
        .drop("__at", "__len")
    )


def _order_key(x: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Integers in the order of the values: missing ones first, NaN last, both zeros equal."""
    bits = (x + 0.0).view(np.int64)
    key = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    key[np.isnan(x)] = np.iinfo(np.int64).max
    key[missing] = np.iinfo(np.int64).min
    return key


def _scores(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Normal scores of the average-tie ranks in each row; ``order`` sorts ``key``."""
    size = key.shape[1]
    ordered = np.take_along_axis(key, order, axis=1)
    place = np.arange(size)
    new = np.ones(ordered.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    last = np.ones(ordered.shape, bool)
    last[:, :-1] = new[:, 1:]
    low = np.maximum.accumulate(np.where(new, place, 0), axis=1)
    high = np.minimum.accumulate(np.where(last, place, size)[:, ::-1], axis=1)[:, ::-1]
    # ranks are multiples of a half: their scores come from a table
    table = probits((np.arange(2 * size - 1) / 2 + 1 - 0.375) / (size + 0.25))
    scores = np.empty(key.shape)
    np.put_along_axis(scores, order, table[low + high], axis=1)
    return scores


def _rank_scores(x: np.ndarray, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal scores of each row's ranks, and of the ranks of its distances to the median."""
    key = _order_key(x, missing)
    order = np.argsort(key, axis=1)
    middle = order[:, [(x.shape[1] - 1) // 2, x.shape[1] // 2]]
    (a, b), (no_a, no_b) = np.take_along_axis(x, middle, axis=1).T, np.take_along_axis(missing, middle, axis=1).T
    with np.errstate(invalid="ignore"):
        median = np.where(no_a, b, np.where(no_b, a, (a + b) / 2))
        away = np.abs(x - median[:, None])
    folded = _order_key(away, missing | (no_a & no_b)[:, None])
    return _scores(order, key), _scores(np.argsort(folded, axis=1), folded)


def _half_chains(rows: np.ndarray, sizes: np.ndarray, flat: pa.StructArray) -> Iterator[tuple]:
    """Groups whose chains, cut in two, have halves of one length: numbers, values and missing ones.

    Values have the shape (groups, half chains, iterations). The middle iteration of an odd
    chain is left out. Groups without a half are yielded with no values.
    """
    value, missing = _numbers(flat.field("value"))
    chain, iteration = flat.field("chain"), flat.field("iteration")
    owner = np.repeat(np.arange(len(rows)), sizes)
    named = chain.is_valid().to_numpy(zero_copy_only=False)
    number = pc.fill_null(chain, 0).to_numpy(zero_copy_only=False)
    early = pc.fill_null(iteration.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    if not named.all():
        owner, number, early, value, missing = (c[named] for c in (owner, number, early, value, missing))
    same = (owner[1:] == owner[:-1]) & (number[1:] == number[:-1])
    if not ((owner[1:] > owner[:-1]) | (number[1:] > number[:-1]) | (same & (early[1:] >= early[:-1]))).all():
        order = np.lexsort((early, number, owner))
        owner, number, value, missing = (c[order] for c in (owner, number, value, missing))
        same = (owner[1:] == owner[:-1]) & (number[1:] == number[:-1])
    start = np.flatnonzero(np.r_[True, ~same]) if len(owner) else np.zeros(0, np.int64)
    length = np.diff(np.r_[start, len(owner)])
    start, length = start[length > 1], length[length > 1]
    half, of = length // 2, owner[start]
    least, most = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), np.int64)
    np.minimum.at(least, of, half)
    np.maximum.at(most, of, half)
    chains = np.bincount(of, minlength=len(rows))
    yield rows[chains == 0], None, None
    fits = (least == most)[of]
    start, length, half, of = start[fits], length[fits], half[fits], of[fits]
    kinds = np.column_stack([chains[of], half])
    for m, n in np.unique(kinds, axis=0):
        mine = (kinds == (m, n)).all(axis=1)
        ends = np.column_stack([start[mine], (start + length - half)[mine]])
        at = (ends[:, :, None] + np.arange(n)).reshape(-1, 2 * m, n)
        yield rows[of[mine][::m]], value[at], missing[at]


def _effective_size(x: np.ndarray) -> np.ndarray:
    """Effective sample size of each (half chain, iteration) matrix in a stack.

    ``x`` has shape (variables, half chains, iterations). Autocovariances come from
    a padded transform. Pairs of lags are summed up to the first that is not positive,
    but never beyond the first even lag that is at least ``n - 5``, and made
    non-increasing; the even lag after them is added once where it is positive.
    Constant or non-finite draws have no such size.
    """
    _, m, n = x.shape
    means = x.mean(axis=2)
    padded = 1 << (2 * n - 1).bit_length()
    spectrum = np.fft.rfft(x - means[:, :, None], n=padded, axis=2)
    acov = np.fft.irfft(spectrum * spectrum.conj(), n=padded, axis=2)[:, :, :n] / n
    within = acov[:, :, 0].mean(axis=1) * n / (n - 1)
    total = within * (n - 1) / n
    if m > 1:
        total = total + means.var(axis=1, ddof=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = 1.0 - (within[:, None] - acov.mean(axis=1)) / total[:, None]
    rho[:, 0] = 1.0
    pairs = rho[:, 0:n - n % 2:2] + rho[:, 1::2]
    furthest = max(0, math.ceil((n - 5) / 2))
    live = np.logical_and.accumulate(pairs[:, :furthest] > 0, axis=1)
    steady = np.minimum.accumulate(pairs[:, :furthest], axis=1)
    end = live.sum(axis=1)
    even = np.take_along_axis(rho, 2 * end[:, None], axis=1)[:, 0]
    reached = np.take_along_axis(pairs, end[:, None], axis=1)[:, 0] >= 0
    # with no pair at all the published sum still counts lag 0
    summed = np.where(end > 0, np.where(live, steady, 0.0).sum(axis=1), 1.0)
    tau = -1.0 + 2.0 * summed + np.where((even > 0) | reached, even, 0.0)
    size = m * n
    return np.where(_undefined(x), np.nan, size / np.maximum(tau, 1.0 / math.log10(size)))


def _undefined(x: np.ndarray) -> np.ndarray:
    """Variables whose draws are all the same, or not all finite."""
    return (x == x[:, :1, :1]).all(axis=(1, 2)) | ~np.isfinite(x).all(axis=(1, 2))


def _split_rhat(x: np.ndarray) -> np.ndarray:
    n = x.shape[2]
    within = x.var(axis=2, ddof=1).mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        rhat = np.sqrt(((n - 1) / n * within + x.mean(axis=2).var(axis=1, ddof=1)) / within)
    return np.where(_undefined(x), np.nan, rhat)


MEASURES = ("rhat", "ess_bulk", "ess_tail")


def _measured(draws: pa.Array, least: int, sizes_too: bool) -> pa.Array:
    """R-hat and, with ``sizes_too``, effective sizes; groups without a half chain are NULL."""
    out = np.full((len(draws), 3 if sizes_too else 1), np.nan)
    empty = np.zeros(len(draws), bool)
    for rows, sizes, flat in _steps(draws):
        for at, x, missing in _half_chains(rows, sizes, flat):
            if x is None:
                empty[at] = True
                continue
            if x.shape[2] < least:
                continue  # very short chains have no such measure
            scores = _rank_scores(x.reshape(len(x), -1), missing.reshape(len(x), -1))
            score, fold = (z.reshape(x.shape) for z in scores)
            out[at, 0] = np.maximum(_split_rhat(score), _split_rhat(fold))
            if sizes_too:
                ends = np.quantile(x, (0.05, 0.95), axis=(1, 2))
                tails = [_effective_size((x <= q[:, None, None]).astype(float)) for q in ends]
                out[at, 1] = _effective_size(score)
                out[at, 2] = np.minimum(*tails)
    return _struct(out, np.isnan(out), MEASURES[: out.shape[1]], empty)


@F.arrow_udf(_doubles(MEASURES))
def _measures(draws: pa.Array) -> pa.Array:
    return _measured(draws, 3, True)


@F.arrow_udf(_doubles(MEASURES[:1]))
def _rhats(draws: pa.Array) -> pa.Array:
    return _measured(draws, 2, False)


def rank_rhat(draws: DataFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    """Split R-hat: the larger of the rank-normalised and the folded one."""
    packed = draws.groupBy(variable).agg(gathered(value).alias("__d"))
    rhat = F.when(F.col("e.rhat") < F.lit(float("inf")), F.col("e.rhat"))  # none where halves do not vary within
    return packed.select(variable, _rhats("__d").alias("e")).where("e IS NOT NULL").select(variable, rhat.alias("rhat"))


def measure(draws: DataFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    """``rhat``, ``ess_bulk`` and ``ess_tail`` per variable.

    Spark gathers each variable's draws; a vectorised function then cuts the chains in two,
    ranks the draws and handles all variables of a step together. Chains of unequal lengths
    give NULL.
    """
    packed = draws.groupBy(variable).agg(gathered(value).alias("__d"))
    return packed.select(variable, _measures("__d").alias("e")).where("e IS NOT NULL").select(variable, "e.*")


def report(packed: DataFrame, draws: str, variable: str = "variable") -> DataFrame:
    """``summarise`` and ``measure`` of gathered draws, the column ``draws``, in one pass."""
    both = packed.select(variable, _summaries(draws).alias("s"), _measures(draws).alias("e"))
    return both.where("e IS NOT NULL").select(variable, "s.*", "e.*")


def worst(measures: DataFrame, k: int = 5, by: str = "ess_bulk", variable: str = "variable") -> DataFrame:
    """The k variables with the smallest measure (all of them when fewer)."""
    return measures.orderBy(F.asc_nulls_last(by), variable).limit(k)


def lowest(measures: DataFrame, by: str = "ess_bulk", variable: str = "variable") -> DataFrame:
    """The name of the variable with the smallest measure."""
    return measures.agg(F.min_by(variable, F.struct(by, variable)).alias(variable))


def trace(draws: DataFrame, measures: DataFrame, by: str = "ess_bulk",
          variable: str = "variable") -> DataFrame:
    """All draws, warmup included and marked, of the variable with the smallest measure."""
    chosen = draws.join(F.broadcast(lowest(measures, by, variable)), variable, "left_semi")  # one row
    return chosen.select(variable, "chain", "iteration", "value", "is_warmup")


def pair_rows(draws: DataFrame, chosen: DataFrame, variable: str = "variable") -> DataFrame:
    """``x_var, y_var, x, y`` for each pair of the chosen variables in one iteration.

    ``chosen`` is a top-k list of at most four names. Each iteration gathers only
    those values, so there is no self join of the draws.
    """
    kept = draws.join(chosen.select(variable), variable, "left_semi")
    here = kept.groupBy("chain", "iteration").agg(
        F.array_sort(F.collect_list(F.struct(F.col(variable).alias("n"), F.col("value").alias("v"))))
        .alias("a")
    )
    first = here.select("a", F.posexplode("a").alias("i", "p"))
    second = first.select("p", F.explode(F.slice("a", F.col("i") + 2, F.size("a"))).alias("q"))
    return second.select(
        F.col("p.n").alias("x_var"), F.col("q.n").alias("y_var"),
        F.col("p.v").alias("x"), F.col("q.v").alias("y"),
    )


def hexbin(pairs: DataFrame, bins: int = 30) -> DataFrame:
    """Hexagonal bin counts per pair: cell centre in bin units and number of draws.

    Draws of a constant parameter have the place 0 on its axis.
    """
    keys = ["x_var", "y_var"]
    span = pairs.groupBy(*keys).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    place = lambda v: F.coalesce(
        F.try_divide(F.col(v) - F.col(f"{v}0"), F.nullif(F.col(f"{v}1") - F.col(f"{v}0"), F.lit(0.0))), F.col(v) - F.col(f"{v}0"))
    sx, sy = bins * place("x"), bins / math.sqrt(3) * place("y")
    placed = pairs.join(span, keys).select(*keys, sx.alias("sx"), sy.alias("sy"))
    even_x, even_y = F.floor(F.col("sx") + 0.5), F.floor(F.col("sy") + 0.5)
    odd_x, odd_y = F.floor("sx") + 0.5, F.floor("sy") + 0.5

    def apart(cx: Column, cy: Column) -> Column:
        return F.pow(F.col("sx") - cx, 2) + 3.0 * F.pow(F.col("sy") - cy, 2)

    near_even = apart(even_x, even_y) <= apart(odd_x, odd_y)
    return placed.groupBy(
        *keys,
        F.when(near_even, even_x.cast("double")).otherwise(odd_x).alias("cell_x"),
        F.when(near_even, even_y.cast("double")).otherwise(odd_y).alias("cell_y"),
    ).agg(F.count(F.lit(1)).alias("n"))


def density(draws: DataFrame, chosen: DataFrame, points: int = 64, fine_bins: int = 512,
            variable: str = "variable") -> DataFrame:
    """Gaussian kernel density per chosen variable on an even grid.

    Draws are counted in fine bins first, so the kernel sum runs over bins. A constant
    parameter, or one draw, has no density: NULL at its only place.
    """
    kept = draws.join(chosen.select(variable), variable, "left_semi")
    stats = kept.groupBy(variable).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"),
        F.stddev_samp("value").alias("sd"),
        F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"),
    ).withColumn(
        "h", 0.9 * F.least("sd", (F.col("q")[1] - F.col("q")[0]) / 1.34) * F.pow("n", F.lit(-0.2))
    ).drop("q", "sd")
    width = (F.col("hi") - F.col("lo")) / (fine_bins - 1)
    binned = (
        kept.join(stats, variable)
        .withColumn("bin", F.floor(F.coalesce(F.try_divide(F.col("value") - F.col("lo"), width), F.lit(0.0)) + 0.5))
        .groupBy(variable, "lo", "hi", "h", "n", "bin").agg(F.count(F.lit(1)).alias("w"))
    )
    start, step = F.col("lo") - 3 * F.col("h"), (F.col("hi") - F.col("lo") + 6 * F.col("h")) / (points - 1)
    spread = binned.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "at", start + F.col("i") * step
    )
    u = F.try_divide(F.col("at") - (F.col("lo") + F.col("bin") * width), F.col("h"))
    return spread.groupBy(variable, "i", "at").agg(
        F.sum(F.try_divide(F.col("w") * F.exp(-0.5 * u * u), F.col("n") * F.col("h") * math.sqrt(2 * math.pi)))
        .alias("density")
    )
