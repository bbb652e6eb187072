"""Posterior predictive check and convergence report."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracktally.operators import diagnose
from tracktally.operators.matching import join_same
from tracktally.operators.predict import predictive_draws
from tracktally.operators.quantiles import count_quantiles, named
from tracktally.plans.forecasts import category_order
from tracktally.session import written_once
from tracktally.sources.draws import select_draws, variable_name

# Probabilities and names of the predictive box.
BOX_PROBS = (0.025, 0.25, 0.5, 0.75, 0.975)
BOX_NAMES = ("q_lower", "iqr_lower", "median", "iqr_upper", "q_upper")


def posterior_check(draws: DataFrame, data: DataFrame, observation_col: str, count_col: str,
                    facet_col: str, x_col: str, parameter: str = "log_lambda",
                    seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """Predictive quantiles beside the observed count, with ``IN_CI``.

    ``draws`` has ``keys, draw``, the observation id and the parameter column, as
    ``parameter_draws`` reads them off a saved table. ``keys`` name the segments; data
    without these columns serve every segment. A ``MONTH`` facet comes in calendar order.
    """
    predicted = predictive_draws(draws, observation_col, parameter, seed, keys)
    boxes = count_quantiles(predicted, [*keys, observation_col], "post_pred", BOX_PROBS).select(
        *keys, observation_col, *named(F.col("q"), BOX_NAMES)
    )
    shared = [k for k in keys if k in data.columns]
    seen = data.select(*shared, observation_col, count_col, facet_col, x_col)
    checked = join_same(boxes, seen, [*shared, observation_col]).withColumn(
        "IN_CI", F.col(count_col).between(F.col("q_lower"), F.col("q_upper"))
    )
    return checked.orderBy(*keys, category_order(facet_col), x_col) if facet_col == "MONTH" else checked


def coverage(checked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Percentage of observations inside their 95% predictive interval, per segment."""
    inside = F.col("IN_CI").cast("int")  # whole numbers add up in any order, so the order of ``checked`` is not made
    return checked.groupBy(*keys).agg(
        F.round(F.avg(inside) * 100, 1).alias("COVERAGE_PCT"),
        F.count(F.lit(1)).alias("N_OBS"),
    )


@dataclass(frozen=True)
class Diagnostics:
    """``pairs`` and ``density`` are None for a single parameter."""

    summary: DataFrame
    worst: DataFrame
    trace: DataFrame
    pairs: DataFrame | None
    density: DataFrame | None


def diagnostics(draws: DataFrame, variables: Iterable[str], warmup: bool = True, k: int = 5,
                n_pairs: int = 4) -> Diagnostics:
    """Convergence report of the named parameters; an unknown name raises.

    The draws of each variable are gathered and saved once: the measures need no further
    shuffle, and the trace and the pair tables, which depend on the measures' order, read
    only the variables they show. The measures are saved too.
    """
    draw, kept = ["chain", "iteration", "value", "is_warmup"], F.coalesce(~F.col("is_warmup"), F.lit(False))
    packed = written_once(
        select_draws(draws, variables, warmup=True)
        .groupBy("idx", "base")  # numbers sort faster than names
        .agg(F.collect_list(F.when(kept, F.struct(*draw))).alias("kept"),
             F.collect_list(F.when(~kept, F.struct(*draw))).alias("others"))
        .select(variable_name().alias("variable"), "kept", "others"),
        "gathered",
    )
    measured = written_once(diagnose.report(packed.filter(F.size("kept") > 0), "kept"), "measures")
    several = measured.limit(2).count() > 1
    four = diagnose.worst(measured, n_pairs).select("variable")

    def of(few: DataFrame, drawn: Column) -> DataFrame:
        chosen = packed.join(F.broadcast(few), "variable", "left_semi")  # one to four names
        return chosen.select("variable", F.explode(drawn).alias("d")).select("variable", "d.*")

    shown = of(four, F.col("kept"))
    traced = of(diagnose.lowest(measured), F.concat("kept", "others") if warmup else F.col("kept"))
    return Diagnostics(
        summary=measured.orderBy(F.asc_nulls_last("ess_bulk"), "variable"),
        worst=diagnose.worst(measured, k).select("variable", "rhat", "ess_bulk", "ess_tail"),
        trace=diagnose.trace(traced, measured),
        pairs=diagnose.hexbin(diagnose.pair_rows(shown, four)) if several else None,
        density=diagnose.density(shown, four) if several else None,
    )
