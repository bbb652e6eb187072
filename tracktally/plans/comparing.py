"""Comparison of saved fits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracktally.operators.compare import compare_models, smoothed_loo_of_rates
from tracktally.sources.draws import parameter_draws


def compare_fits(draws: DataFrame, data: DataFrame, row: str, count: str,
                 parameter: str = "log_lambda") -> DataFrame:
    """Models of a saved draw table by smoothed leave-one-out accuracy, best first.

    ``draws`` holds the log rates of every model under its ``model`` name; ``data`` has
    the observed counts. Models of different observations are refused.
    """
    rates = parameter_draws(draws, parameter, row, ["model"])
    return compare_models(smoothed_loo_of_rates(rates, data, ["model", row], row, count, parameter), row)
