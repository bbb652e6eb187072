import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_grid_and_paths import LOCATION_TOTALS, MONTH_TOTALS
from tracktally.operators import fit as fitting
from tracktally.operators import predict, regression
from tracktally.plans import checks, forecasts, modelling, models

DRAWS = "basin string, draw int, is_warmup boolean, base string, idx int, value double"


def gamma_draws(spark, totals, years, size=2000):
    """Draws of independent conjugate rates, as a sampler's long table with an intercept."""
    rng = np.random.default_rng(3)
    logs = np.log(rng.gamma(np.array(totals)[:, None] + 0.5, 1 / years, (len(totals), size)))
    rows = [("all", d + 1, False, "beta_0", None, 0.25) for d in range(size)]
    rows += [("all", d + 1, False, "beta", k + 1, float(logs[k, d] - 0.25)) for k in range(len(totals)) for d in range(size)]
    rows += [("all", 1, True, "beta", 1, 50.0), ("all", 1, True, "beta_0", None, 50.0)]
    return spark.createDataFrame(rows, DRAWS)


@pytest.fixture(scope="module")
def landfalls(spark):
    rows = []
    for month, total in enumerate(MONTH_TOTALS, start=1):
        rows += [(2000 + i % 25, month) for i in range(total)]
    return spark.createDataFrame(rows, "YEAR int, MONTH int").withColumn("basin", F.lit("all"))


def test_months_from_draws_to_totals_and_coverage(spark, landfalls):
    rates = models.category_rates(gamma_draws(spark, MONTH_TOTALS, 25), ["basin"])
    grid = modelling.monthly_grid(landfalls, 2000, 2024)
    stars = models.cell_rates(rates, grid, "MONTH_ID", "PRED_ID", "log_lambda_star")
    totals = forecasts.forecast(stars, grid, "MONTH", keys=["basin"]).totals.collect()
    assert [r.MONTH for r in totals][:2] == ["January", "February"]  # calendar order
    got = {r.MONTH: r["median"] for r in totals}
    # Published five-year medians
    for month, want in (("September", 31), ("August", 24), ("October", 22)):
        assert abs(got[month] - want) <= 2
    fitted = models.cell_rates(rates, grid, "MONTH_ID", "ALL_ID")
    checked = checks.posterior_check(fitted, modelling.observed(grid), "ALL_ID", "LANDFALL_COUNT", "MONTH", "YEAR",
                                     keys=["basin"])
    assert checks.coverage(checked).first().COVERAGE_PCT > 90


def test_locations_from_draws_to_totals(spark):
    rows = [(2000 + i % 25, name, "all") for name, n in LOCATION_TOTALS.items() for i in range(n)]
    source = spark.createDataFrame(rows, "YEAR int, LOCATION string, basin string")
    cells, ids = models.location_cells(source, "basin", 2000, 2024)
    assert ids.count() == 10
    rates = models.category_rates(gamma_draws(spark, cells.first().y, 25), ["basin"])
    grid = modelling.location_grid(source, 2000, 2024)
    stars = models.cell_rates(rates, grid, "LOC_ID", "PRED_ID", "log_lambda_star")
    out = forecasts.forecast(stars, grid, "LOCATION", keys=["basin"]).totals
    got = {r.LOCATION: r["median"] for r in out.collect()}
    # Published five-year medians
    assert abs(got["United States"] - 30) <= 2 and abs(got["Mexico"] - 28) <= 2


def test_years_outside_the_range_are_not_counted(spark):
    rows = [(1999, 1, "x", "a"), (2000, 1, "x", "a"), (2001, 2, "x", "a"), (2001, 2, "y", "a"), (2002, 1, "z", "a")]
    df = spark.createDataFrame(rows, "YEAR int, MONTH int, LOCATION string, basin string")
    assert models.month_cells(df, "basin", 2000, 2001).first().y == [1.0, 2.0] + [0.0] * 10
    assert models.month_year_cells(df, "basin", 2000, 2001).first().y == [1.0, 0.0, 0.0, 2.0] + [0.0] * 20
    cells, ids = models.location_cells(df, "basin", 2000, 2001, k=10)  # fewer than k
    assert cells.first().y == [2.0, 1.0] and [r.LOCATION for r in ids.orderBy("LOC_ID").collect()] == ["x", "y"]
    grid = modelling.location_grid(df, 2000, 2001, 1, k=10)
    assert "2" in grid.columns and "3" not in grid.columns and grid.count() == 6


def test_year_effect_of_draws(spark):
    z, rho, sigma = [0.3, -0.2, 0.1], 0.6, 0.8
    rows = [("all", 1, False, "beta", 9, 0.7), ("all", 1, False, "gp_lengthscale", None, rho),
            ("all", 1, False, "gp_sigma", None, sigma), ("all", 1, True, "z", 1, 99.0)]
    rows += [("all", 1, False, "z", j + 1, w) for j, w in enumerate(z)]
    rates = models.month_year_rates(spark.createDataFrame(rows, DRAWS), 2000, 2024, 5, ["basin"])
    assert rates.count() == 30
    x = models.standard_years(2000, 2024, 5)[7]
    f = sum(
        sigma * math.sqrt(math.sqrt(2 * math.pi) * rho) * math.exp(-0.25 * (rho * math.pi / 2.4) ** 2 * j * j) * w
        * math.sin(math.pi / 2.4 * (x + 1.2) * j) / math.sqrt(1.2) for j, w in enumerate(z, start=1))
    assert rates.filter("idx = 9 AND YEAR = 2007").first().log_lambda == pytest.approx(0.7 + f, abs=1e-9)


def test_regression_with_an_empty_category(spark):
    rows = [("a", 4), ("a", 6), ("b", 1), ("b", 2), ("c", 0), ("c", 0)]
    cells = spark.createDataFrame(rows, "k string, n int")
    got = {r.category: r.coefficient for r in fitting.poisson_regression(cells, "k", "n").collect()}
    assert got == {"a": pytest.approx(math.log(5)), "b": pytest.approx(math.log(1.5)), "c": None}


def test_linear_predictor_of_one_hot_rows(spark):
    effects = spark.createDataFrame([(1, 1, 0.5), (1, 2, -0.5), (2, 1, 1.0), (2, 2, -1.0), (1, 0, 2.0), (2, 0, 3.0)],
                                    "draw int, idx int, value double")
    design = spark.createDataFrame([(10, 0, 1.0), (10, 1, 1.0), (11, 0, 1.0), (11, 2, 1.0)], "row int, idx int, x double")
    got = {(r.draw, r.row): r.log_lambda for r in predict.linear_predictor(design, effects, "row", ["draw"]).collect()}
    assert got == {(1, 10): 2.5, (1, 11): 1.5, (2, 10): 4.0, (2, 11): 2.0}


def test_several_terms_against_plain_newton(spark):
    rng = np.random.default_rng(4)
    rows = []
    for a in range(4):
        for b in range(3):
            for year in range(2000, 2006):
                rows.append((f"a{a}" if a else None, b, year, int(rng.poisson(math.exp(0.8 + 0.3 * a - 0.4 * b + 0.1 * (year - 2003))))))
    rows += [("never", 1, 2001, 0), ("never", 2, 2002, 0), ("a1", 1, 2003, None)]
    cells = spark.createDataFrame(rows, "a string, b int, year int, n int")
    smooth = regression.Smooth("year", 2000, 2005, 2)
    fit = regression.fit_poisson(cells.repartition(5), ["a", "b"], "n", [smooth])
    got = {(r.term, r.level): r for r in fit.coefficients.collect()}
    used = [r for r in rows if r[0] != "never" and r[3] is not None]
    x = []
    for a, b, year, _ in used:
        t = (year - 2000) / 5 * 2 - 1
        k = 0 if a is None else int(a[1])
        fa = [-1.0] * 3 if k == 3 else [float(k == i) for i in range(3)]
        fb = [-1.0] * 2 if b == 2 else [float(b == i) for i in range(2)]
        x.append([1.0, *fa, *fb, *(math.sin(math.pi / 2.4 * (t + 1.2) * j) / math.sqrt(1.2) for j in (1, 2))])
    x, y, beta = np.array(x), np.array([r[3] for r in used], float), np.zeros(8)
    for _ in range(50):
        mu = np.exp(x @ beta)
        beta += np.linalg.solve(x.T @ (x * mu[:, None]), x.T @ (y - mu))
    want = {("intercept", None): beta[0], ("a", None): beta[1], ("a", "a1"): beta[2], ("a", "a3"): -beta[1:4].sum(),
            ("b", "2"): -beta[4:6].sum(), ("year", "1"): beta[6], ("year", "2"): beta[7]}
    for key, value in want.items():
        assert got[key].coefficient == pytest.approx(value, abs=1e-7)
    cov = np.linalg.inv(x.T @ (x * np.exp(x @ beta)[:, None]))
    assert got["a", "a3"].std_error == pytest.approx(math.sqrt(cov[1:4, 1:4].sum()), rel=1e-6)
    assert got["a", "never"].coefficient is None
    assert fit.log_likelihood == pytest.approx(float(y @ (x @ beta) - np.exp(x @ beta).sum()))
    moments = {(r.term, r.level): r for r in fit.moments(cells, "n").collect()}
    assert moments["a", "never"].fitted == 0.0
    assert all(r.observed == pytest.approx(r.fitted, abs=1e-6) for r in moments.values())
    new = spark.createDataFrame([("new", 1, 2001), ("never", 1, 2001)], "a string, b int, year int")
    assert [r.fitted for r in fit.predict(new).collect()] == [None, 0.0]


def test_one_factor_is_the_log_mean(spark):
    cells = spark.createDataFrame([("a", 4), ("a", 6), ("b", 1), ("b", 2)], "k string, n int")
    got = {(r.term, r.level): r.coefficient for r in regression.fit_poisson(cells, ["k"], "n").coefficients.collect()}
    assert got["intercept", None] + got["k", "a"] == pytest.approx(math.log(5))
    assert got["intercept", None] + got["k", "b"] == pytest.approx(math.log(1.5))
    with pytest.raises(ValueError, match="no events"):
        regression.fit_poisson(cells.withColumn("n", F.lit(0)), ["k"], "n")
