import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracktally.functions.numeric import keyed_uniform, ln_factorial, poisson_quantile, probit
from tracktally.operators import predict
from tracktally.operators.quantiles import count_quantiles, spread_quantiles


def test_ln_factorial(spark):
    rows = spark.createDataFrame([(k,) for k in (0, 1, 5, 20, 21, 50, 400, 100_000)], "k long")
    for r in rows.select("k", ln_factorial(F.col("k")).alias("v")).collect():
        assert r.v == pytest.approx(math.lgamma(r.k + 1), rel=1e-13, abs=1e-13)


def test_probit(spark):
    ps = [1e-6, 0.001, 0.02425, 0.1, 0.5, 0.77, 0.99, 0.999999]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", probit(F.col("p")).alias("z")).collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-7)


def smallest_k(rate, u):
    mass, k = math.exp(-rate), 0
    total = mass
    while total < u:
        k += 1
        mass *= rate / k
        total += mass
    return k


def test_poisson_quantile(spark):
    cases = [(rate, u) for rate in (0.01, 0.7, 4.0, 90.0, 500.0)
             for u in (1.2e-10, 0.01, 0.5, 0.9, 0.9999, 1 - 1.2e-10)]
    df = spark.createDataFrame([(math.log(r), u) for r, u in cases] + [(None, 0.5)], "ll double, u double")
    got = [r.k for r in df.coalesce(1).select(poisson_quantile("ll", "u").alias("k")).collect()]
    assert got == [smallest_k(r, u) for r, u in cases] + [None]


def test_poisson_quantile_of_a_large_rate(spark):
    df = spark.createDataFrame([(math.log(1e6), 0.5)], "ll double, u double")
    assert df.select(poisson_quantile("ll", "u").alias("k")).first().k == 1_000_000


def test_draws_do_not_depend_on_partitions(spark):
    rates = spark.range(1, 301).select(F.col("id").alias("row"), (F.col("id") % 7).alias("draw"),
                                       (F.col("id") / 100).alias("log_lambda"))
    one = predict.predictive_draws(rates.coalesce(1), "row").collect()
    many = predict.predictive_draws(rates.repartition(13), "row").collect()
    assert sorted(one) == sorted(many)
    u = [r.u for r in rates.select(keyed_uniform(1, F.col("row")).alias("u")).collect()]
    assert 0 < min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.06


def test_contrasts(spark):
    q = np.array(predict.contrast_weights(12))
    assert np.allclose(q.T @ q, np.eye(11)) and np.allclose(q.sum(axis=0), 0)
    sd = predict.contrast_prior_sd(12)
    assert np.allclose(np.diag(q @ q.T) * sd**2, 1.0)
    z = spark.range(1, 12).select(F.lit(1).alias("draw"), F.col("id").cast("int").alias("idx"),
                                  (F.col("id") * 0.3 - 1).alias("value"))
    got = {r.idx: r.value for r in predict.sum_to_zero_effects(z, ["draw"], 12).collect()}
    want = q @ np.array([i * 0.3 - 1 for i in range(1, 12)])
    assert [got[k] for k in range(1, 13)] == pytest.approx(list(want))
    assert sum(got.values()) == pytest.approx(0, abs=1e-12)


def test_basis(spark):
    xs = [-1.0, 0.2, 1.0]
    boundary = predict.basis_boundary([-1.0, 0.65])
    assert boundary == pytest.approx(1.2)
    assert predict.basis_boundary([-1.0, 0.65], compat=True) == pytest.approx(0.78)
    points = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in predict.basis_table(points, "x", boundary, 5).collect():
        want = math.sin(math.pi / 2.4 * (r.x + 1.2) * r.m) / math.sqrt(1.2)
        assert r.phi == pytest.approx(want, abs=1e-12)
    w = predict.spectral_weight(F.lit(3), F.lit(0.5), F.lit(0.4), boundary)
    got = spark.range(1).select(w.alias("w")).first().w
    want = 0.5 * math.sqrt(math.sqrt(2 * math.pi) * 0.4) * math.exp(-0.25 * (0.4 * math.pi / 2.4) ** 2 * 9)
    assert got == pytest.approx(want)


def test_predictive_mass_sums_to_one(spark):
    draws = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") / 120).alias("log_lambda"))
    totals = predict.predictive_mass(draws, ["g"]).groupBy("g").agg(F.sum("mass").alias("s")).collect()
    assert [r.s for r in totals] == pytest.approx([1.0] * 3, abs=1e-9)


def test_histogram_density(spark):
    df = spark.createDataFrame([("a", 0), ("a", 2), ("a", 2), ("b", 1)], "f string, v int")
    got = {(r.f, r.centre): r.density for r in predict.density_histogram(df, ["f"], "v").collect()}
    assert got == {("a", 0.0): pytest.approx(1 / 3), ("a", 2.0): pytest.approx(2 / 3), ("b", 1.0): 1.0}


def test_quantiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(3)
    groups = {"skewed": np.exp(rng.normal(0, 3, 4000)), "flat": np.full(50, 2.5), "one": np.array([7.0]),
              "two": np.array([1.0, 2.0]), "ties": rng.integers(0, 4, 300).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    probs = (0.0, 0.025, 0.5, 0.975, 1.0)
    for fn in (spread_quantiles, count_quantiles):
        got = {r.k: r.q for r in fn(df, ["k"], "v", probs).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            assert got[k] == pytest.approx(list(np.quantile(vs, probs)), rel=1e-12)


def test_quantiles_of_values_with_outliers(spark):
    rng = np.random.default_rng(8)
    flat = rng.random(3000)
    groups = {"far": np.append(flat, 1e300), "both": np.concatenate([flat, [-1e300, 1e300, 1e-300]]),
              "ladder": 10.0 ** rng.integers(-300, 300, 3000) * rng.random(3000), "same": np.full(500, 3.0),
              None: np.append(flat, -1e308)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {r.k: r.q for r in spread_quantiles(df, ["k"], "v", probs, bins=256, most=100).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(list(np.quantile(vs, probs)), rel=1e-12)
    endless = spark.createDataFrame([("a", float(x)) for x in ["-inf", *range(100), "inf", "nan"]], "k string, v double")
    (row,) = spread_quantiles(endless, ["k"], "v", (0.0, 0.5), bins=8, most=4).collect()
    assert row.q == [float("-inf"), 50.0]


def test_poisson_draw_ends_for_large_rates_and_refuses_infinite_ones(spark):
    top = 1 - 2.0**-33
    rates = [1e2, 1e4, 1e6, 1e8, 1e9, float("inf")]
    rows = [(r, u) for r in rates for u in (0.5, top)]
    df = spark.createDataFrame(rows, "rate double, u double")
    out = {(r.rate, r.u): r.k for r in df.withColumn("k", poisson_quantile(F.log("rate"), F.col("u"))).collect()}
    for rate in rates[:-1]:
        assert abs(out[rate, 0.5] - rate) <= 1
        assert 5.5 < (out[rate, top] - rate) / rate**0.5 < 8
    assert out[float("inf"), 0.5] is None


def test_constant_one_year_and_infinite_inputs(spark):
    from pyspark.sql import functions as F

    from tracktally.operators import diagnose, grid, predict

    pairs = spark.createDataFrame([("a", "b", 1.0, float(v)) for v in range(5)], "x_var string, y_var string, x double, y double")
    cells = diagnose.hexbin(pairs).collect()
    assert sum(r.n for r in cells) == 5 and {r.cell_x for r in cells} <= {0.0, 0.5}
    draws = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0), ("b", 4.0)], "variable string, value double")
    found = diagnose.density(draws, draws.select("variable").distinct(), points=4).collect()
    assert all((r.density is None) == (r.variable == "a") for r in found)
    years = spark.range(1).select(grid.unit_interval_year(F.lit(2000), 2000, 2000).alias("x"))
    assert years.first().x == -1.0
    rates = spark.createDataFrame([(1, 0.5), (1, float("inf")), (1, 800.0), (1, float("nan")), (1, None)], "g int, log_lambda double")
    mass = {r.k: r.mass for r in predict.predictive_mass(rates, ["g"]).collect()}
    assert abs(sum(mass.values()) - 1) < 1e-9


def test_predictive_mass_of_large_and_repeated_rates(spark):
    """A band per distinct rate, equal to the plain masses of all draws."""
    groups = {"large": [1e6, 1e6, 1.001e6], "mixed": [0.0, 0.3, 0.3, 90.0, 2500.0], "none": [float("nan")]}
    rows = [(g, float(np.log(r)) if r else float("-inf")) for g, rates in groups.items() for r in rates]
    draws = spark.createDataFrame(rows, "g string, log_lambda double")
    found = predict.predictive_mass(draws, ["g"])
    mass = {(r.g, r.k): r.mass for r in found.collect()}
    assert {g for g, _ in mass} == {"large", "mixed"} and len(mass) < 30_000
    for g in ("large", "mixed"):
        assert sum(m for (name, _), m in mass.items() if name == g) == pytest.approx(1, abs=1e-7)

    def plain(k, rates):
        return sum(math.exp(k * math.log(r) - r - math.lgamma(k + 1)) if r else float(k == 0) for r in rates) / len(rates)

    for g, k in [("large", 1_000_000), ("large", 999_000), ("mixed", 0), ("mixed", 1), ("mixed", 90), ("mixed", 2510)]:
        assert mass[g, k] == pytest.approx(plain(k, groups[g]), rel=1e-6)
