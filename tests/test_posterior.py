import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracktally.catalog import posterior as catalog
from tracktally.operators import compare, diagnose, predict
from tracktally.plans import checks, forecasts
from tracktally.sources import draws as D


@pytest.fixture(scope="module")
def logistic(spark):
    """Long draws of one scalar and one vector, 4 chains, 60 warm-up and 200 kept."""
    rng = np.random.default_rng(11)
    rows = []
    for base, idx, rho in (("alpha", None, 0.0), ("beta", 1, 0.5), ("beta", 2, 0.9), ("beta", 3, 0.2)):
        for chain in range(1, 5):
            x = 0.0
            for it in range(1, 261):
                x = rho * x + math.sqrt(1 - rho**2) * rng.normal()
                rows.append(("m", chain, it, (chain - 1) * 200 + it - 60, it <= 60, base, idx, float(x)))
    return spark.createDataFrame(
        rows, "model string, chain int, iteration int, draw int, is_warmup boolean, base string, idx int, value double"
    ).withColumn("variable", D.variable_name())


def test_unknown_variable_raises(spark, logistic, tmp_path):
    with pytest.raises(ValueError, match="not_a_real_param"):
        D.select_draws(logistic, ["alpha", "not_a_real_param"])
    D.save_draws(logistic, str(tmp_path / "draws"))
    saved = D.load_draws(spark, str(tmp_path / "draws"))
    assert D.select_draws(saved, ["alpha"]).count() == 800
    assert D.select_draws(saved, ["alpha"], warmup=True).count() == 1040


def test_melt_keeps_ids_and_reads_the_index(spark):
    wide = spark.createDataFrame([(1, 1, 1, 0.5, 0.25, 9.0)],
                                 "`.chain` int, `.iteration` int, `.draw` int, `log_lambda[1]` double, `log_lambda[12]` double, `lp__` double")
    out = D.melt(wide).select(D.base_of(F.col("variable")).alias("b"), D.index_of(F.col("variable")).alias("i"), "value")
    assert sorted(map(tuple, out.collect()), key=str) == [
        ("log_lambda", 1, 0.5), ("log_lambda", 12, 0.25), ("lp__", None, 9.0)]


def test_measures(spark, logistic):
    kept = logistic.filter("NOT is_warmup")
    got = {r.variable: r for r in diagnose.measure(kept).collect()}
    rhat = {r.variable: r.rhat for r in diagnose.rank_rhat(kept).collect()}
    for name, r in got.items():
        assert r.rhat == pytest.approx(rhat[name], abs=1e-9)
        assert 0.99 < r.rhat < 1.2
    # 800 draws; autoregression shrinks them by about (1 - rho) / (1 + rho)
    for name, rho in (("alpha", 0.0), ("beta[1]", 0.5), ("beta[2]", 0.9), ("beta[3]", 0.2)):
        want = 800 * (1 - rho) / (1 + rho)
        assert want * 0.5 < got[name].ess_bulk < want * 2.0
    worst = [r.variable for r in diagnose.worst(diagnose.measure(kept)).collect()]
    assert worst[0] == "beta[2]" and len(worst) == 4  # fewer than five variables
    trace = diagnose.trace(logistic, diagnose.measure(kept))
    assert trace.count() == 1040 and trace.filter("is_warmup").count() == 240
    assert {r.variable for r in trace.select("variable").distinct().collect()} == {"beta[2]"}


def test_report(spark, logistic):
    one = checks.diagnostics(logistic, ["alpha"], warmup=False)
    assert one.pairs is None and one.density is None
    assert one.worst.count() == 1 and one.trace.filter("is_warmup").count() == 0
    full = checks.diagnostics(logistic, ["alpha", "beta"])
    assert full.worst.columns == ["variable", "rhat", "ess_bulk", "ess_tail"]
    assert [r.variable for r in full.worst.collect()][0] == "beta[2]"
    assert full.summary.count() == 4 and full.trace.filter("is_warmup").count() == 240
    assert full.pairs.agg(F.sum("n")).first()[0] == 6 * 800
    with pytest.raises(ValueError):
        checks.diagnostics(logistic, ["not_a_real_param"])


def test_shifted_chain_is_flagged(spark, logistic):
    moved = logistic.filter("NOT is_warmup").withColumn(
        "value", F.col("value") + F.when(F.col("chain") == 1, 3.0).otherwise(0.0))
    assert min(r.rhat for r in diagnose.rank_rhat(moved).collect()) > 1.2


def test_odd_chains_drop_the_middle(spark):
    df = spark.range(7).select(F.lit("v").alias("variable"), F.lit(1).alias("chain"),
                               F.col("id").alias("iteration"), F.col("id").cast("double").alias("value"))
    halves = diagnose.split_chains(df).collect()
    assert sorted((r.half, r.t, r.value) for r in halves) == [
        (2, 1, 0.0), (2, 2, 1.0), (2, 3, 2.0), (3, 1, 4.0), (3, 2, 5.0), (3, 3, 6.0)]


def test_summary(spark, logistic):
    kept = logistic.filter("NOT is_warmup")
    for r in diagnose.summarise(kept).collect():
        x = np.array([v.value for v in kept.filter(F.col("variable") == r.variable).select("value").collect()])
        med = np.median(x)
        want = [x.mean(), med, x.std(ddof=1), 1.4826 * np.median(abs(x - med)), *np.quantile(x, [0.05, 0.95])]
        assert [r["mean"], r["median"], r.sd, r.mad, r.q5, r.q95] == pytest.approx(want)


def test_pairs_need_two_parameters(spark, logistic):
    kept = logistic.filter("NOT is_warmup")
    single = spark.createDataFrame([("alpha",)], "variable string")
    assert diagnose.pair_rows(kept, single).count() == 0
    four = kept.select("variable").distinct()
    pairs = diagnose.pair_rows(kept, four)
    assert pairs.count() == 6 * 800
    assert diagnose.hexbin(pairs).agg(F.sum("n")).first()[0] == 6 * 800
    mass = diagnose.density(kept, four, points=128)
    for v in ("alpha", "beta[2]"):
        rows = mass.filter(F.col("variable") == v).orderBy("i").collect()
        width = rows[1]["at"] - rows[0]["at"]
        assert sum(r.density for r in rows) * width == pytest.approx(1, abs=0.01)


def log_lik_rows(spark, rng, n=20, s=2000):
    """Draws of conjugate posteriors, whose leave-one-out density is known exactly."""
    rows, ll, exact = [], np.empty((n, s)), []
    for i in range(n):
        y = int(rng.poisson(3))
        lam = rng.gamma(y + 12, 1 / 5.0, s)
        ll[i] = y * np.log(lam) - lam - math.lgamma(y + 1)
        exact.append(math.lgamma(12 + y) - math.lgamma(12) - math.lgamma(y + 1)
                     + 12 * math.log(4 / 5) - y * math.log(5))
        rows += [("A", i, float(v)) for v in ll[i]] + [("B", i, float(v) - 0.2) for v in ll[i]]
    return spark.createDataFrame(rows, "model string, obs int, log_lik double"), ll, exact


def test_loo_and_comparison(spark):
    df, ll, exact = log_lik_rows(spark, np.random.default_rng(4))
    plain = {r.obs: r for r in compare.importance_loo(df, ["model", "obs"]).filter("model = 'A'").collect()}
    smooth_df = compare.smoothed_loo(df, ["model", "obs"])
    smooth = {r.obs: r for r in smooth_df.filter("model = 'A'").collect()}
    for i, x in enumerate(ll):
        assert plain[i].elpd_loo == pytest.approx(-math.log(np.mean(np.exp(-x))))
        assert plain[i].elpd_waic == pytest.approx(math.log(np.mean(np.exp(x))) - x.var(ddof=1))
        assert smooth[i].elpd_loo == pytest.approx(exact[i], abs=0.15)
        assert smooth[i].pareto_k < 0.7
    out = compare.compare_models(smooth_df, "obs").collect()
    assert [r.model for r in out] == ["A", "B"]
    assert out[0].elpd_diff == 0 and out[0].se_diff == 0
    assert out[1].elpd_diff == pytest.approx(-0.2 * 20) and out[1].se_diff == pytest.approx(0, abs=1e-9)
    assert out[0].elpd_loo == pytest.approx(sum(r.elpd_loo for r in smooth.values()))


def test_tail_shape_recovers_the_generator():
    rng = np.random.default_rng(0)
    for k in (0.1, 0.5, 0.9):
        x = np.sort(2.0 / k * ((1 - rng.random(4000)) ** -k - 1))
        (shape,), (scale,) = compare._tail_shape(x[None, :])
        assert shape == pytest.approx(k, abs=0.08) and scale == pytest.approx(2.0, rel=0.15)


def test_check_of_five_observations(spark):
    data = spark.createDataFrame(
        [(1, 2001, 1, "UK"), (2, 2002, 2, "FRANCE"), (3, 2003, 4, "ALBANIA"), (4, 2004, 2, "PORTUGAL"),
         (5, 2005, 5, "RUSSIA")], "OBS_ID int, YEAR int, COUNT int, COUNTRY string")
    draws = data.crossJoin(spark.range(1, 2001).withColumnRenamed("id", "draw")).select(
        "OBS_ID", "draw", (F.log(F.col("COUNT").cast("double")) + F.sin("draw") * 0.3).alias("theta"))
    out = checks.posterior_check(draws, data, "OBS_ID", "COUNT", "COUNTRY", "YEAR", parameter="theta")
    rows = out.collect()
    assert len(rows) == 5
    for r in rows:
        assert r.q_lower <= r.iqr_lower <= r["median"] <= r.iqr_upper <= r.q_upper
        assert r.IN_CI == (r.q_lower <= r.COUNT <= r.q_upper)
    assert checks.coverage(out).first().COVERAGE_PCT == 100.0


def test_totals_are_summed_before_quantiles(spark):
    grid = spark.createDataFrame([(1, "a", 2025), (2, "a", 2026), (3, "b", 2025), (4, "b", 2026), (None, "a", 2024)],
                                 "PRED_ID int, LOCATION string, YEAR int")
    draws = spark.range(400).select((F.col("id") % 100 + 1).alias("draw"),
                                    (F.floor(F.col("id") / 100) + 1).cast("int").alias("PRED_ID")).withColumn(
        "log_lambda_star", F.col("draw") / 100.0 + F.col("PRED_ID") * 0.2)
    out = forecasts.forecast(draws, grid, "LOCATION")
    from tracktally.operators.predict import predictive_draws

    y = {(r.draw, r.PRED_ID): r.post_pred for r in predictive_draws(draws, "PRED_ID", "log_lambda_star").collect()}
    got = {r.LOCATION: r for r in out.totals.collect()}
    for name, ids in (("a", (1, 2)), ("b", (3, 4))):
        sums = [sum(y[d, i] for i in ids) for d in range(1, 101)]
        want = np.quantile(sums, forecasts.FULL_PROBS)
        assert [got[name][c] for c in forecasts.FULL_NAMES] == pytest.approx(list(want))
    assert out.simple_totals.columns == ["LOCATION", *forecasts.SIMPLE_NAMES]
    assert out.rows.count() == 4
    first = out.first_year.groupBy("LOCATION").agg(F.sum("density").alias("s"), F.sum("n").alias("n")).collect()
    assert all(r.s == pytest.approx(1) and r.n == 100 for r in first)
    mass = forecasts.first_year_mass(draws, grid.filter("PRED_ID IS NOT NULL"), "LOCATION", 2025)
    assert [r.s for r in mass.groupBy("LOCATION").agg(F.sum("mass").alias("s")).collect()] == pytest.approx([1, 1], abs=1e-9)


def test_models_of_different_observations_are_refused(spark):
    rows = [("a", 1, -1.0), ("a", 2, -1.0), ("b", 1, -1.0)]
    df = spark.createDataFrame(rows, "model string, obs int, elpd_loo double")
    with pytest.raises(ValueError, match="same observations"):
        compare.compare_models(df, "obs")


def test_chains_of_unequal_lengths_have_no_measure(spark):
    rows = [("x", c, i, float((i * 37 + c * 11) % 17)) for c, n in ((1, 20), (2, 28)) for i in range(1, n + 1)]
    rows += [("y", c, i, float((i * 37 + c * 11) % 17)) for c in (1, 2) for i in range(1, 25)]
    df = spark.createDataFrame(rows, "variable string, chain int, iteration int, value double")
    out = {r.variable: r for r in diagnose.measure(df).collect()}
    assert out["x"].rhat is None and out["x"].ess_bulk is None and out["y"].rhat > 0


def test_segments_keep_their_own_totals(spark):
    grid = spark.createDataFrame([(1, "January", 2025), (2, "January", 2026)], "PRED_ID int, MONTH string, YEAR int")
    rows = [(s, d, p, math.log(r)) for s, r in (("a", 10.0), ("b", 100.0), (None, 1000.0))
            for d in range(1, 401) for p in (1, 2)]
    draws = spark.createDataFrame(rows, "basin string, draw int, PRED_ID int, log_lambda_star double")
    out = forecasts.forecast(draws, grid, "MONTH", keys=["basin"])
    got = {r.basin: r["median"] for r in out.totals.collect()}
    assert got["a"] == pytest.approx(20, abs=2) and got["b"] == pytest.approx(200, abs=5)
    assert got[None] == pytest.approx(2000, abs=15)  # a segment without a name is one too
    assert out.rows.count() == 6
    assert {r.basin: r.n for r in out.first_year.groupBy("basin").agg(F.sum("n").alias("n")).collect()} == {
        "a": 400, "b": 400, None: 400}
    mass = forecasts.first_year_mass(draws, grid, "MONTH", 2025, keys=["basin"])
    assert mass.groupBy("basin").count().count() == 3
    data = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), (None, 1, 1000)], "basin string, PRED_ID int, n int").withColumns(
        {"MONTH": F.lit("January"), "YEAR": F.lit(2025)})
    checked = checks.posterior_check(draws, data, "PRED_ID", "n", "MONTH", "YEAR", "log_lambda_star", keys=["basin"])
    assert {r.basin: r.IN_CI for r in checked.collect()} == {"a": True, "b": False, None: True}
    assert {r.basin: r.COVERAGE_PCT for r in checks.coverage(checked, ["basin"]).collect()} == {
        "a": 100.0, "b": 0.0, None: 100.0}


def test_month_facets_come_in_calendar_order(spark):
    data = spark.createDataFrame([(1, "April", 2), (2, "January", 1), (3, "March", 1)], "OBS_ID int, MONTH string, n int")
    draws = data.crossJoin(spark.range(1, 101).withColumnRenamed("id", "draw")).select(
        "OBS_ID", "draw", F.lit(0.5).alias("log_lambda"))
    out = checks.posterior_check(draws, data.withColumn("YEAR", F.lit(2001)), "OBS_ID", "n", "MONTH", "YEAR")
    assert [r.MONTH for r in out.collect()] == ["January", "March", "April"]


def test_saved_parameter_in_the_shape_of_the_plans(spark, logistic):
    got = D.parameter_draws(logistic, "beta", "OBS_ID", ["model"])
    assert got.columns == ["model", "draw", "OBS_ID", "beta"] and got.count() == 3 * 800
    with pytest.raises(ValueError, match="gamma"):
        D.parameter_draws(logistic, "gamma", "OBS_ID")


def test_fits_are_compared_from_a_saved_table(spark):
    from tracktally.plans import comparing

    rows = [(m, d, "log_lambda", i, False, rate + 0.05 * math.sin(d * i))
            for m, rate in (("near", math.log(4.0)), ("far", math.log(9.0))) for d in range(1, 201) for i in range(1, 9)]
    draws = spark.createDataFrame(rows, "model string, draw int, base string, idx int, is_warmup boolean, value double")
    data = spark.createDataFrame([(i, 3 + i % 3) for i in range(1, 9)], "OBS_ID int, n int")
    out = comparing.compare_fits(draws, data, "OBS_ID", "n").collect()
    assert [r.model for r in out] == ["near", "far"] and out[0].elpd_diff == 0 and out[1].elpd_diff < -5


def published_size(x):
    """Effective size of (chains, iterations), lag by lag as published."""
    m, n = x.shape
    c = x - x.mean(axis=1, keepdims=True)
    acov = np.array([[(r[:n - t] * r[t:]).sum() / n for t in range(n)] for r in c])
    mean = acov.mean(axis=0)
    w = mean[0] * n / (n - 1)
    total = w * (n - 1) / n + x.mean(axis=1).var(ddof=1)
    even, odd, t = 1.0, 1 - (w - mean[1]) / total, 0
    rho = np.zeros(n)
    rho[0], rho[1] = even, odd
    while t < n - 5 and even + odd > 0:
        t += 2
        even, odd = 1 - (w - mean[t]) / total, 1 - (w - mean[t + 1]) / total
        if even + odd >= 0:
            rho[t], rho[t + 1] = even, odd
    last = t
    if even > 0:
        rho[last] = even
    for t in range(2, last - 1, 2):
        if rho[t] + rho[t + 1] > rho[t - 2] + rho[t - 1]:
            rho[t] = rho[t + 1] = (rho[t - 2] + rho[t - 1]) / 2
    tau = -1 + 2 * rho[:max(last, 1)].sum() + rho[last]
    return m * n / max(tau, 1 / math.log10(m * n))


def test_effective_size_follows_the_published_sum():
    rng = np.random.default_rng(5)
    for n in (7, 20, 21, 60):
        for rho in (-0.7, 0.0, 0.6, 0.95):
            x = rng.normal(size=(6, n))
            for t in range(1, n):
                x[:, t] += rho * x[:, t - 1]
            assert diagnose._effective_size(x[None])[0] == pytest.approx(published_size(x))


def test_constant_draws_have_no_measure(spark):
    rows = [("same", c, i, 2.0) for c in (1, 2) for i in range(20)]
    rows += [("two", c, i, float(i % 2)) for c in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "variable string, chain int, iteration int, value double")
    for r in diagnose.measure(df).collect():
        assert r.rhat is None and r.ess_tail is None  # two values lie equally far from the median
    assert [r.rhat for r in diagnose.rank_rhat(df).collect()] == [None, None]


def test_measures_rank_without_a_sort_of_all_draws(spark):
    """A group's draws are ranked inside the group: no window sorts long rows."""
    rows = [(f"v{v}", c, i, float((v * 31 + c * 17 + i * i * 7) % 23)) for v in range(3) for c in (1, 2) for i in range(1, 13)]
    df = spark.createDataFrame(rows, "variable string, chain int, iteration int, value double")
    for out in (diagnose.measure(df), diagnose.rank_rhat(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and out.count() == 3


def test_summary_leaves_null_draws_out_and_keeps_nan(spark):
    rows = [("a", 1, i, v) for i, v in enumerate([4.0, None, 1.0, 3.0])] + [("b", 1, 1, float("nan")), ("c", 1, 1, None), ("d", 1, 1, 2.0)]
    got = {r.variable: r for r in diagnose.summarise(spark.createDataFrame(rows, "variable string, chain int, iteration int, value double")).collect()}
    assert (got["a"].median, got["a"].mad) == (3.0, 1.4826) and abs(got["a"].q5 - 1.2) < 1e-12
    assert math.isnan(got["b"].mean) and got["c"].mean is None and (got["d"].mean, got["d"].sd) == (2.0, None)


def test_report_reads_gathered_draws_only(spark):
    """The pair tables come from the saved groups of the few variables, not from all long rows."""
    rows = [("x", v, c, i, float((v * 37 + c * 11 + i * i) % 19), i < 3) for v in range(1, 7) for c in (1, 2) for i in range(15)]
    df = spark.createDataFrame(rows, "base string, idx int, chain int, iteration int, value double, is_warmup boolean")
    out = checks.diagnostics(df, ["x"])
    assert "kept" in out.pairs._jdf.queryExecution().analyzed().toString()
    assert out.trace.count() == 30 and out.trace.filter("is_warmup").count() == 6
    assert out.pairs.agg(F.sum("n")).first()[0] == 6 * 24


def test_draws_are_never_the_broadcast_side(spark, tmp_path):
    """Draws unfolded from a few short rows look small to the planner."""
    spark.range(50).select(F.col("id").alias("c_custkey"), (F.col("id") % 7).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(500).select((F.col("id") % 50).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    ends = catalog.pointwise_loglik(spark, str(tmp_path)).agg(F.count("log_lik").alias("n"), F.sum("log_lik"))
    assert ends.collect()[0].n == 50 * 120
    plan = ends._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan


def test_predictive_mass_unfolds_no_rows(spark):
    """Bands are added up inside a batch; large, small and no rates, missing keys."""
    rows = [("a", math.log(3.0)), ("a", math.log(5.0)), ("b", math.log(5000.0)), (None, -math.inf), (None, None), ("b", math.log(0.5))]
    out = predict.predictive_mass(spark.createDataFrame(rows, "g string, ll double"), ["g"], "ll")
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.g, r.k): r.mass for r in out.collect()}
    plain = lambda k, r: math.exp(k * math.log(r) - r - math.lgamma(k + 1))
    for k in (0, 3, 30):
        assert math.isclose(got["a", k], (plain(k, 3.0) + plain(k, 5.0)) / 2, rel_tol=1e-9)
    for k in (4500, 5000, 5300):
        assert math.isclose(got["b", k], plain(k, 5000.0) / 2, rel_tol=1e-9)
    assert got[None, 0] == 1.0 and got[None, 20] == 0.0 and (None, 21) not in got and ("b", 3000) not in got


def test_rates_are_gathered_before_they_meet_counts(spark):
    """The same as smoothing the joined log likelihoods; repeated, missing and zero counts too."""
    rates = [(m, i, 0.1 * i + ((d * 37 + i * 11) % 41) / 50, d) for m in "AB" for i in range(6) for d in range(60)] + [("A", 7, None, 1)]
    rates = spark.createDataFrame(rates, "model string, obs long, log_lambda double, draw int")
    counts = spark.createDataFrame([(0, 0), (1, 3), (2, 30), (3, 4), (3, 5), (4, None), (7, 1)], "obs long, n int")
    plain = compare.smoothed_loo(predict.pointwise_log_lik(rates, counts, "obs", "n"), ["model", "obs"])
    packed = compare.smoothed_loo_of_rates(rates, counts, ["model", "obs"], "obs", "n")
    expected = {(r.model, r.obs): (r.elpd_loo, r.pareto_k) for r in plain.collect()}
    got = {(r.model, r.obs): (r.elpd_loo, r.pareto_k) for r in packed.collect()}
    assert set(got) == set(expected) and got["A", 4] == (None, None) and got["A", 7] == (None, None)
    assert all(math.isclose(a, b, rel_tol=1e-9) for k in got for a, b in zip(got[k], expected[k]) if b is not None)


def test_check_jobs_save_no_draws(spark, tmp_path, monkeypatch):
    spark.range(1, 13).selectExpr("id AS c_custkey", "CAST(id % 5 AS INT) AS c_nationkey",
                                  "IF(id = 3, NULL, concat('m', id % 3)) AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(400).selectExpr("id AS o_orderkey", "id * id % 11 + 1 AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(D, "save_draws", lambda *_: pytest.fail("draws that are read once are saved"))
    rows = catalog.posterior_check_job(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    for name in ("customer", "orders"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    sql = {q.name: q.sql for q in catalog.catalog.items}
    key = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, rows), key=key) == sorted(db.execute(sql["posterior_check_job"]).fetchall(), key=key)
    assert len(rows) == 12 and {r.IN_CI for r in rows} <= {True, False}
    shares = catalog.posterior_coverage_job(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, shares), key=str) == sorted(db.execute(sql["posterior_coverage_job"]).fetchall(), key=str)


def test_coverage_does_not_sort(spark):
    data = spark.createDataFrame([(1, "April", 2), (2, "January", 1), (3, "March", 90)], "OBS_ID int, MONTH string, n int")
    draws = data.crossJoin(spark.range(1, 101).withColumnRenamed("id", "draw")).select(
        "OBS_ID", "draw", F.lit(0.5).alias("log_lambda"))
    out = checks.coverage(checks.posterior_check(draws, data.withColumn("YEAR", F.lit(2001)), "OBS_ID", "n", "MONTH", "YEAR"))
    assert "rangepartitioning" not in out._jdf.queryExecution().toString()
    assert [tuple(r) for r in out.collect()] == [(66.7, 3)]
