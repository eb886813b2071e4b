import itertools
import math
from datetime import date

import numpy as np
import pandas as pd
import pytest

from civicpulse.operators.panel import TreatmentEvent, treatment_dates
from civicpulse.stats import causal, dist, inequality, regression, series
from civicpulse.stats import spatial_models as sm


def test_distributions():
    assert math.isclose(dist.t_p(2.0, 10), 0.07338803477074049, rel_tol=1e-10)
    assert math.isclose(dist.t_p(1.0, 1), 0.5, rel_tol=1e-12)
    u = 10 / (10 + 4 * 3.0)
    assert math.isclose(dist.f_sf(3.0, 4, 10), 6 * u**5 - 5 * u**6, rel_tol=1e-12)
    assert math.isclose(dist.normal_p(1.959963984540054), 0.05, rel_tol=1e-9)
    assert dist.beta_inc(2, 3, 0) == 0 and dist.beta_inc(2, 3, 1) == 1


def test_ols_and_interrupted_series(spark):
    rng = np.random.default_rng(42)
    t = np.arange(60)
    y = 10 + 0.5 * t + np.where(t >= 30, 8 + 0.2 * t, 0) + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([("s", int(k), float(v)) for k, v in zip(t, y, strict=True)], "k string, day long, y double")
    r = regression.interrupted_time_series(df, "y", "day", 30, ["k"]).first()
    assert abs(r.pre_trend - 0.5) < 0.02 and abs(r.post_trend - 0.7) < 0.02 and abs(r.level_change - 8) < 0.5 and r.p_value_level < 1e-6
    x = np.column_stack([np.ones(60), t])
    fit = {r.name: r for r in regression.ols(df, "y", ["day"]).collect()}
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert math.isclose(fit["day"].coefficient, want[1], rel_tol=1e-9) and fit["const"].n == 60


def panel_frame(spark):
    rows = []
    for u in "ABCD":
        for i in range(6):
            on = date(2024, 4, 1) if u == "A" else None
            rows.append((u, f"2024-0{i + 1}", 10.0 + i + (5 if u == "A" and i >= 3 else 0), bool(on and i >= 3), on))
    return spark.createDataFrame(rows, "unit_id string, period string, y double, treatment boolean, treatment_date date")


def test_causal_goldens(spark):
    p = panel_frame(spark)
    cells = {r.period: r.att for r in causal.group_time_effects(p, "y").collect()}
    assert [cells[f"2024-0{i}"] for i in range(1, 7)] == [0, 0, 0, 5, 5, 5]
    assert causal.staggered_did(p, "y")["aggregated_att"] == pytest.approx(2.5)
    assert {r.period: r.att for r in causal.att_gt(p, "y").collect()}["2024-05"] == 5
    rel = {r.relative_period: r.coefficient for r in causal.event_study_effects(p, "y", 2, 2).collect()}
    assert rel == {-2: 0, -1: 0, 0: 5, 1: 5, 2: 5}
    found = causal.synthetic_control(p, "A", "y", 2)
    assert found["att"] == pytest.approx(5) and sum(found["donor_weights"].values()) == pytest.approx(1) and found["placebo_p_value"] in (1 / 3, 2 / 3, 1.0)
    with pytest.raises(ValueError):
        causal.synthetic_control(p, "B", "y")
    causal.check_monthly(p)
    with pytest.raises(ValueError):
        causal.check_monthly(p.withColumn("period", p["unit_id"]))
    assert causal.pre_trend_test([{"relative_period": -2, "coefficient": 1.0, "std_error": 0.0}]) == (None, None)
    f, pv = causal.pre_trend_test([{"relative_period": -2, "coefficient": 2.0, "std_error": 1.0}])
    assert f == 4 and pv == pytest.approx(dist.f_sf(4, 1, 1))
    dates = treatment_dates(spark, [TreatmentEvent("a", ("x",), date(2024, 5, 1)), TreatmentEvent("b", ("x", "y"), date(2024, 3, 1))])
    assert {r.unit_id: r.treatment_date for r in dates.collect()} == {"x": date(2024, 3, 1), "y": date(2024, 3, 1)}


def test_simplex_weights_equal_a_grid_search():
    rng = np.random.default_rng(0)
    d, a = rng.normal(size=(8, 3)), rng.normal(size=8)
    w = causal.simplex_weights(a, d)
    grid = [(i / 200, j / 200, 1 - (i + j) / 200) for i in range(201) for j in range(201 - i)]
    best = min(((a - d @ np.array(g)) ** 2).sum() for g in grid)
    assert w.sum() == pytest.approx(1) and (w >= 0).all() and ((a - d @ w) ** 2).sum() <= best + 1e-9


def test_power_goldens():
    assert causal.minimum_detectable_effect(10, 12) == pytest.approx(0.636808804, abs=1e-8)
    assert causal.minimum_detectable_effect(100, 12) == pytest.approx(0.201376625, abs=1e-8)
    assert causal.minimum_detectable_effect(50, 12, icc=0.01) == pytest.approx(0.241001473, abs=1e-8)
    with pytest.raises(ValueError):
        causal.minimum_detectable_effect(1, 12)


def test_panel_models(spark):
    rng = np.random.default_rng(0)
    rows = [(f"u{u}", f"p{t:02d}", float(r := rng.random()), float(100 + 10 * u + 3 * t + 50 * r + rng.normal())) for u in range(8) for t in range(12)]
    pdf = pd.DataFrame(rows, columns=["unit_id", "period", "x", "y"])
    df = spark.createDataFrame(rows, "unit_id string, period string, x double, y double")
    for time, names in ((False, ["unit_id"]), (True, ["unit_id", "period"])):
        dummies = pd.get_dummies(pdf[names], drop_first=False).to_numpy(float)
        beta = np.linalg.lstsq(np.column_stack([pdf["x"], dummies]), pdf["y"].to_numpy(), rcond=None)[0]
        found = regression.panel_fixed_effects(df, "y", ["x"], time_effects=time)
        assert found["coefficients"]["x"] == pytest.approx(beta[0], abs=1e-8) and found["std_errors"]["x"] > 0
    assert 45 < found["coefficients"]["x"] < 55 and found["n_entities"] == 8 and found["n_periods"] == 12
    for cluster in ("time", "both", None):
        assert regression.panel_fixed_effects(df, "y", ["x"], True, cluster)["std_errors"]["x"] > 0
    assert "x" in regression.panel_random_effects(pdf, "y", ["x"])["coefficients"]
    adjusted = regression.reporting_rate_adjustment(pdf, "y")
    assert 0 < adjusted["icc"] < 1 and len(adjusted["adjusted_rates"]) == 8
    spread = lambda m: max(m.values()) - min(m.values())
    assert spread(adjusted["adjusted_rates"]) < spread(adjusted["raw_rates"])


def test_oaxaca_identity_and_rd(spark):
    rng = np.random.default_rng(42)
    a = spark.createDataFrame([(float(x), float(2 + 3 * x + rng.normal())) for x in rng.normal(1, 1, 50)], "x double, y double")
    b = spark.createDataFrame([(float(x), float(1 + 2 * x + rng.normal())) for x in rng.normal(0, 1, 50)], "x double, y double")
    r = regression.oaxaca_blinder(a, b, "y", ["x"])
    assert r["explained"] + r["unexplained"] == pytest.approx(r["total_gap"]) and r["n_group_a"] == 50
    x = rng.uniform(-1, 1, 400)
    y = 1 + 2 * x + 5 * (x >= 0) + rng.normal(0, 0.5, 400)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    for kernel in ("triangular", "epanechnikov", "uniform"):
        found = regression.regression_discontinuity(df, "x", "y", kernel=kernel)
        assert abs(found["treatment_effect"] - 5) < 1 and found["ci_lower"] < found["treatment_effect"] < found["ci_upper"]
    h = found["bandwidth_left"]
    assert h == pytest.approx(max(1.84 * y.std() * 400**-0.2, 0.05 * np.ptp(x)))
    left, right = (x < 0) & (x >= -h), (x >= 0) & (x <= h)
    assert found["treatment_effect"] == pytest.approx(np.polyfit(x[right], y[right], 1)[1] - np.polyfit(x[left], y[left], 1)[1])
    with pytest.raises(ValueError):
        regression.regression_discontinuity(df, "x", "y", cutoff=5.0)


def test_changepoints_equal_brute_force():
    rng = np.random.default_rng(42)
    y = np.r_[rng.normal(50, 5, 50), rng.normal(80, 5, 50)]
    assert series.changepoints(y) == [50] and series.changepoints(y, "binseg") == [50]
    cost = lambda v: float(((v - v.mean()) ** 2).sum())
    for seed in range(5):
        v = np.random.default_rng(seed).normal(size=24) + np.repeat([0, 3, 1], 8)
        spots = range(3, 22)
        best = min((sum(cost(v[i:j]) for i, j in itertools.pairwise((0, *c, 24))) + 2.0 * len(c), c) for k in range(4) for c in itertools.combinations(spots, k)
                   if all(j - i >= 3 for i, j in itertools.pairwise((0, *c, 24))))
        assert series.changepoints(v, penalty=2.0, min_size=3, jump=1) == list(best[1])


def test_stl_and_anomalies():
    t = np.arange(60)
    y = 100 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 12)
    trend, season, resid = series.stl(y, 12)
    assert np.allclose(trend + season + resid, y) and np.abs(resid).max() < 0.5 and np.abs(np.diff(trend) - 0.5).max() < 0.1
    y = y + np.random.default_rng(42).normal(0, 1, 60)
    y[30] += 20
    at, z = series.stl_anomalies(y, 12)
    assert 30 in at.tolist() and z[at.tolist().index(30)] > 2
    with pytest.raises(ValueError):
        series.stl(y, 1)


def test_hawkes_recursion_equals_the_pair_matrix():
    t = np.sort(np.random.default_rng(42).uniform(0, 100, 80))
    got = series.fit_hawkes(t, 25)
    t, mu, a, b = t - t[0], 80 / (2 * (t[-1] - t[0])), 0.1, 1.0
    for _ in range(25):
        dt = t[:, None] - t[None, :]
        k = np.where(dt > 0, a * b * np.exp(-b * np.maximum(dt, 0)), 0)
        lam = mu + k.sum(axis=1)
        bg = (mu / lam).sum()
        mu, a, b = bg / t[-1], (80 - bg) / 80, (80 - bg) / (k / lam[:, None] * dt).sum()
    assert (got["background_rate"], got["triggering_kernel_alpha"], got["triggering_kernel_beta"]) == pytest.approx((mu, a, b))
    with pytest.raises(ValueError):
        series.fit_hawkes([1.0, 2.0])
    with pytest.raises(ValueError):
        series.fit_hawkes([1.0, 1.0, 1.0])


def test_theil_golden_and_latent_rates(spark):
    rows = [("A", 20.0, 1.0, "g"), ("B", 5.0, 1.0, "g"), ("C", 15.0, 1.0, "h"), ("D", 10.0, 1.0, "h")]
    units = spark.createDataFrame(rows, "unit_id string, value double, population double, grp string")
    r = inequality.theil(units).first()
    assert r.total == pytest.approx(0.1064401352862) and r.within_group == pytest.approx(r.total - r.between_group) and r.n_units == 4
    pairs = spark.createDataFrame([("A", 20.0, 1.0, "g"), ("B", 5.0, 1.0, "h"), ("C", 15.0, 1.0, "g"), ("D", 10.0, 1.0, "h")], units.schema)
    assert inequality.theil(pairs).first().between_group == pytest.approx(0.0822828785051)
    assert sum(x.contribution for x in inequality.theil_contributions(units).collect()) == pytest.approx(r.total)
    assert inequality.theil(units.withColumn("value", units["population"])).first().total == pytest.approx(0, abs=1e-12)
    counts = {"a": 50, "b": 100, "c": 30, "d": 80}
    em = inequality.latent_reporting_em(counts, dict.fromkeys(counts, 10_000))
    assert set(em["reporting_probabilities"].values()) == {0.5} and em["n_iterations"] == 2 and em["converged"]
    assert em["estimated_true_rates"]["a"] == pytest.approx(2 * 50 / 10_000)
    cov = {u: {"x": float(i)} for i, u in enumerate(counts)}
    assert 0 < inequality.latent_reporting_em(counts, dict.fromkeys(counts, 10_000), cov)["reporting_probabilities"]["a"] < 1


def grid(n):
    return {f"{i}_{j}": {f"{i + a}_{j + b}": 1.0 for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)) if 0 <= i + a < n and 0 <= j + b < n} for i in range(n) for j in range(n)}


def test_spatial_models(spark):
    w = grid(6)
    values = {u: 10.0 if int(u[2]) < 3 else 1.0 for u in w}
    m = sm.moran_test(values, w)
    assert m["statistic"] == pytest.approx(0.8148148148) and m["p_value"] == 0.001 and m == sm.moran_test(values, w)
    spot = {u: 10.0 + 0.1 * int(u[0]) if u in ("0_0", "0_1", "1_0", "1_1") else 1.0 + 0.01 * int(u[2]) for u in w}
    local = {r["unit_id"]: r["label"] for r in sm.local_moran_test(spot, w, 499)}
    assert local["0_0"] == "HH" and local["5_5"] in ("LL", "ns")
    units = sorted(w)
    wm = sm.weight_matrix(w, units)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(36, 1))
    y = np.linalg.solve(np.eye(36) - 0.6 * wm, 1 + 2 * x[:, 0] + rng.normal(0, 0.3, 36))
    lag = sm.spatial_regression(y, x, wm, ["x"])
    assert abs(lag["rho"] - 0.6) < 0.15 and abs(lag["coefficients"]["x"] - 2) < 0.3 and lag["rho_p_value"] < 0.01
    e = 1 + 2 * x[:, 0] + np.linalg.solve(np.eye(36) - 0.6 * wm, rng.normal(0, 0.3, 36))
    assert abs(sm.spatial_regression(e, x, wm, ["x"], "error")["coefficients"]["x"] - 2) < 0.3
    rows = [(f"u{i:02d}", float(40 + rng.random()), float(-74 + rng.random()), float(v := rng.normal()), float(1 + 2 * v + rng.normal(0, 0.1))) for i in range(20)]
    df = spark.createDataFrame(rows, "unit_id string, latitude double, longitude double, x double, y double")
    got = sm.gwr(df, "y", ["x"], kernel="gaussian").collect()
    assert all(abs(r.coefficient - 2) < 0.5 for r in got if r.name == "x") and len(got) == 40
    fit = sm.gwr_fit(got, {r[0]: r[4] for r in rows}, {r[0]: [r[3]] for r in rows})
    assert fit["global_r_squared"] > 0.9
    counts = {u: float(rng.poisson(20 if int(u[2]) < 3 else 5)) for u in w}
    smooth = sm.bym2_smooth(counts, dict.fromkeys(w, 10.0), w, 300, 300)
    left = np.mean([v for u, v in smooth["smoothed_rates"].items() if int(u[2]) < 3])
    right = np.mean([v for u, v in smooth["smoothed_rates"].items() if int(u[2]) >= 3])
    assert 1.5 < left < 2.5 and 0.3 < right < 0.8
    assert all(smooth["credible_lower"][u] <= smooth["smoothed_rates"][u] <= smooth["credible_upper"][u] for u in w)


def test_local_regression_equals_one_unit_at_a_time(spark):
    rng = np.random.default_rng(5)
    rows = [(f"u{i:02d}", float(40 + rng.random()), float(-74 + rng.random()), float(v := rng.normal()), float(1 + 2 * v + rng.normal(0, 0.5))) for i in range(30)]
    df = spark.createDataFrame(rows, "unit_id string, latitude double, longitude double, x double, y double")
    spots, x, y = np.array([r[1:3] for r in rows]), np.array([[1, r[3]] for r in rows]), np.array([r[4] for r in rows])
    d = np.linalg.norm(spots[:, None] - spots[None], axis=2)
    shapes = {"bisquare": lambda u: (1 - u**2) ** 2 if u <= 1 else 0.0, "gaussian": lambda u: np.exp(-(u**2) / 2), "exponential": lambda u: np.exp(-u), "uniform": lambda u: float(u <= 1)}

    def fit(i, h, shape, leave=None):
        w = np.sqrt([0.0 if j == leave else shape(d[i, j] / h) for j in range(30)])
        return np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]

    for kernel, shape in shapes.items():
        errors = {h: sum((y[i] - x[i] @ fit(i, h, shape, i)) ** 2 for i in range(30)) for h in np.percentile(d[d > 0], [50, 75, 90])}
        errors |= {h: np.inf for h in np.percentile(d[d > 0], [25])} if kernel in ("bisquare", "uniform") else {}
        got = sm.gwr(df, "y", ["x"], kernel=kernel).collect()
        h = got[0].bandwidth
        if kernel not in ("bisquare", "uniform"):  # with these a small bandwidth may leave a unit alone
            errors |= {q: sum((y[i] - x[i] @ fit(i, q, shape, i)) ** 2 for i in range(30)) for q in np.percentile(d[d > 0], [25])}
            assert h == pytest.approx(min(errors, key=errors.get))
        assert any(h == pytest.approx(q) for q in errors)
        for r in got:
            i = int(r.unit_id[1:])
            beta = fit(i, h, shape)
            assert r.coefficient == pytest.approx(beta[int(r.name == "x")], rel=1e-6, abs=1e-8)
            w = np.array([shape(u / h) for u in d[i]])
            r2 = 1 - (w * (y - x @ beta) ** 2).sum() / (w * (y - np.average(y, weights=w)) ** 2).sum()
            assert r.local_r_squared == pytest.approx(r2, rel=1e-6, abs=1e-8)
    with pytest.raises(ValueError, match="kernel"):
        sm.gwr(df, "y", ["x"], kernel="none")


def test_latent_rates_with_silent_units():
    counts = {"a": 50, "b": 0, "c": 30, "d": 0, "e": 12, "f": 7}
    people = dict.fromkeys(counts, 1_000)
    plain = inequality.latent_reporting_em(counts, people)
    assert plain["reporting_probabilities"] == {"a": 0.5, "b": 0.01, "c": 0.5, "d": 0.01, "e": 0.5, "f": 0.5}
    cov = {u: {"x": float(i % 2) + 0.1 * i} for i, u in enumerate(counts)}
    em = inequality.latent_reporting_em(counts, people, cov, max_iter=400)
    p = em["reporting_probabilities"]
    assert em["estimated_true_rates"]["a"] == pytest.approx(0.05 / p["a"], rel=1e-3)
    assert max(p["b"], p["d"]) < 0.5 and all(0 < v < 1 for v in p.values())
    # a round of the model from its own result changes nothing but what the tolerance leaves
    again = inequality.latent_reporting_em(counts, people, cov, max_iter=401)
    assert again["n_iterations"] == em["n_iterations"] or not em["converged"]


def test_synthetic_did_finds_a_planted_effect(spark):
    """Parallel series with a drop of five in one unit; a common shock and noise change little."""

    rng = np.random.default_rng(3)
    for noise, tolerance in ((0.0, 1e-6), (0.3, 0.8)):
        shock = rng.normal(0, 3, 24)
        rows = []
        for u in range(8):
            for t in range(24):
                treated = u == 0 and t >= 12
                y = 50 + 1.5 * u + 0.2 * t + shock[t] - 5 * treated + noise * rng.normal()
                rows.append((f"U{u}", f"{2024 + t // 12}-{t % 12 + 1:02d}", date(2025, 1, 1) if u == 0 else None, float(y)))
        panel = spark.createDataFrame(rows, "unit_id string, period string, treatment_date date, y double")
        got = causal.synthetic_did(panel, "y", 7)
        assert got["att"] == pytest.approx(-5, abs=tolerance) and got["treated_units"] == ("U0",)
        assert sum(got["unit_weights"].values()) == pytest.approx(1, abs=1e-2) and sum(got["time_weights"].values()) == pytest.approx(1, abs=1e-2)
    assert got["p_value"] < 0.01 and 0 < got["std_error"] < 1
    with pytest.raises(ValueError):
        causal.synthetic_did(panel.where("unit_id <> 'U0'"), "y")
