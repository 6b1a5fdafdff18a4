"""Estimators against plain least squares with dummies, and identities between them."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripspark.functions import tails
from tripspark.operators import contrasts, fixed_effects, inference, longrun, regression, scm


def noise(*key):
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:8], 16) / 2**32 - 0.5


def make_panel(n_units=12, n_periods=10, effect=0.5, drop=()):
    rows = []
    for i in range(n_units):
        for p in range(n_periods):
            if (i, p) in drop:
                continue
            treat, post = int(i < n_units // 3), int(p >= n_periods // 2)
            y = 0.3 * i + 0.1 * p + effect * treat * post + 0.2 * noise("e", i, p)
            rows.append((i, p, treat, post, float(treat * post), y, 1.0 + i % 4, float(noise("x", i, p)), p % 5))
    return rows


SCHEMA = "zone int, t int, treat int, post int, tp double, y double, w_pre double, x double, woy int"


def dummies_ols(rows, xs, fes, cluster, w=None, y=5):
    """Plain least squares: all dummies at once, then the clustered sandwich for the regressors."""
    a = np.array([[float(v) for v in r] for r in rows])
    ww = np.ones(len(a)) if w is None else a[:, w]
    blocks, levels = [], 0
    for f in fes:
        keys = sorted({tuple(r[c] for c in f) for r in rows})
        at = {k: i for i, k in enumerate(keys)}
        m = np.zeros((len(rows), len(keys)))
        for j, r in enumerate(rows):
            m[j, at[tuple(r[c] for c in f)]] = 1
        blocks.append(m)
        levels += len(keys)
    d = np.hstack(blocks)
    s = np.sqrt(ww)[:, None]
    q = np.linalg.pinv(d * s)
    res = lambda v: v * s - (d * s) @ (q @ (v * s))
    x, yy = res(a[:, xs]), res(a[:, [y]])[:, 0]
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ yy
    e = yy - x @ b
    g = a[:, cluster]
    scores = np.array([(x[g == c] * e[g == c][:, None]).sum(0) for c in np.unique(g)])
    n, k, c = len(a), x.shape[1], len(np.unique(g))
    adj = c / (c - 1) * (n - 1) / max(n - k - (levels - (len(fes) - 1)), 1)
    return b, np.sqrt(np.diag(adj * inv @ scores.T @ scores @ inv)), yy


@pytest.mark.parametrize("drop", [(), ((0, 3), (5, 1), (5, 9), (11, 0))])
@pytest.mark.parametrize("w", [None, "w_pre"])
def test_fe_ols_equals_dummy_regression(spark, drop, w):
    rows = make_panel(drop=drop)
    df = spark.createDataFrame(rows, SCHEMA)
    fit = fixed_effects.fe_ols(df, "y", ["tp", "x"], ["zone", "t"], "zone", w)
    b, se, _ = dummies_ols(rows, [4, 7], [(0,), (1,)], 0, None if w is None else 6)
    assert fit.b == pytest.approx(b, abs=1e-9)
    assert np.sqrt(np.diag(fit.v)) == pytest.approx(se, abs=1e-9)
    assert abs(fit.b[0] - 0.5) < 3 * np.sqrt(fit.v[0, 0])


def test_three_effects_and_iteration_agree(spark):
    rows = make_panel(drop=((2, 2),))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("tw", F.concat_ws("_", "treat", "woy"))
    fit = fixed_effects.fe_ols(df, "y", ["tp"], ["zone", "t", "tw"], "zone")
    b, se, _ = dummies_ols(rows, [4], [(0,), (1,), (2, 8)], 0)
    assert fit.b == pytest.approx(b, abs=1e-9)
    exact = {(r.zone, r.t): r.y for r in fixed_effects.demean(df.select("zone", "t", "tw", "y"), ["y"], ["zone", "t", "tw"]).collect()}
    loop = {(r.zone, r.t): r.y for r in fixed_effects.demean_iterative(df.select("zone", "t", "tw", "y"), ["y"], ["zone", "t", "tw"]).collect()}
    assert max(abs(exact[k] - loop[k]) for k in exact) < 1e-6


def test_contrasts_equal_regression_on_balanced_panel(spark):
    df = spark.createDataFrame(make_panel(), SCHEMA).withColumn("k", F.col("t") - 5)
    periods = contrasts.periods_of(df, ["t", "post", "k", "woy"])
    for spec, k, extra, fes in (("twfe", 1, 0, ["zone", "t"]), ("trend", 2, 0, ["zone", "t"]), ("seasonal", 1, 9, ["zone", "t", "tw"])):
        w = contrasts.weights_frame(spark, "t", df.schema["t"].dataType, contrasts.post_weights(periods, spec))
        c = contrasts.unit_contrasts(df, "zone", "t", ["y"], w, ["treat"], len(periods))
        row = contrasts.estimate(c, ["outcome"], len(periods), k=k, extra_levels=extra).first()
        full = df.withColumn("tw", F.concat_ws("_", "treat", "woy")).withColumn("trend", F.col("treat") * F.col("k") / 52.0)
        fit = fixed_effects.fe_ols(full, "y", ["tp", "trend"] if spec == "trend" else ["tp"], fes, "zone")
        assert row.coef == pytest.approx(fit.b[0], abs=1e-9)
        assert row.se == pytest.approx(np.sqrt(fit.v[0, 0]), rel=1e-8)


def test_event_study_equals_dummies(spark):
    rows = make_panel()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.col("t") - 5)
    ks = [k for k in range(-5, 5) if k != -1]
    wide = df.withColumns({f"ev{i}": ((F.col("k") == k) & (F.col("treat") == 1)).cast("double") for i, k in enumerate(ks)})
    fit = fixed_effects.fe_ols(wide, "y", [f"ev{i}" for i in range(len(ks))], ["zone", "t"], "zone")
    periods = contrasts.periods_of(df, ["t", "k"])
    w = contrasts.weights_frame(spark, "t", df.schema["t"].dataType, contrasts.event_weights(periods))
    c = contrasts.unit_contrasts(df, "zone", "t", ["y"], w, ["treat"], 10)
    est = {int(r.term): r for r in contrasts.estimate(c, ["outcome", "term"], 10, k=9).collect()}
    assert [est[k].coef for k in ks] == pytest.approx(list(fit.b), abs=1e-9)
    assert [est[k].se for k in ks] == pytest.approx(list(np.sqrt(np.diag(fit.v))), rel=1e-8)
    cov = {(r.a, r.b): r.v for r in contrasts.covariance(c, "outcome", 10, k=9).collect()}
    assert cov["-2", "3"] == pytest.approx(fit.v[ks.index(-2), ks.index(3)], abs=1e-10)


def test_incomplete_unit_is_dropped_whole(spark):
    from tripspark.operators.panel import balanced_units

    cells = spark.createDataFrame([(u, p, 1) for u in (1, 2) for p in range(3) if (u, p) != (2, 1)], "zone int, wk int, n int")
    assert [r.zone for r in balanced_units(cells, ["zone"], "wk", 0.0, F.col("wk") < 2, 1.0).collect()] == [1]


def test_wild_bootstrap_expansion(spark):
    parts = [("y", i, noise("a", i), 0.1 + abs(noise("q", i)), 0.2, 1.5) for i in range(9)]
    df = spark.createDataFrame(parts, "outcome string, cluster int, a double, q double, b double, adj double")
    got = {r.draw: r for r in inference.wild_bootstrap(df, ["outcome", "adj"], 20, 7, F.col("adj")).collect()}
    webb = [-np.sqrt(1.5), -1.0, -np.sqrt(0.5), np.sqrt(0.5), 1.0, np.sqrt(1.5)]
    a, q = np.array([p[2] for p in parts]), np.array([p[3] for p in parts])
    for draw in (1, 13):
        u = [(int(hashlib.md5(f"7|{draw}|{i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32 for i in range(9)]
        v = np.array([webb[int(x * 6)] for x in u])
        for name, s in (("t_null", a), ("t_centred", a - 0.2 * q)):
            beta = (v * s).sum() / q.sum()
            t = beta * q.sum() / np.sqrt(1.5 * ((v * s - beta * q) ** 2).sum())
            assert got[draw][name] == pytest.approx(t, rel=1e-9)


def test_holm_and_bh(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.8)], "k string, p double")
    got = {r.k: (r.p_holm, r.q_bh) for r in inference.holm_bh(df, "p", ["k"]).collect()}
    assert got["a"] == pytest.approx((0.04, 0.04))
    assert got["c"] == pytest.approx((0.09, 0.16 / 3))
    assert got["b"] == pytest.approx((0.09, 0.16 / 3))
    assert got["d"] == pytest.approx((0.8, 0.8))


def test_conley_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 10, (15, 2))
    s = rng.normal(size=(15, 4))
    scores = spark.createDataFrame([("y", i, t, float(s[i, t])) for i in range(15) for t in range(4)], "o string, zone int, wk int, s double")
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "zone int, x double, y double")
    got = inference.conley_spatial(scores, pts, ["o"], "zone", "wk", 3.0).first().spatial
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    kern = np.clip(1 - d / 3.0, 0, None)
    np.fill_diagonal(kern, 0)
    assert got == pytest.approx(np.einsum("gt,gh,ht->", s, kern, s))


def test_long_terms_sum_to_zero_and_recover_effect():
    months = longrun.months_between(2022, 2025)
    for by in {**longrun.summary_terms(months), **longrun.spec_terms(months)}.values():
        assert sum(by.values()) == pytest.approx(0.0, abs=1e-9)
    step = {m: float(m >= "2025") for m in months}
    slope = {m: 0.01 * i for i, m in enumerate(months)}
    terms = longrun.summary_terms(months)

    def value(term, series):
        return sum(a * series[m] for m, a in terms[term].items())

    assert value("effect_2025_vs_2024", step) == pytest.approx(1.0)
    assert value("effect_trend_adj", step) == pytest.approx(1.0)
    assert value("placebo_2024_vs_2023", step) == pytest.approx(0.0)
    assert value("placebo_2024_vs_2023", slope) == pytest.approx(0.12)


def test_simplex_weights_satisfy_optimality():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8))
    y = 0.6 * x[:, 0] + 0.4 * x[:, 3] + 0.01 * rng.normal(size=40)
    w = scm.simplex_weights(x, y)
    assert w.sum() == pytest.approx(1.0) and (w >= 0).all()
    grad = x.T @ (x @ w - y)
    assert grad[w > 1e-6].max() - grad.min() < 1e-5
    assert w[0] == pytest.approx(0.6, abs=0.02) and w[3] == pytest.approx(0.4, abs=0.02)


def test_synthetic_control_on_exact_mix(spark):
    rng = np.random.default_rng(5)
    donors = rng.uniform(5, 10, (4, 12))
    rows = [(10 + j, t, 0, int(t >= 8), float(donors[j, t])) for j in range(4) for t in range(12)]
    base = donors[:, :8].mean(axis=1)
    mix = 0.7 * donors[0] / base[0] + 0.3 * donors[1] / base[1]
    rows += [(1, t, 1, int(t >= 8), float(mix[t] * (1.2 if t >= 8 else 1.0))) for t in range(12)]
    panel = spark.createDataFrame(rows, "zone long, wk int, treat int, post int, n double")
    series = scm.index_series(panel)
    w = scm.weights_for(series, series.where("u = -1"), "wk", False)
    out = scm.fit_summary(scm.synthetic_series(series, w, "wk", False)).first()
    assert out.rmspe_pre < 1e-4 and out.avg_pct_effect_post == pytest.approx(20.0, abs=0.1)


def test_ridge_choice_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3))
    y = x @ [1.0, -0.5, 0.0] + 2.0 + 0.5 * rng.normal(size=40)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    fit = regression.ridge_loo(df, "y", ["a", "b", "c"])

    def beta(alpha, rows):
        xc, yc = x[rows] - x[rows].mean(0), y[rows] - y[rows].mean()
        b = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        return b, y[rows].mean() - x[rows].mean(0) @ b

    def loo_centred(alpha):
        xc, yc = x - x.mean(0), y - y.mean()
        h = xc @ np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T) + 1 / 40
        return np.mean(((yc - (h - 1 / 40) @ yc) / (1 - np.diag(h))) ** 2)

    best = min(regression.ALPHAS, key=loo_centred)
    assert fit.alpha == pytest.approx(best)
    b, c = beta(best, np.arange(40))
    assert fit.b == pytest.approx(b) and fit.intercept == pytest.approx(c)


def test_wls_matches_matrices(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(size=(30, 2)), rng.uniform(0.5, 2, 30)
    y = x @ [0.5, 1.0] + rng.normal(size=30)
    df = spark.createDataFrame([(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, w, strict=True)], "a double, b double, y double, w double")
    got = {r.term: r for r in regression.wls_hc1(df, "y", ["a", "b"], "w").collect()}
    z = np.column_stack([np.ones(30), x])
    inv = np.linalg.inv(z.T @ (z * w[:, None]))
    b = inv @ z.T @ (w * y)
    e = y - z @ b
    v = 30 / 27 * inv @ (z.T * (w * e) ** 2) @ z @ inv
    assert [got[n].coef for n in ("const", "a", "b")] == pytest.approx(list(b))
    assert [got[n].se for n in ("const", "a", "b")] == pytest.approx(list(np.sqrt(np.diag(v))))


def test_tails_known_values():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.2281389, abs=1e-6)
    assert tails.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_sf(20.0, 10) == pytest.approx(0.0292527, abs=1e-6)
    assert tails.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-6)
