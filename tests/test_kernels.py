"""Closed forms, brute-force versions and simulated truth for the numeric kernels."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelens.kernels import diagnostics, forward, gibbs, impact, kalman, linalg, series, shapley
from tidelens.kernels import spec as ms


def test_scalar_filter_by_hand():
    got = kalman.filter_scalar([1, 2, 3], 1, 1, 1, 1, 0, 1)
    assert np.allclose(got["x_filt"], [0.666667, 1.5, 2.428571], atol=1e-6)
    assert np.allclose(got["p_filt"], [0.666667, 0.625, 0.619048], atol=1e-6)


def test_missing_steps_predict_only():
    got = kalman.filter_scalar([1, np.nan, 3], q=0.1, r=0.5)
    assert got["x_filt"][1] == got["x_pred"][1] and got["p_filt"][1] == got["p_pred"][1]
    assert list(linalg.as_series([None, float("nan"), 100])[:2]) != [0, 0]


def test_matrix_filter_equals_scalar_and_vector_forms():
    y = np.array([1.0, np.nan, 3.0, 2.0])
    a = kalman.filter_scalar(y, 0.9, 2.0, 0.3, 0.7, 0.1, 2.0)
    b = kalman.filter_matrix(y, np.array([[0.9]]), np.array([2.0]), np.array([[0.3]]), 0.7, [0.1], [[2.0]])
    v = kalman.filter_matrix(y[:, None], np.array([[0.9]]), np.array([[2.0]]), np.array([[0.3]]), np.array([[0.7]]), [0.1], [[2.0]])
    assert np.allclose(a["x_filt"], b["x_filt"][:, 0]) and np.allclose(a["p_filt"], b["p_filt"][:, 0, 0])
    assert np.allclose(b["x_filt"], v["x_filt"])


def test_vector_observations_check_shapes():
    eye = np.eye(2)
    y = np.array([[1, 2], [1.1, 1.9]])
    assert kalman.filter_matrix(y, eye, eye, eye, eye, [0, 0], eye)["x_filt"].shape == (2, 2)
    for h in (np.ones(2), np.ones((3, 2))):
        with pytest.raises(ValueError):
            kalman.filter_matrix(y, eye, h, eye, eye, [0, 0], eye)


def joint(spec, y):
    """Mean and covariance of all states given the seen observations, from the joint normal distribution."""
    n, t = spec.dim, len(y)
    mean, cov = np.zeros(n * t), np.zeros((n * t, n * t))
    x, p = spec.x0, spec.p0
    for i in range(t):
        x, p = spec.f @ x, spec.f @ p @ spec.f.T + spec.q()
        mean[i * n : i * n + n] = x
        c = p
        for j in range(i, t):
            cov[j * n : j * n + n, i * n : i * n + n] = c
            cov[i * n : i * n + n, j * n : j * n + n] = c.T
            c = spec.f @ c
    rows = spec.rows(0, t)
    seen = np.flatnonzero(~np.isnan(y))
    h = np.zeros((len(seen), n * t))
    for k, i in enumerate(seen):
        h[k, i * n : i * n + n] = rows[i]
    s = h @ cov @ h.T + spec.obs_var * np.eye(len(seen))
    g = cov @ h.T @ np.linalg.inv(s)
    return mean + g @ (y[seen] - h @ mean), cov - g @ h @ cov


@pytest.mark.parametrize("spec", [ms.local_level(0.5, 0.8, 0.2, 1.5), ms.local_linear_trend(0.5, 0.1, 0.8)])
def test_smoothers_equal_the_joint_distribution(spec):
    y = np.array([1.0, 2.0, np.nan, 4.0, 5.0, np.nan])
    mean, cov = joint(spec, y)
    n, t = spec.dim, len(y)
    if n == 1:
        fit = kalman.filter_scalar(y, 1, 1, spec.q()[0, 0], spec.obs_var, spec.x0[0], spec.p0[0, 0])
        s = kalman.smooth_scalar(fit["x_filt"], fit["p_filt"], 1, spec.q()[0, 0])
        assert np.allclose(s["x_smooth"], mean) and np.allclose(s["p_smooth"], np.diag(cov))
        assert np.allclose(s["lag1"], np.diag(cov, 1))
    else:
        fit = kalman.filter_matrix(y, spec.f, spec.h, spec.q(), spec.obs_var, spec.x0, spec.p0)
        s = kalman.smooth_matrix(fit["x_filt"], fit["p_filt"], spec.f, spec.q())
        assert np.allclose(s["x_smooth"].ravel(), mean, atol=1e-4)
        assert np.allclose(s["p_smooth"][2], cov[2 * n : 3 * n, 2 * n : 3 * n], atol=1e-4)


@pytest.mark.parametrize("spec", [ms.local_level(0.5, 0.8, 0.2, 1.5), ms.local_linear_trend(0.5, 0.1, 0.8)])
def test_smoothed_impact_has_the_joint_variance_of_the_sum(spec):
    y = np.array([1.0, 2.0, 3.0, 4.0, 5.0, 4.0, 3.5])
    at = [2, 3, 5]
    masked = y.copy()
    masked[at] = np.nan
    mean, cov = joint(spec, masked)
    h = np.zeros(len(mean))
    for i in at:
        h[i * spec.dim : i * spec.dim + spec.dim] = spec.h
    got = impact.smoothed_impact(y, at, spec)
    assert np.isclose(got["cumulative"]["mean"], y[at].sum() - h @ mean, atol=1e-4)
    assert np.isclose(got["cumulative"]["sd"] ** 2, h @ cov @ h + len(at) * spec.obs_var, atol=1e-4)


def test_forecast_has_the_joint_variance_of_the_sum():
    spec = ms.local_linear_trend(0.5, 0.1, 0.8)
    y = np.array([1.0, 2.0, 2.5, np.nan, np.nan, np.nan, np.nan])
    mean, cov = joint(spec, y)
    got = impact.operational(impact.prepare(spec, (1, 3), (5, 7)), np.array([1, 2, 2.5, 9, 3, 4, 5]))
    h = np.zeros(len(mean))
    h[[8, 10, 12]] = 1
    assert np.isclose(got["cumulative"]["sd"] ** 2, h @ cov @ h + 3 * 0.8)
    assert np.allclose(got["baseline"], mean[[8, 10, 12]])


def test_backward_draws_have_the_smoothed_moments():
    y = np.array([1.0, 2.0, np.nan, 4.0])
    spec = ms.local_linear_trend(0.5, 0.1, 0.8)
    fit = kalman.filter_matrix(y, spec.f, spec.h, spec.q(), spec.obs_var, spec.x0, spec.p0)
    rng = linalg.stream(1, "draws")
    x = np.array([kalman.simulate_matrix(fit["x_filt"], fit["p_filt"], spec.f, spec.q(), rng).ravel() for _ in range(20000)])
    mean, cov = joint(spec, y)
    assert np.allclose(x.mean(axis=0), mean, atol=0.05) and np.allclose(np.cov(x.T), cov, atol=0.06)


def test_components():
    spec = ms.compose(ms.compose(ms.local_linear_trend(), ms.seasonal(4)), ms.regression(np.arange(6.0).reshape(3, 2)))
    assert spec.f.shape == (7, 7) and spec.h.shape == (3, 7) and [s.dim for s in spec.noise] == [0, 1, 2, 5, 6]
    assert np.array_equal(ms.seasonal_transition(2), [[-1.0]])
    assert np.array_equal(ms.seasonal_transition(4), [[-1, -1, -1], [1, 0, 0], [0, 1, 0]])
    assert ms.regression_width(spec) == 2
    assert ms.future_rows(spec, [[1, 2]], 2, 1).tolist() == [[1, 0, 1, 0, 0, 1, 2]]
    assert ms.build_spec() is None and ms.build_spec(seasonality=4).dim == 5
    for bad in (lambda: ms.compose(ms.regression(np.ones((2, 1)), "spike_and_slab"), ms.regression(np.ones((2, 1)), "spike_and_slab")), lambda: ms.local_level(prior_shape=0), lambda: ms.seasonal(1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        linalg.block_diag([])


def test_weights_make_the_noise_even():
    y, spec = ms.prewhiten(np.array([2.0, 6.0]), ms.local_level(), [4.0, 9.0])
    assert y.tolist() == [1, 2] and np.allclose(spec.h[:, 0], [0.5, 1 / 3])
    with pytest.raises(ValueError):
        ms.normalize_weights([1, 0], 2)


def test_scalar_chain_recovers_variances():
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(0, 0.4**0.5, 160)) + rng.normal(0, 0.9**0.5, 160)
    d = gibbs.sample_scalar(y, 400, linalg.stream(5), burn_in=200)
    assert 0.1 < np.median(d.q) < 1.2 and 0.4 < np.median(d.r) < 1.6
    assert np.array_equal(gibbs.sample_scalar(y, 5, linalg.stream(5)).r, gibbs.sample_scalar(y, 5, linalg.stream(5)).r)


def test_structured_chain_follows_the_series():
    t = np.arange(60)
    y = 50 + 0.5 * t + 5 * np.sin(2 * np.pi * t / 6) + np.random.default_rng(1).normal(0, 0.5, 60)
    spec = ms.compose(ms.local_linear_trend(initial_level=50, initial_cov_level=10), ms.seasonal(6, initial_cov=10))
    d = gibbs.sample_structured(y, spec, 60, linalg.stream(1), burn_in=40)
    assert np.abs((spec.rows(0, 60) * d.mean_states).sum(axis=1) - y).mean() < 1.5


def test_spike_and_slab_finds_the_active_regressors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(72, 24))
    y = x[:, 3] * 2 - x[:, 11] * 1.5 + x[:, 19] + rng.normal(0, 0.5, 72)
    y[5] = np.nan
    d = gibbs.sample_structured(y, ms.regression(x, "spike_and_slab"), 60, linalg.stream(4), burn_in=30)
    share = d.gamma.mean(axis=0)
    assert set(np.argsort(-share)[:3]) == {3, 11, 19} and share[[3, 11, 19]].min() > 0.9
    assert abs(d.beta.mean(axis=0)[3] - 2) < 0.3


def test_search_controls_finds_the_active_controls():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6))
    got = series.search_controls(x[:, 1] * 3 + rng.normal(0, 0.5, 80), x, 200, 100)
    assert got["selected"] == [1]
    assert series.search_controls(np.ones(80), x)["selected"] == []


def test_known_lift_is_covered():
    hits = [impact.known_lift(10.0 * 20, None, samples=120, burn_in=60, seed=s)["covered"] for s in range(6)]
    assert sum(hits) >= 5
    with pytest.raises(ValueError):
        impact.validate_periods(10, (1, 5), (5, 10))


def test_impact_summary_interpolates():
    effect = np.array([[0.0], [100], [200], [300]])
    got = impact.summarize(effect, np.full((4, 1), 100.0))
    assert np.allclose([got["cumulative"]["lower"], got["cumulative"]["upper"]], [7.5, 292.5])
    assert np.allclose([got["relative"]["lower"], got["relative"]["upper"]], [0.075, 2.925])
    assert np.allclose([impact.summarize(effect, np.full((4, 1), 100.0), 0.1)["cumulative"][k] for k in ("lower", "upper")], [15, 285])
    assert np.isnan(impact.summarize(effect[:1], effect[:1])["cumulative"]["sd"])


def test_pre_period_uplift():
    y = [10.0] * 50 + [15.0] * 30
    got = impact.smoothed_impact(y, range(50, 80), ms.local_level(0.01, 1.0, 10.0))
    assert abs(got["cumulative"]["mean"] - 150) < 10 and abs(got["relative"]["mean"] - 0.5) < 0.1
    assert got["cumulative"]["lower"] < 150 < got["cumulative"]["upper"]
    assert impact.smoothed_impact(y, [], ms.local_level())["cumulative"]["mean"] == 0
    with pytest.raises(ValueError):
        impact.smoothed_impact(y, [80], ms.local_level())


def test_shapley_games():
    worth = {frozenset("12"): 90, frozenset("13"): 80, frozenset("23"): 70, frozenset("123"): 120}
    got = shapley.exact_shares(["1", "2", "3"], lambda ids: worth.get(frozenset(ids), 0))
    assert np.allclose([got[k] for k in "123"], [45, 40, 35])
    near = shapley.sampled_shares(["1", "2", "3"], lambda ids: worth.get(frozenset(ids), 0), 4000)
    assert np.allclose([near[k] for k in "123"], [45, 40, 35], atol=3)
    assert shapley.normalized({"a": 0.0, "b": 0.0}, 10) == {"a": 5, "b": 5}
    assert shapley.time_decay({"a": 100.0}, {"a": 5})(["a"]) == 100.0
    assert np.isclose(shapley.rank_decay({"a": 10.0, "b": -10.0, "c": 1.0})(["a", "b", "c"]), 0.49)


def test_overlap_groups():
    assert len(shapley.overlap_groups([("a", 0, 10), ("b", 20, 30), ("c", 40, 50)])) == 3
    assert len(shapley.overlap_groups([("a", 0, 100), ("b", 10, 90), ("c", 20, 80)])) == 1
    assert len(shapley.overlap_groups([("a", 0, 10), ("b", 10, 20)])) == 2


def test_window_lift_by_hand():
    got = shapley.attribute([100, 102, 150, 148, 101], [100, 101, 102, 103, 104], [1.0] * 5, 0.5, [("a", 2, 4)])
    assert got[0][3:5] == (93.0, 3.0)
    with pytest.raises(ValueError):
        shapley.attribute([1.0], [1.0], [1.0], 0, [("a", 0, 2)])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=60), st.floats(0.01, 10), st.floats(0.01, 10))
def test_filter_properties(y, q, r):
    fit = kalman.filter_scalar(y, q=q, r=r)
    s = kalman.smooth_scalar(fit["x_filt"], fit["p_filt"], 1.0, q)
    assert len(fit["x_filt"]) == len(y) and (fit["p_filt"] >= 0).all()
    assert (s["p_smooth"] <= fit["p_filt"] + 1e-9).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.floats(-10, 10), min_size=8, max_size=8), min_size=2, max_size=4))
def test_diagnostic_properties(chains):
    r, ess = diagnostics.r_hat(chains), diagnostics.effective_sample_size(chains)
    assert math.isnan(r) or r >= math.sqrt(7 / 8) - 1e-9
    assert math.isnan(ess) or ess <= 8 * len(chains) + 1e-9


def test_chain_diagnostics():
    rng = np.random.default_rng(0)
    x = rng.normal(size=2000)
    assert diagnostics.ess_single(x) > 1500 and abs(diagnostics.geweke_z(x)) < 3 and diagnostics.split_r_hat(x) < 1.01
    walk = np.cumsum(x)
    assert diagnostics.ess_single(walk) < 100 and diagnostics.split_r_hat(walk) > 1.05
    assert diagnostics.hpd_interval([1, 2, 3, 100], 0.75) == (1.0, 3.0)
    assert math.isnan(diagnostics.ess_single([1, 1, 1, 1])) and math.isnan(diagnostics.r_hat([[1, 2]]))

    def slow(c):
        n, c = len(c), np.asarray(c) - np.mean(c)
        g = lambda k: float(c[: n - k] @ c[k:]) / n if k < n else 0.0
        tau, prev = 0.0, math.inf
        for k in range((n - 2) // 2 + 1):
            pair = g(2 * k) + g(2 * k + 1)
            if pair <= 0:
                break
            prev = min(prev, pair)
            tau += prev
        return min(max(n * g(0) / (2 * tau - g(0)), 1.0), n)

    assert np.isclose(diagnostics.ess_single(walk[:50]), slow(walk[:50]))


def test_quantiles_and_variates():
    assert linalg.z_score(0.05) == 1.959964 and abs(linalg.z_score(0.07) - 1.8119106729525982) < 1e-9
    assert linalg.percentile_interval(list(range(101)), 0.05) == (2, 98)
    x = linalg.inv_gamma(linalg.stream(1), np.full(20000, 3.0), 2.0)
    assert abs(x.mean() - 1.0) < 0.05 and (x > 0).all()
    assert not np.array_equal(linalg.stream(1, "a").random(3), linalg.stream(1, "b").random(3))
    assert np.allclose(linalg.safe_solve(np.zeros((2, 2)), np.zeros(2)), 0)


def test_autoregression_and_moments():
    rng = np.random.default_rng(1)
    y = np.zeros(600)
    for t in range(1, 600):
        y[t] = 1 + 0.6 * y[t - 1] + rng.normal()
    fit = series.fit_ar(y, 1)
    assert abs(fit["coefficients"][1] - 0.6) < 0.1 and abs(fit["innovation_sd"] - 1) < 0.1
    assert series.predict_ar(fit, 5, 50, rng).shape == (50, 5)
    mean, sd = forward.scalar_moments([1.0, 3.0], [1.0, 1.0], [2.0, 2.0], 2)
    assert mean.tolist() == [2, 2] and np.allclose(sd**2, [2 + 1 + 2, 2 + 2 + 2])
    got = forward.baseline_moments(np.array([[1.0], [3.0]]), np.array([[[0.5]], [[0.5]]]), np.eye(1), np.ones((1, 1)), np.array([[1.0], [1.0]]), [2.0, 2.0])
    assert np.allclose(got["variance"], [1.5 + 1.0]) and got["obs_variance"] == 2.0


def test_signals():
    assert np.allclose(series.adstock([1, 0, 0, 0], 0.5), [1, 0.5, 0.25, 0.125])
    assert series.hill([-1.0, 0.0, 1.0], 1.0, 2.0).tolist() == [0, 0, 0.5]
    signal = np.sin(np.arange(500.0))
    c = series.correlated_controls(signal, 2, 0.4, linalg.stream(1))
    assert abs(np.corrcoef(signal, c[0])[0, 1] - 0.4) < 0.1
    assert [len(s["spots"]) for s in series.scenarios().values()] == [20, 45, 36, 60, 108]


def test_detector():
    y = [100 + (-1) ** i for i in range(30)]
    d = series.fit_detector(y, q=0.1, r=2.0)
    s = series.score_series(d, [100.0, None, 200.0])
    assert [x["severity"] for x in s] == ["normal", "normal", "critical"] and s[2]["p_value"] < 1e-6
    assert series.score_of(1.0, 1.0, 0.0, 2.0)["z_score"] == 0.0
    spec = ms.local_level()
    draws = gibbs.sample_structured(np.asarray(y, float), spec, 30, linalg.stream(1))
    assert series.warm_started(spec, draws).x0[0] == draws.x[-1, 0]


def test_closed_shares_equal_all_coalitions():
    rng = np.random.default_rng(3)
    for n in (2, 3, 5, 9):
        for lifts in (rng.normal(0, 50, n), rng.integers(-2, 3, n).astype(float), np.zeros(n)):
            by = {f"p{i}": float(v) for i, v in enumerate(lifts)}
            for decay in (0.7, 0.2, 1.0):
                want = shapley.exact_shares(list(by), shapley.rank_decay(by, decay))
                got = shapley.rank_decay_shares(by, decay)
                assert all(np.isclose(got[k], want[k], atol=1e-9) for k in by)
        run = np.concatenate([[0.0], np.cumsum(rng.normal(0, 5, 40))])
        ends = [sorted(rng.choice(40, 2, replace=False).tolist()) for _ in range(n)]
        spots = [(f"p{i}", a, b) for i, (a, b) in enumerate(ends)]
        of = {s[0]: s for s in spots}
        want = shapley.exact_shares(list(of), lambda ids, of=of, run=run: shapley.union_lift(run, run, [of[i] for i in ids])[0])
        got = shapley.union_shares(spots, run)
        assert all(np.isclose(got[k], want[k], atol=1e-9) for k in of)


def test_a_group_of_a_thousand_windows_is_shared_at_once():
    spots = [(f"s{i:04d}", i, i + 3) for i in range(1000)]
    rng = np.random.default_rng(4)
    y = rng.normal(0, 30, 1003)
    got = shapley.attribute(y, np.zeros(1003), np.ones(1003), 0.5, spots)
    assert {g for *_, g in got} == {0} and np.isclose(sum(r[3] for r in got), y[:1002].sum())
    assert np.isclose(sum(r[4] for r in got), 1.5 * 1002)
