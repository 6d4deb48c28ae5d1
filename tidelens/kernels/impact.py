"""Causal impact of an intervention on one series: posterior draws, smoothed baselines, and fixed-variance forecasts.

Periods are 1-based and inclusive; indices of filter baselines are 0-based.
"""

from __future__ import annotations

import math

import numpy as np

from tidelens.kernels import forward, gibbs, kalman
from tidelens.kernels.linalg import as_series, stream, validate_alpha, z_score
from tidelens.kernels.spec import ModelSpec, fixed_q

NEAR_ZERO = 1e-10


def validate_periods(n: int, pre: tuple[int, int], post: tuple[int, int]) -> None:
    a, b, c, d = *pre, *post
    if not 1 <= a <= b < c <= d <= n:
        raise ValueError(f"periods must satisfy 1 <= {a} <= {b} < {c} <= {d} <= {n}")


def relative(effect: float, base: float) -> float:
    return effect / base if abs(base) > NEAR_ZERO else 0.0


def estimate(y, pre, post, spec: ModelSpec | None = None, samples=200, burn_in=None, thin=1, seed=0, key=(), initial=None) -> dict:
    """Draws of the effect: a chain on the pre-period, then each draw's path through the gap and the post-period."""
    y = as_series(y)
    validate_periods(len(y), pre, post)
    burn_in = samples // 2 if burn_in is None else burn_in
    (a, b), (c, d) = pre, post
    gap, steps = c - b - 1, d - c + 1
    before, actual = y[a - 1 : b], y[c - 1 : d]
    if spec is None:
        seen = before[~np.isnan(before)]
        x0 = float(seen[0]) if initial is None and len(seen) else float(initial or 0.0)
        draws = gibbs.sample_scalar(before, samples, stream(seed, *key, "chain"), x0=x0, burn_in=burn_in, thin=thin)
        paths = forward.scalar_paths(draws.x[:, 0], draws.q[:, 0], draws.r, steps, stream(seed, *key, "paths"), gap)
    else:
        whole = spec.rows(0, len(y)) if spec.varying else None
        own = spec if whole is None else _with_rows(spec, whole[a - 1 : b])
        draws = gibbs.sample_structured(before, own, samples, stream(seed, *key, "chain"), burn_in, thin)
        rows = whole[c - 1 : d] if whole is not None else spec.rows(0, steps)
        paths = forward.structured_paths(draws.x, spec.f, rows, draws.q, draws.r, stream(seed, *key, "paths"), gap)
    return {"actual": actual, "counterfactual": paths, "effect": actual - paths, "draws": draws}


def _with_rows(spec: ModelSpec, rows: np.ndarray) -> ModelSpec:
    from dataclasses import replace

    return replace(spec, h=rows)


def summarize(effect: np.ndarray, counterfactual: np.ndarray, alpha: float = 0.05) -> dict:
    """Mean, standard deviation and linearly interpolated bounds of point, cumulative and relative effects."""
    validate_alpha(alpha)

    def stats(x: np.ndarray) -> dict:
        if x.shape[0] < 2:
            nan = np.full(x.shape[1:], np.nan)
            return {"mean": x.mean(axis=0), "sd": nan, "lower": nan, "upper": nan}
        lo, hi = np.quantile(x, [alpha / 2, 1 - alpha / 2], axis=0)
        return {"mean": x.mean(axis=0), "sd": x.std(axis=0, ddof=1), "lower": lo, "upper": hi}

    total = np.nansum(effect, axis=1)
    base = counterfactual.sum(axis=1)
    rel = np.where(np.abs(base) > NEAR_ZERO, total / np.where(np.abs(base) > NEAR_ZERO, base, 1.0), 0.0)
    return {"point": stats(effect), "cumulative": stats(total), "relative": stats(rel)}


def _normal_summary(actual, baseline, point_sd, cumulative_sd, alpha) -> dict:
    z = z_score(alpha)
    effect = actual - baseline
    total, base = float(np.nansum(effect)), float(np.sum(baseline))
    rel, rel_sd = relative(total, base), relative(cumulative_sd, abs(base))
    return {
        "actual": actual,
        "baseline": baseline,
        "point": {"mean": effect, "sd": point_sd, "lower": effect - z * point_sd, "upper": effect + z * point_sd},
        "cumulative": {"mean": total, "sd": cumulative_sd, "lower": total - z * cumulative_sd, "upper": total + z * cumulative_sd},
        "relative": {"mean": rel, "sd": rel_sd, "lower": rel - z * rel_sd, "upper": rel + z * rel_sd},
    }


def smoothed_impact(y, indices, spec: ModelSpec, alpha: float = 0.05) -> dict:
    """Effect at some steps against the baseline that is smoothed from all other steps, variances known.

    The variance of the sum holds the covariances of the smoothed states: the covariance of each step's state with the sum
    of the earlier ones is carried forward by the smoother's gains, one pass instead of all pairs.
    """
    y = as_series(y)
    at = np.unique(np.asarray(indices, np.int64))
    if len(at) and (at[0] < 0 or at[-1] >= len(y)):
        raise ValueError(f"indices must lie within 0..{len(y) - 1}")
    if not len(at):
        empty = np.zeros(0)
        return _normal_summary(empty, empty, empty, 0.0, alpha)
    rows = spec.rows(0, len(y))
    masked = y.copy()
    masked[at] = np.nan
    q, r = spec.q(), float(spec.obs_var)
    if spec.dim == 1:
        f1, q1 = float(spec.f[0, 0]), float(q[0, 0])
        fit = kalman.filter_scalar(masked, f1, rows[:, 0], q1, r, spec.x0[0], spec.p0[0, 0])
        smooth = kalman.smooth_scalar(fit["x_filt"], fit["p_filt"], f1, q1)
        xs, ps = smooth["x_smooth"][:, None], smooth["p_smooth"][:, None, None]
        pp = f1 * fit["p_filt"] * f1 + q1
        gain = np.where(np.abs(pp) < kalman.TINY, 0.0, fit["p_filt"] * f1 / np.where(pp == 0, 1.0, pp))[:-1, None, None]
    else:
        fit = kalman.filter_matrix(masked, spec.f, rows, q, r, spec.x0, spec.p0)
        smooth = kalman.smooth_matrix(fit["x_filt"], fit["p_filt"], spec.f, q)
        xs, ps, gain = smooth["x_smooth"], smooth["p_smooth"], smooth["gain"]
    baseline = (rows[at] * xs[at]).sum(axis=1)
    own = np.maximum(np.einsum("ti,tij,tj->t", rows[at], ps[at], rows[at]), 0.0)
    inside = np.zeros(len(y), bool)
    inside[at] = True
    # with_sum: covariance of the sum of the earlier inside observations with the state of this step. Smoothed states of
    # neighbouring steps have covariance gain times the later variance, so a sum is carried by solving back from the last.
    cross, with_sum = 0.0, np.zeros(spec.dim)
    for t in range(int(at[-1]), int(at[0]), -1):
        if inside[t]:
            with_sum = with_sum + ps[t] @ rows[t]
        with_sum = gain[t - 1] @ with_sum
        if inside[t - 1]:
            cross += float(rows[t - 1] @ with_sum)
    total_sd = math.sqrt(max(float(own.sum()) + len(at) * r + 2 * cross, 0.0))
    return _normal_summary(y[at], baseline, np.sqrt(own + r), total_sd, alpha) | {"baseline_variance": own, "obs_variance": r}


def prepare(spec: ModelSpec, pre, post, n: int | None = None, source: str = "initial") -> dict:
    """What the fixed-variance lane needs of a model and its periods, frozen for many series."""
    (a, b), (c, d) = pre, post
    validate_periods(n or d, pre, post)
    whole = spec.rows(0, d)
    return {"spec": spec, "q": fixed_q(spec, source), "r": float(spec.obs_var), "pre": pre, "post": post, "pre_rows": whole[a - 1 : b], "post_rows": whole[c - 1 : d], "gap": c - b - 1}


def operational(prepared: dict, y, alpha: float = 0.05, baseline: str = "forecast") -> dict:
    """Filter the pre-period with known variances and forecast the post-period exactly, or smooth through it."""
    y = as_series(y)
    spec, (a, b), (c, d) = prepared["spec"], prepared["pre"], prepared["post"]
    if len(y) < d:
        raise ValueError(f"the series has {len(y)} steps, the post-period ends at {d}")
    if baseline == "smooth":
        return smoothed_impact(y, range(c - 1, d), spec, alpha)
    before = y[a - 1 : b]
    if spec.dim == 1:
        fit = kalman.filter_scalar(before, spec.f[0, 0], prepared["pre_rows"][:, 0], prepared["q"][0, 0], prepared["r"], spec.x0[0], spec.p0[0, 0])
        x, p = fit["x_filt"][-1:], fit["p_filt"][-1:][:, None]
    else:
        fit = kalman.filter_matrix(before, spec.f, prepared["pre_rows"], prepared["q"], prepared["r"], spec.x0, spec.p0)
        x, p = fit["x_filt"][-1], fit["p_filt"][-1]
    got = forward.forecast(x, p, spec, prepared["q"], prepared["post_rows"], prepared["r"], prepared["gap"])
    out = _normal_summary(y[c - 1 : d], got["mean"], np.sqrt(got["variance"]), float(np.sqrt(got["cumulative_variance"][-1])), alpha)
    # variance is total: an attribution that takes it must add no observation variance.
    return out | {"variance": got["variance"], "obs_variance": 0.0}


def effect_of(summary: dict, steps: int) -> dict[str, float]:
    """The eight numbers that applications report; what is not finite is 0."""

    def safe(x) -> float:
        return float(x) if np.isfinite(x) else 0.0

    c, r = summary["cumulative"], summary["relative"]
    mean, sd = safe(c["mean"]), safe(c["sd"])
    return {
        "cumulative": mean,
        "cumulative_sd": sd,
        "cumulative_lower": safe(c["lower"]),
        "cumulative_upper": safe(c["upper"]),
        "per_period": mean / steps if steps else 0.0,
        "per_period_sd": sd / steps if steps else 0.0,
        "relative": safe(r["mean"]),
        "relative_sd": safe(r["sd"]),
    }


def significant(summary: dict) -> bool:
    c = summary["cumulative"]
    return bool(c["lower"] > 0 or c["upper"] < 0)


def known_lift(lift: float, spec: ModelSpec | None, n_pre=100, n_post=20, base=100.0, noise_sd=2.0, samples=200, burn_in=100, seed=42, level=0.95) -> dict:
    """Adds a known effect to noise around a level and checks that the interval of the estimate holds it."""
    rng = stream(seed, "known lift")
    y = base + rng.standard_normal(n_pre + n_post) * noise_sd
    y[n_pre:] += lift / n_post
    got = estimate(y, (1, n_pre), (n_pre + 1, n_pre + n_post), spec, samples, burn_in, seed=seed + 1, initial=base)
    total = got["effect"].sum(axis=1)
    lo, hi = np.quantile(total, [(1 - level) / 2, (1 + level) / 2])
    return {"true": lift, "mean": float(total.mean()), "sd": float(total.std(ddof=1)), "lower": float(lo), "upper": float(hi), "covered": bool(lo <= lift <= hi), "relative_error": abs(float(total.mean()) - lift) / abs(lift) if lift else abs(float(total.mean()))}
