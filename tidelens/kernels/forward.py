"""Forward simulation and forecast moments."""

from __future__ import annotations

import numpy as np

from tidelens.kernels.spec import ModelSpec


def scalar_paths(x, q, r, steps: int, rng: np.random.Generator, gap: int = 0) -> np.ndarray:
    """Random-walk observations, a path for each of the draws x, q, r."""
    x, q, r = (np.atleast_1d(np.asarray(v, np.float64)) for v in (x, q, r))
    walk = np.cumsum(rng.standard_normal((len(x), gap + steps)) * np.sqrt(np.maximum(q, 0))[:, None], axis=1)[:, gap:]
    return x[:, None] + walk + rng.standard_normal((len(x), steps)) * np.sqrt(np.maximum(r, 0))[:, None]


def structured_paths(x: np.ndarray, f: np.ndarray, rows: np.ndarray, q_diag: np.ndarray, r: np.ndarray, rng: np.random.Generator, gap: int = 0) -> np.ndarray:
    """Observations of a structural model, a path for each draw: x (draws, n), q_diag (draws, n), r (draws)."""
    state, scale = np.array(x, np.float64), np.sqrt(np.maximum(q_diag, 0))
    out = np.empty((len(state), len(rows)))
    for t in range(gap + len(rows)):
        state = state @ f.T + rng.standard_normal(state.shape) * scale
        if t >= gap:
            out[:, t - gap] = state @ rows[t - gap] + rng.standard_normal(len(state)) * np.sqrt(np.maximum(r, 0))
    return out


def scalar_moments(x, q, r, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation over draws: within-draw variance k q + r, plus the sample variance of the means."""
    x, q, r = (np.asarray(v, np.float64) for v in (x, q, r))
    k = np.arange(1, steps + 1)
    between = np.var(x, ddof=1) if len(x) > 1 else 0.0
    return np.full(steps, x.mean()), np.sqrt(np.maximum(between + k * q.mean() + r.mean(), 0))


def draw_moments(x, p, f, rows, q_diag, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and state variance of the observations of each step, for each draw; p: (draws, n, n) or None for zero."""
    x = np.array(x, np.float64)
    cov = np.zeros((len(x), x.shape[1], x.shape[1])) if p is None else np.array(p, np.float64)
    mean, var = np.empty((len(x), len(rows))), np.empty((len(x), len(rows)))
    at = np.arange(x.shape[1])
    for t in range(gap + len(rows)):
        x = x @ f.T
        cov = f @ cov @ f.T
        cov[:, at, at] += q_diag
        if t >= gap:
            h = rows[t - gap]
            mean[:, t - gap], var[:, t - gap] = x @ h, np.maximum(np.einsum("i,dij,j->d", h, cov, h), 0)
    return mean, var


def structured_moments(x, f, rows, q_diag, r, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    mean, var = draw_moments(x, None, f, rows, q_diag, gap)
    between = np.var(mean, axis=0, ddof=1) if len(mean) > 1 else 0.0
    return mean.mean(axis=0), np.sqrt(np.maximum(between + (var + np.asarray(r)[:, None]).mean(axis=0), 0))


def baseline_moments(x, p, f, rows, q_diag, r) -> dict:
    """Law of total variance, with the population variance between the draws and each draw's terminal covariance."""
    mean, var = draw_moments(x, p, f, rows, q_diag)
    return {"mean": mean.mean(axis=0), "variance": var.mean(axis=0) + mean.var(axis=0), "obs_variance": float(np.mean(r))}


def forecast(x, p, spec: ModelSpec, q: np.ndarray, rows: np.ndarray, r: float, gap: int = 0) -> dict[str, np.ndarray]:
    """Exact Gaussian forecast with known variances: mean, variance of each step, and variance of the running sums.

    The state's covariance with the sum of the observations so far is carried along, so the sums cost one pass.
    """
    x, p, f = np.array(x, np.float64), np.array(p, np.float64), spec.f
    n = len(rows)
    mean, var, cumulative = np.empty(n), np.empty(n), np.empty(n)
    with_sum, total = np.zeros(len(x)), 0.0
    for t in range(gap + n):
        x, p = f @ x, f @ p @ f.T + q
        with_sum = f @ with_sum
        if t >= gap:
            h = rows[t - gap]
            own = max(float(h @ p @ h), 0.0)
            total += own + 2 * float(h @ with_sum)
            with_sum = with_sum + p @ h
            mean[t - gap], var[t - gap] = h @ x, own + r
            cumulative[t - gap] = max(total, 0.0) + (t - gap + 1) * r
    return {"mean": mean, "variance": var, "cumulative_variance": cumulative}
