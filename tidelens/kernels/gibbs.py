"""Gibbs samplers. A chain is one call; what it keeps of a draw is bounded: parameters, terminal state and covariance.

Full state paths are kept only on request: draws x steps x dimensions would not fit for long seasonal models.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidelens.kernels import kalman
from tidelens.kernels.linalg import inv_gamma, safe_cholesky, safe_solve
from tidelens.kernels.spec import ModelSpec

MAX_ITERATIONS = 1_000_000
CAP = 1e12  # of sampled variances


@dataclass
class Draws:
    """Kept draws: q (draws, n), r (draws), terminal state x (draws, n) and filtered covariance p (draws, n, n)."""

    q: np.ndarray
    r: np.ndarray
    x: np.ndarray
    p: np.ndarray
    states: np.ndarray | None = None  # (draws, steps, n)
    mean_states: np.ndarray | None = None  # (steps, n)
    beta: np.ndarray | None = None
    gamma: np.ndarray | None = None


def _schedule(samples: int, burn_in: int, thin: int) -> int:
    if samples < 1 or burn_in < 0 or thin < 1:
        raise ValueError("samples and thin must be positive, burn_in not negative")
    total = burn_in + samples * thin
    if total > MAX_ITERATIONS:
        raise ValueError(f"{total} iterations are more than {MAX_ITERATIONS}")
    return total


def sample_scalar(y, samples, rng, f=1.0, h=1.0, q=1.0, r=1.0, x0=0.0, p0=1.0, burn_in=0, thin=1, prior_shape=1.0, prior_scale=1.0, keep_states=False) -> Draws:
    """Filter, draw the states backwards, then both variances from their conjugate inverse-gamma distributions."""
    y = np.asarray(y, np.float64)
    seen = ~np.isnan(y)
    n = len(y)
    total = _schedule(samples, burn_in, thin)
    hs = np.broadcast_to(np.asarray(h, np.float64), (n,))
    out = Draws(np.empty((samples, 1)), np.empty(samples), np.empty((samples, 1)), np.empty((samples, 1, 1)), np.empty((samples, n, 1)) if keep_states else None, np.zeros((n, 1)))
    k = 0
    for i in range(1, total + 1):
        fit = kalman.filter_scalar(y, f, h, q, r, x0, p0)
        x = kalman.simulate_scalar(fit["x_filt"], fit["p_filt"], f, q, rng)
        move = x[1:] - f * x[:-1]
        q = float(inv_gamma(rng, prior_shape + max(n - 1, 0) / 2, prior_scale + float(move @ move) / 2, CAP))
        off = (y - hs * x)[seen]
        r = float(inv_gamma(rng, prior_shape + len(off) / 2, prior_scale + float(off @ off) / 2, CAP))
        if i > burn_in and (i - burn_in) % thin == 0:
            out.q[k, 0], out.r[k] = q, r
            if n:
                out.x[k, 0], out.p[k, 0, 0] = x[-1], fit["p_filt"][-1]
            else:
                out.x[k, 0], out.p[k, 0, 0] = x0, p0
            if keep_states:
                out.states[k, :, 0] = x
            out.mean_states[:, 0] += x / samples
            k += 1
    return out


def sample_structured(y, spec: ModelSpec, samples, rng, burn_in=0, thin=1, keep_states=False) -> Draws:
    spec.validate()
    return (_spike_slab if spec.regression else _structured)(np.asarray(y, np.float64), spec, samples, rng, burn_in, thin, keep_states)


def _resample_q(spec_noise, q: np.ndarray, x: np.ndarray, f: np.ndarray, rng) -> np.ndarray:
    q = q.copy()
    move = x[1:] - x[:-1] @ f.T
    for s in spec_noise:
        q[s.dim] = inv_gamma(rng, s.prior_shape + len(move) / 2, s.prior_scale + float(move[:, s.dim] @ move[:, s.dim]) / 2, CAP)
    return q


def _structured(y, spec: ModelSpec, samples, rng, burn_in, thin, keep_states) -> Draws:
    n, t = spec.dim, len(y)
    rows, seen = spec.rows(0, t), ~np.isnan(y)
    q, r = spec.q_diagonal(), float(spec.obs_var)
    out = Draws(np.empty((samples, n)), np.empty(samples), np.empty((samples, n)), np.empty((samples, n, n)), np.empty((samples, t, n)) if keep_states else None, np.zeros((t, n)))
    k = 0
    for i in range(1, _schedule(samples, burn_in, thin) + 1):
        fit = kalman.filter_matrix(y, spec.f, rows, np.diag(q), r, spec.x0, spec.p0)
        x = kalman.simulate_matrix(fit["x_filt"], fit["p_filt"], spec.f, np.diag(q), rng)
        q = _resample_q(spec.noise, q, x, spec.f, rng)
        off = (y - (rows * x).sum(axis=1))[seen]
        r = float(inv_gamma(rng, spec.obs_prior_shape + len(off) / 2, spec.obs_prior_scale + float(off @ off) / 2, CAP))
        if i > burn_in and (i - burn_in) % thin == 0:
            out.q[k], out.r[k], out.x[k], out.p[k] = q, r, x[-1], fit["p_filt"][-1]
            if keep_states:
                out.states[k] = x
            out.mean_states += x / samples
            k += 1
    return out


def log_marginal(xtx: np.ndarray, xty: np.ndarray, active: np.ndarray, sigma2: float, g: float) -> float:
    """Log marginal likelihood of a set of regressors under the g-prior, up to a constant; 0 for none."""
    if not len(active):
        return 0.0
    own = xty[active]
    fit = float(own @ safe_solve(xtx[np.ix_(active, active)], own))
    return -0.5 * len(active) * np.log1p(g) + g * fit / (2 * sigma2 * (1 + g))


def sweep_inclusion(gamma, xtx, xty, sigma2, inclusion, g, rng) -> np.ndarray:
    """Each indicator in turn given the others, by the odds of the marginal likelihoods."""
    gamma = gamma.copy()
    odds = np.log(inclusion / (1 - inclusion))
    sigma2 = max(sigma2, 1e-12)
    now = log_marginal(xtx, xty, np.flatnonzero(gamma), sigma2, g)
    for j, u in enumerate(rng.random(len(gamma))):
        flipped = gamma.copy()
        flipped[j] = 1 - flipped[j]
        other = log_marginal(xtx, xty, np.flatnonzero(flipped), sigma2, g)
        on, off = (now, other) if gamma[j] else (other, now)
        logit = np.clip(odds + on - off, -35.0, 35.0)
        keep = 1 if u < 1 / (1 + np.exp(-logit)) else 0
        if keep != gamma[j]:
            gamma[j], now = keep, other
    return gamma


def first_inclusion(xty: np.ndarray, inclusion: float) -> np.ndarray:
    """The regressors that go along most with the observations, as many as the prior expects."""
    p = len(xty)
    gamma = np.zeros(p, int)
    gamma[np.argsort(-np.abs(xty), kind="stable")[: max(round(inclusion * p), 1)]] = 1
    return gamma


def _spike_slab(y, spec: ModelSpec, samples, rng, burn_in, thin, keep_states) -> Draws:
    reg, t, n = spec.regression, len(y), spec.dim
    rows, seen = spec.rows(0, t), ~np.isnan(y)
    own = np.arange(reg.start, reg.start + reg.size)
    rest = np.setdiff1d(np.arange(n), own)
    x_reg, h = rows[:, own], rows[:, rest]
    place = {int(d): i for i, d in enumerate(rest)}
    noise = [type(s)(place[s.dim], s.initial, s.prior_shape, s.prior_scale) for s in spec.noise if s.dim in place]
    f, x0, p0 = spec.f[np.ix_(rest, rest)], spec.x0[rest], spec.p0[np.ix_(rest, rest)]
    q, r, beta = spec.q_diagonal()[rest], float(spec.obs_var), spec.x0[own].copy()
    xs = x_reg[seen]
    xtx = xs.T @ xs
    gamma = first_inclusion(xs.T @ y[seen], reg.prior_inclusion)
    out = Draws(np.empty((samples, n)), np.empty(samples), np.empty((samples, n)), np.zeros((samples, n, n)), np.empty((samples, t, n)) if keep_states else None, np.zeros((t, n)), np.empty((samples, reg.size)), np.empty((samples, reg.size), int))
    k = 0
    for i in range(1, _schedule(samples, burn_in, thin) + 1):
        if len(rest):
            fit = kalman.filter_matrix(y - x_reg @ beta, f, h, np.diag(q), r, x0, p0)
            x = kalman.simulate_matrix(fit["x_filt"], fit["p_filt"], f, np.diag(q), rng)
            q = _resample_q(noise, q, x, f, rng)
            level, last = (h * x).sum(axis=1), fit["p_filt"][-1]
        else:
            x, level, last = np.zeros((t, 0)), np.zeros(t), np.zeros((0, 0))
        target = (y - level)[seen]
        xty, sigma2 = xs.T @ target, max(r, 1e-12)
        gamma = sweep_inclusion(gamma, xtx, xty, sigma2, reg.prior_inclusion, reg.g, rng)
        active = np.flatnonzero(gamma)
        beta, cov = np.zeros(reg.size), np.zeros((reg.size, reg.size))
        if len(active) and len(target):
            inner = xtx[np.ix_(active, active)]
            shrink = reg.g / (1 + reg.g)
            mean = shrink * safe_solve(inner, xty[active])
            part = shrink * sigma2 * safe_solve(inner, np.eye(len(active)))
            part = (part + part.T) / 2
            draw = mean + safe_cholesky(part + 1e-9 * np.eye(len(active))) @ rng.standard_normal(len(active))
            beta[active] = draw if np.isfinite(draw).all() else mean
            cov[np.ix_(active, active)] = part
        off = target - xs @ beta
        r = float(inv_gamma(rng, spec.obs_prior_shape + len(off) / 2, spec.obs_prior_scale + float(off @ off) / 2, CAP))
        if i > burn_in and (i - burn_in) % thin == 0:
            full = np.zeros((t, n))
            full[:, rest], full[:, own] = x, beta
            out.q[k] = 0.0
            out.q[k, rest], out.r[k], out.x[k] = q, r, full[-1]
            out.p[k][np.ix_(rest, rest)], out.p[k][np.ix_(own, own)] = last, cov
            out.beta[k], out.gamma[k] = beta, gamma
            if keep_states:
                out.states[k] = full
            out.mean_states += full / samples
            k += 1
    return out
