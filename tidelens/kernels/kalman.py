"""Kalman filters, Rauch-Tung-Striebel smoothers and backward simulation. NumPy in and out.

A missing observation (NaN) leaves the prediction as it is. The initial state is at time 0: the first step predicts.
"""

from __future__ import annotations

import numpy as np

from tidelens.kernels.linalg import psd_factor, safe_solve

TINY = 1e-15  # of an innovation's variance: no gain below


def filter_scalar(y, f=1.0, h=1.0, q=1.0, r=1.0, x0=0.0, p0=1.0) -> dict[str, np.ndarray]:
    """A state of one dimension; h is a number or one for each step. x_pred, p_pred, x_filt, p_filt."""
    y = np.asarray(y, np.float64)
    n = len(y)
    hs = np.broadcast_to(np.asarray(h, np.float64).reshape(-1), (n,)) if np.ndim(h) else np.full(n, float(h))
    out = np.empty((4, n))
    x, p = float(x0), float(p0)
    for t, (yt, ht) in enumerate(zip(y.tolist(), hs.tolist(), strict=True)):
        xp, pp = f * x, f * p * f + q
        x, p = xp, pp
        if yt == yt:
            s = ht * pp * ht + r
            k = pp * ht / s if abs(s) >= TINY else 0.0
            x = xp + k * (yt - ht * xp)
            p = (1 - k * ht) * pp * (1 - k * ht) + k * r * k
        out[:, t] = xp, pp, x, p
    return dict(zip(("x_pred", "p_pred", "x_filt", "p_filt"), out, strict=True))


def filter_matrix(y, f, h, q, r, x0, p0) -> dict[str, np.ndarray]:
    """A state of n dimensions. y: a number for each step, or a vector for each; h: (n), (t, n), (m, n) or (t, m, n)."""
    y = np.asarray(y, np.float64)
    vector = y.ndim == 2
    t, n = len(y), len(x0)
    m = y.shape[1] if vector else 1
    h = np.asarray(h, np.float64)
    if h.shape[-1] != n:
        raise ValueError(f"observation rows have {h.shape[-1]} columns, the state has {n}")
    if vector:
        if h.ndim < 2 or h.shape[-2] != m:
            raise ValueError(f"observation matrix must have {m} rows")
        hs = np.broadcast_to(h, (t, m, n))
    else:
        if h.ndim == 2 and h.shape[0] != t:
            raise ValueError(f"there are {h.shape[0]} observation rows for {t} steps")
        hs = np.broadcast_to(h, (t, n))[:, None, :]
    r = np.atleast_2d(np.asarray(r, np.float64)) if np.ndim(r) else np.eye(m) * float(r)
    xs, ps, xps, pps = np.empty((t, n)), np.empty((t, n, n)), np.empty((t, n)), np.empty((t, n, n))
    x, p, eye = np.asarray(x0, np.float64), np.asarray(p0, np.float64), np.eye(n)
    y = y.reshape(t, m)
    for i in range(t):
        x, p = f @ x, f @ p @ f.T + q
        xps[i], pps[i] = x, p
        if not np.isnan(y[i]).any():
            hi = hs[i]
            ph = p @ hi.T
            s = hi @ ph + r
            gain = ph / s[0, 0] if m == 1 and abs(s[0, 0]) >= TINY else safe_solve(s, ph.T).T if m > 1 else np.zeros_like(ph)
            x = x + gain @ (y[i] - hi @ x)
            a = eye - gain @ hi
            p = a @ p @ a.T + gain @ r @ gain.T
            p = (p + p.T) / 2
        xs[i], ps[i] = x, p
    return {"x_pred": xps, "p_pred": pps, "x_filt": xs, "p_filt": ps}


def smooth_scalar(x_filt, p_filt, f=1.0, q=1.0) -> dict[str, np.ndarray]:
    """Smoothed mean, variance, and covariance with the next step (lag1, one shorter)."""
    x, p = np.array(x_filt, np.float64), np.array(p_filt, np.float64)
    n = len(x)
    lag = np.zeros(max(n - 1, 0))
    for t in range(n - 2, -1, -1):
        xp, pp = f * x_filt[t], f * p_filt[t] * f + q
        c = p_filt[t] * f / pp if abs(pp) >= TINY else 0.0
        lag[t] = p[t + 1] * c
        x[t] = x_filt[t] + c * (x[t + 1] - xp)
        p[t] = max(p_filt[t] + c * (p[t + 1] - pp) * c, 0.0)
    return {"x_smooth": x, "p_smooth": p, "lag1": lag}


def gains(p_filt: np.ndarray, f: np.ndarray, q: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    """Smoother gains of all steps but the last; a small ridge keeps singular predictions solvable."""
    if len(p_filt) < 2:
        return np.zeros((0, *f.shape))
    pf = p_filt[:-1]
    pp = f @ pf @ f.T + q + ridge * np.eye(len(f))
    return np.swapaxes(np.linalg.solve(pp, f @ pf), 1, 2)


def smooth_matrix(x_filt, p_filt, f, q) -> dict[str, np.ndarray]:
    x, p = np.array(x_filt, np.float64), np.array(p_filt, np.float64)
    c = gains(p, f, q)
    lag = np.zeros((max(len(x) - 1, 0), *f.shape))
    for t in range(len(x) - 2, -1, -1):
        xp, pp = f @ x_filt[t], f @ p_filt[t] @ f.T + q
        lag[t] = p[t + 1] @ c[t].T
        x[t] = x_filt[t] + c[t] @ (x[t + 1] - xp)
        p[t] = p_filt[t] + c[t] @ (p[t + 1] - pp) @ c[t].T
        p[t] = (p[t] + p[t].T) / 2
    return {"x_smooth": x, "p_smooth": p, "lag1": lag, "gain": c}


def simulate_scalar(x_filt, p_filt, f, q, rng: np.random.Generator | None = None, noise=None) -> np.ndarray:
    """A draw of the states given all observations, straight from the filter; noise replaces the random stream."""
    n = len(x_filt)
    z = (np.asarray(noise, np.float64) if noise is not None else rng.standard_normal(n)).tolist()
    xf, pf = np.asarray(x_filt).tolist(), np.asarray(p_filt).tolist()
    out = [0.0] * n
    if n:
        out[-1] = xf[-1] + max(pf[-1], 0.0) ** 0.5 * z[-1]
    for t in range(n - 2, -1, -1):
        pp = f * pf[t] * f + q
        c = pf[t] * f / pp if abs(pp) >= TINY else 0.0
        out[t] = xf[t] + c * (out[t + 1] - f * xf[t]) + max(pf[t] - c * f * pf[t], 1e-12) ** 0.5 * z[t]
    return np.array(out)


def simulate_matrix(x_filt, p_filt, f, q, rng: np.random.Generator) -> np.ndarray:
    x, p = np.asarray(x_filt), np.asarray(p_filt)
    n = len(x)
    z = rng.standard_normal(x.shape)
    out = np.empty_like(x)
    if not n:
        return out
    c = gains(p, f, q)
    cov = p[:-1] - c @ f @ p[:-1]
    cov = (cov + np.swapaxes(cov, 1, 2)) / 2
    # One eigendecomposition over all steps; negative eigenvalues are rounding.
    values, vectors = np.linalg.eigh(cov) if n > 1 else (np.zeros((0, x.shape[1])), np.zeros((0, *f.shape)))
    jolt = np.einsum("tij,tj->ti", vectors * np.sqrt(np.maximum(values, 1e-12))[:, None, :], z[:-1])
    fx = x[:-1] @ f.T
    out[-1] = x[-1] + psd_factor(p[-1]) @ z[-1]
    for t in range(n - 2, -1, -1):
        out[t] = x[t] + c[t] @ (out[t + 1] - fx[t]) + jolt[t]
    return out
