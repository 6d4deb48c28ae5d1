"""Small dense linear algebra, normal quantiles and keyed random streams."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Two-tailed normal quantiles by significance level, as reported to six digits.
Z_TABLE = {0.001: 3.290527, 0.005: 2.807034, 0.01: 2.575829, 0.02: 2.326348, 0.05: 1.959964, 0.10: 1.644854, 0.20: 1.281552}


def validate_alpha(alpha: float) -> float:
    if not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha must be a number in (0, 1), got: {alpha}")
    return alpha


def z_score(alpha: float) -> float:
    """z with P(-z < Z < z) = 1 - alpha: from the table, else by Newton steps on the normal distribution function."""
    validate_alpha(alpha)
    if alpha in Z_TABLE:
        return Z_TABLE[alpha]
    from statistics import NormalDist

    return NormalDist().inv_cdf(1.0 - alpha / 2.0)


def is_missing(y) -> bool:
    """None and NaN are missing."""
    return y is None or y != y


def as_series(y) -> np.ndarray:
    """Observations as doubles, missing ones as NaN."""
    return np.array([np.nan if is_missing(v) else float(v) for v in y], np.float64)


def block_diag(blocks) -> np.ndarray:
    mats = [np.atleast_2d(np.asarray(b, np.float64)) for b in blocks]
    if not mats:
        raise ValueError("block_diag needs at least one block")
    if any(m.ndim != 2 or m.shape[0] != m.shape[1] for m in mats):
        raise ValueError("blocks must be square")
    out = np.zeros((sum(len(m) for m in mats),) * 2)
    at = 0
    for m in mats:
        out[at : at + len(m), at : at + len(m)] = m
        at += len(m)
    return out


def safe_cholesky(m: np.ndarray) -> np.ndarray:
    """Cholesky factor; a growing share of the mean diagonal is added until it exists."""
    m = np.asarray(m, np.float64)
    level = max(float(np.mean(np.diag(m))), 1e-300)
    for jitter in (0.0, 1e-6, 1e-5, 1e-4, 1e-3):
        try:
            return np.linalg.cholesky(m + jitter * level * np.eye(len(m)))
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("matrix is not positive definite, even with jitter")


def safe_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solution of a x = b: exact, with jitter on the diagonal, by pseudo-inverse, or zeros."""
    a, b = np.atleast_2d(np.asarray(a, np.float64)), np.asarray(b, np.float64)
    for jitter in (0.0, 1e-8, 1e-7, 1e-6, 1e-5, 1e-4, 1e-3):
        try:
            x = np.linalg.solve(a + jitter * np.eye(len(a)), b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return x
    x = np.linalg.pinv(a) @ b if np.isfinite(a).all() else np.zeros_like(b)
    return x if np.isfinite(x).all() else np.zeros_like(b)


def psd_factor(m: np.ndarray) -> np.ndarray:
    """A factor of the nearest positive semidefinite matrix, for draws; zeros where it has none."""
    if not np.isfinite(m).all():
        return np.zeros_like(m)
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return vectors * np.sqrt(np.maximum(values, 1e-9))


def percentile_interval(ordered, alpha: float) -> tuple[float, float]:
    """Bounds from order statistics, rounded outward."""
    n = len(ordered)
    return ordered[math.floor(alpha / 2 * (n - 1))], ordered[math.ceil((1 - alpha / 2) * (n - 1))]


def stream(seed: int, *key) -> np.random.Generator:
    """A random stream that follows from the seed and key alone, wherever and however often it is made."""
    digest = hashlib.blake2b(repr((int(seed), *map(str, key))).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(digest, np.uint64)))


def inv_gamma(rng: np.random.Generator, shape, scale, cap: float | None = None):
    """Inverse-gamma draws: scale / Gamma(shape, 1)."""
    if np.any(np.asarray(shape) <= 0) or np.any(np.asarray(scale) <= 0):
        raise ValueError("shape and scale must be positive")
    x = scale / np.maximum(rng.gamma(shape), 1e-300)
    return x if cap is None else np.minimum(x, cap)


def mv_normal(rng: np.random.Generator, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    return np.asarray(mean) + safe_cholesky(cov) @ rng.standard_normal(len(mean))
