"""Convergence diagnostics of chains. Undefined values are NaN."""

from __future__ import annotations

import math

import numpy as np

from tidelens.kernels.linalg import z_score


def _between_within(chains) -> tuple[int, int, float, float] | None:
    """Chains, their common length, within-chain variance and the pooled estimate; longer chains are cut."""
    n = min((len(c) for c in chains), default=0)
    m = len(chains)
    if m < 2 or n < 2:
        return None
    x = np.array([c[:n] for c in chains], np.float64)
    within = float(x.var(axis=1, ddof=1).mean())
    between = n * float(x.mean(axis=1).var(ddof=1))
    return m, n, within, (n - 1) / n * within + between / n


def r_hat(chains) -> float:
    s = _between_within(chains)
    return math.nan if s is None or s[2] == 0 else math.sqrt(s[3] / s[2])


def effective_sample_size(chains) -> float:
    s = _between_within(chains)
    return math.nan if s is None or s[3] == 0 else min(s[0] * s[1] * s[2] / s[3], float(s[0] * s[1]))


def split_r_hat(chain) -> float:
    half = len(chain) // 2
    return math.nan if len(chain) < 4 else r_hat([chain[:half], chain[len(chain) - half :]])


def _autocovariance(x: np.ndarray) -> np.ndarray:
    """Autocovariances at all lags, by FFT."""
    x = np.asarray(x, np.float64) - np.mean(x)
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    power = np.abs(np.fft.rfft(x, size)) ** 2
    return np.fft.irfft(power, size)[:n] / n


def ess_single(chain) -> float:
    """Sums of neighbouring autocovariances, made monotone, up to the first that is not positive."""
    n = len(chain)
    if n < 4 or np.ptp(np.asarray(chain, np.float64)) == 0:
        return math.nan
    a = _autocovariance(chain)
    pairs = a[0 : 2 * ((n - 2) // 2 + 1) : 2] + a[1 : 2 * ((n - 2) // 2 + 1) : 2]
    stop = np.flatnonzero(pairs <= 0)
    pairs = np.minimum.accumulate(pairs[: stop[0] if len(stop) else len(pairs)])
    spread = 2 * float(pairs.sum()) - a[0]
    return 1.0 if spread <= 1e-15 else float(min(max(n * a[0] / spread, 1.0), n))


def _spectrum_at_zero(x: np.ndarray, lags: int | None) -> float:
    n = len(x)
    lags = min(max(int(math.sqrt(n)), 1) if lags is None else lags, n - 1)
    a = _autocovariance(x)
    k = np.arange(1, lags + 1)
    return max(float(a[0] + 2 * ((1 - k / (lags + 1)) * a[1 : lags + 1]).sum()), 0.0) if a[0] > 0 else 0.0


def geweke_z(chain, first=0.1, last=0.5, max_lag: int | None = None) -> float:
    """Difference of the means of a chain's beginning and end, in standard errors."""
    if not 0 < first < 1 or not 0 < last < 1 or first + last >= 1:
        raise ValueError("first and last must be in (0, 1) and sum to less than 1")
    x = np.asarray(chain, np.float64)
    n = len(x)
    if n < 20:
        return math.nan
    a, b = x[: max(int(n * first), 2)], x[n - max(int(n * last), 2) :]
    sa, sb = _spectrum_at_zero(a, max_lag), _spectrum_at_zero(b, max_lag)
    scale = math.sqrt(sa / len(a) + sb / len(b))
    return math.nan if sa <= 0 or sb <= 0 or scale <= 1e-15 else float((a.mean() - b.mean()) / scale)


def geweke_pass(chain, alpha=0.05, **options) -> bool | None:
    z = geweke_z(chain, **options)
    return None if math.isnan(z) else abs(z) <= z_score(alpha)


def hpd_interval(sample, level=0.95) -> tuple[float, float]:
    """The shortest interval that holds the level's share of the points; the lowest of equal ones."""
    if not 0 < level < 1:
        raise ValueError("level must be in (0, 1)")
    x = np.sort(np.asarray(sample, np.float64))
    if not len(x):
        return math.nan, math.nan
    k = min(max(math.ceil(level * len(x)), 1), len(x))
    i = int(np.argmin(x[k - 1 :] - x[: len(x) - k + 1]))
    return float(x[i]), float(x[i + k - 1])
