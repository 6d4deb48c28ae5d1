"""Autoregression, stochastic search over controls, anomaly scores, adstock and synthetic scenarios."""

from __future__ import annotations

import math

import numpy as np

from tidelens.kernels import diagnostics, forward, gibbs, kalman
from tidelens.kernels.linalg import as_series, inv_gamma, safe_solve, stream, z_score
from tidelens.kernels.spec import ModelSpec

# ---- autoregression -----------------------------------------------------------------------------------------------


def fit_ar(y, order: int = 1, ridge: float = 1e-6) -> dict:
    """Ridge regression on the last `order` values; the intercept is penalised too."""
    y = as_series(y)
    if order < 1 or ridge < 0 or len(y) <= order:
        raise ValueError("order must be positive and smaller than the series, ridge not negative")
    x = np.column_stack([np.ones(len(y) - order), *(y[order - k : len(y) - k] for k in range(1, order + 1))])
    target = y[order:]
    coefficients = safe_solve(x.T @ x + ridge * np.eye(order + 1), x.T @ target)
    off = target - x @ coefficients
    sd = float(off.std(ddof=1)) if len(off) > 1 else 0.0
    return {"order": order, "coefficients": coefficients, "innovation_sd": max(sd, 1e-6), "rmse": float(np.sqrt((off**2).mean())), "tail": y[-order:]}


def predict_ar(fit: dict, horizon: int, samples: int, rng: np.random.Generator) -> np.ndarray:
    """Simulated paths, (samples, horizon)."""
    window = np.tile(fit["tail"][::-1], (samples, 1))  # latest first
    out = np.empty((samples, horizon))
    c = fit["coefficients"]
    for t in range(horizon):
        out[:, t] = c[0] + window @ c[1:] + rng.standard_normal(samples) * fit["innovation_sd"]
        window = np.column_stack([out[:, t], window[:, :-1]])
    return out


# ---- control selection --------------------------------------------------------------------------------------------


def standardize(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    c = x - x.mean(axis=0)
    sd = c.std(axis=0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1:])
    return np.where(sd > 1e-12, c / np.where(sd > 1e-12, sd, 1.0), 0.0)


def pearson(x, y) -> float:
    a, b = np.asarray(x, np.float64), np.asarray(y, np.float64)
    a, b = a - a.mean(), b - b.mean()
    scale = math.sqrt(float(a @ a) * float(b @ b))
    return float(a @ b) / scale if scale >= 1e-15 else 0.0


def search_controls(y, x, samples=500, burn_in=500, thin=1, seed=42, spike_sd=0.05, slab_sd=1.0, shape=2.0, scale=1.0, inclusion=None, threshold=0.5, most=None) -> dict:
    """Inclusion probabilities under a continuous spike and slab on standardised data."""
    x = np.asarray(x, np.float64)
    n, p = x.shape
    inclusion = min(0.5, 3.0 / max(p, 1)) if inclusion is None else inclusion
    y = standardize(np.asarray(y, np.float64))
    if not p or y.var(ddof=1) <= 1e-12:
        return {"selected": [], "pip": np.zeros(p), "beta": np.zeros(p), "kept": 0}
    x, rng = standardize(x), stream(seed, "controls")
    square = (x * x).sum(axis=0)
    gamma = np.zeros(p, int)
    gamma[np.argsort(-np.abs(x.T @ y), kind="stable")[: max(round(inclusion * p), 1)]] = 1
    beta, sigma2, rest = np.zeros(p), max(float(y.var(ddof=1)), 1e-6), y.copy()
    pip, mean = np.zeros(p), np.zeros(p)
    odds = math.log(inclusion / (1 - inclusion)) + 0.5 * math.log(spike_sd**2 / slab_sd**2)
    lean = 1 / spike_sd**2 - 1 / slab_sd**2
    for i in range(1, burn_in + samples * thin + 1):
        for j in range(p):
            rest += x[:, j] * beta[j]
            precision = max(square[j] + 1 / (slab_sd if gamma[j] else spike_sd) ** 2, 1e-12)
            beta[j] = float(x[:, j] @ rest) / precision + math.sqrt(max(sigma2 / precision, 1e-12)) * rng.standard_normal()
            rest -= x[:, j] * beta[j]
            logit = min(max(odds + beta[j] ** 2 / (2 * max(sigma2, 1e-12)) * lean, -35.0), 35.0)
            gamma[j] = rng.random() < 1 / (1 + math.exp(-logit))
        tau = np.where(gamma == 1, slab_sd, spike_sd)
        sigma2 = max(float(inv_gamma(rng, shape + (n + p) / 2, scale + (float(rest @ rest) + float((beta**2 / tau**2).sum())) / 2)), 1e-9)
        if i > burn_in and (i - burn_in) % thin == 0:
            pip += gamma / samples
            mean += beta / samples
    order = np.argsort(-pip, kind="stable")
    return {"selected": [int(j) for j in order if pip[j] >= threshold][: p if most is None else most], "pip": pip, "beta": mean, "kept": samples}


# ---- anomalies ----------------------------------------------------------------------------------------------------


def fit_detector(y, method="filter", alpha=0.01, spec: ModelSpec | None = None, q=1.0, r=1.0, p0=1.0, samples=200, burn_in=None, seed=0, key=()) -> dict:
    """Terminal filter state, or posterior draws, of a training series."""
    y = as_series(y)
    seen = y[~np.isnan(y)]
    x0 = float(seen[0]) if len(seen) else 0.0
    base = {"method": method, "z": z_score(alpha), "f": 1.0, "h": 1.0, "q": q, "r": r}
    if method == "filter":
        fit = kalman.filter_scalar(y, 1.0, 1.0, q, r, x0, p0)
        return base | {"x": float(fit["x_filt"][-1]) if len(y) else x0, "p": float(fit["p_filt"][-1]) if len(y) else p0}
    rng = stream(seed, *key, "detector")
    burn_in = samples // 2 if burn_in is None else burn_in
    draws = gibbs.sample_scalar(y, samples, rng, x0=x0, burn_in=burn_in) if spec is None else gibbs.sample_structured(y, spec, samples, rng, burn_in)
    return base | {"draws": draws, "spec": spec}


def step_detector(x, p, y, f=1.0, h=1.0, q=1.0, r=1.0):
    """One online step: predicted value, its deviation, new state. A missing observation predicts only."""
    xp, pp = f * x, f * p * f + q
    var = h * pp * h + r
    sd = math.sqrt(max(var, 1e-10))
    if y is None or y != y:
        return h * xp, sd, xp, pp
    k = pp * h / var if var > kalman.TINY else 0.0
    return h * xp, sd, xp + k * (y - h * xp), max(pp * (1 - h * k), 0.0)


def score_of(y, predicted, sd, z) -> dict:
    missing = y is None or y != y
    score = 0.0 if missing or sd <= 1e-15 else (y - predicted) / sd
    severity = "critical" if abs(score) > 2 * z else "warning" if abs(score) > z else "normal"
    return {"value": y, "predicted": predicted, "predicted_sd": sd, "residual": None if missing else y - predicted, "z_score": score, "p_value": math.erfc(abs(score) / math.sqrt(2)), "anomaly": abs(score) > z, "severity": severity}


def score_series(detector: dict, y, rows: np.ndarray | None = None) -> list[dict]:
    y = [None if v is None or v != v else float(v) for v in y]
    if detector["method"] == "filter":
        out, (x, p) = [], (detector["x"], detector["p"])
        for v in y:
            m, sd, x, p = step_detector(x, p, v, detector["f"], detector["h"], detector["q"], detector["r"])
            out.append(score_of(v, m, sd, detector["z"]))
        return out
    d, spec = detector["draws"], detector["spec"]
    if spec is None:
        mean, sd = forward.scalar_moments(d.x[:, 0], d.q[:, 0], d.r, len(y))
    else:
        mean, sd = forward.structured_moments(d.x, spec.f, rows if rows is not None else spec.rows(0, len(y)), d.q, d.r)
    return [score_of(v, float(m), float(s), detector["z"]) for v, m, s in zip(y, mean, sd, strict=True)]


def convergence(draws: gibbs.Draws, spec: ModelSpec) -> dict:
    """Split R-hat and effective size of the observation variance and each noise dimension; good below 1.1 and above 100."""
    chains = {"obs_var": draws.r} | {f"q{s.dim}": draws.q[:, s.dim] for s in spec.noise}
    each = {k: (diagnostics.split_r_hat(c), diagnostics.ess_single(c)) for k, c in chains.items()}
    return {"each": each, "converged": all(r < 1.1 and e > 100 for r, e in each.values())}


def warm_started(spec: ModelSpec, previous: gibbs.Draws) -> ModelSpec:
    """The model with a former fit's mean variances, terminal state and covariance, as far as they fit."""
    from dataclasses import replace

    noise = tuple(replace(s, initial=float(previous.q[:, s.dim].mean())) for s in spec.noise) if previous.q.shape[1] == spec.dim else spec.noise
    out = replace(spec, noise=noise, obs_var=float(previous.r.mean()))
    return replace(out, x0=previous.x[-1], p0=previous.p[-1]) if previous.x.shape[1] == spec.dim else out


# ---- synthetic series ---------------------------------------------------------------------------------------------


def adstock(x, decay: float) -> np.ndarray:
    """Each value plus the decayed sum of those before it."""
    out, run = np.empty(len(x)), 0.0
    for i, v in enumerate(np.asarray(x, np.float64).tolist()):
        run = v + decay * run
        out[i] = run
    return out


def hill(x, half: float, slope: float) -> np.ndarray:
    if half <= 0 or slope <= 0:
        raise ValueError("half and slope must be positive")
    x = np.asarray(x, np.float64)
    up = np.power(np.maximum(x, 0), slope)
    return np.where(x <= 0, 0.0, up / (up + half**slope))


def effect_signal(impulse, effect: dict) -> np.ndarray:
    return hill(adstock(impulse, effect["lambda"]), effect["ec"], effect["slope"]) * effect["coefficient"]


def fourier_baseline(t, config: dict) -> np.ndarray:
    t = np.asarray(t, np.float64)
    out = config["intercept"] + config["trend"] * t / 1440.0
    for waves, period in ((config["daily"], 1440.0), (config["weekly"], 10080.0)):
        for k, (a, b) in enumerate(waves, 1):
            angle = 2 * np.pi * k * t / period
            out = out + a * np.sin(angle) + b * np.cos(angle)
    return out


def correlated_controls(signal, count: int, correlation: float, rng: np.random.Generator) -> np.ndarray:
    """Series of the given correlation with a signal, with its mean and spread (population)."""
    if count < 0 or not -1 <= correlation <= 1:
        raise ValueError("count must not be negative, correlation within -1..1")
    s = np.asarray(signal, np.float64)
    mean, sd = s.mean(), s.std()
    if sd <= 1e-10 and abs(correlation) > 1e-10:
        raise ValueError("a constant signal has no correlation")
    z = (s - mean) / sd if sd > 1e-10 else np.zeros(len(s))
    noise = rng.standard_normal((count, len(s)))
    noise = (noise - noise.mean(axis=1, keepdims=True)) / np.maximum(noise.std(axis=1, keepdims=True), 1e-300)
    return (correlation * z + math.sqrt(max(1 - correlation**2, 0)) * noise) * (sd if sd > 1e-10 else 1.0) + mean


def _spots(prefix: str, days, hours, minutes: int = 30) -> list[dict]:
    return [{"id": f"{prefix}_day{d}_h{h}", "start": d * 1440 + h * 60, "end": d * 1440 + h * 60 + minutes} for d in days for h in hours]


def scenarios() -> dict[str, dict]:
    """Five synthetic settings, a to e."""

    def one(name, days, intercept, trend, daily, weekly, noise_sd, effect, controls, seed, spots):
        return {
            "name": name,
            "total": days * 1440,
            "baseline": {"intercept": intercept, "trend": trend, "daily": daily, "weekly": weekly},
            "noise_sd": noise_sd,
            "effect": dict(zip(("lambda", "ec", "slope", "coefficient"), effect, strict=True)),
            "controls": dict(zip(("count", "correlation"), controls, strict=True)),
            "seed": seed,
            "spots": spots,
        }

    # The published settings of the five scenarios.
    return {
        "a": one("Single Campaign", 14, 50.0, 0.5, [(10.0, 5.0), (3.0, 2.0)], [(4.0, 3.0)], 3.0, (0.5, 1.0, 2.0, 15.0), (3, 0.3), 42, _spots("a", range(5, 10), [8, 12, 18, 22])),
        "b": one("Overlapping Campaigns", 21, 60.0, 0.3, [(12.0, 6.0), (4.0, 2.0)], [(5.0, 3.0)], 4.0, (0.6, 1.0, 2.0, 12.0), (3, 0.4), 123, _spots("b1", range(5, 12), [9, 12, 20]) + _spots("b2", range(8, 16), [12, 16, 20])),
        "c": one("Varying Effect Sizes", 21, 45.0, 0.2, [(8.0, 4.0), (2.0, 1.0)], [(3.0, 2.0)], 2.5, (0.4, 1.0, 2.0, 10.0), (4, 0.2), 456, _spots("c_strong", range(3, 7), [8, 10, 13, 16, 20]) + _spots("c_medium", range(10, 14), [9, 13, 18]) + _spots("c_weak", range(17, 21), [13])),
        "d": one("Confounded", 28, 55.0, 0.1, [(15.0, 8.0), (5.0, 3.0), (2.0, 1.0)], [(8.0, 5.0), (3.0, 2.0)], 5.0, (0.5, 1.0, 2.0, 8.0), (5, 0.5), 789, _spots("d", [d for d in range(28) if d % 7 not in (5, 6)], [19, 20, 21])),
        "e": one("Diminishing Returns", 14, 40.0, 0.3, [(8.0, 4.0)], [(3.0, 2.0)], 3.5, (0.7, 0.3, 4.0, 20.0), (2, 0.3), 999, _spots("e", range(3, 12), range(0, 24, 2))),
    }
