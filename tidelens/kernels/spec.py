"""Structural models: components, their composition and checks. Plain values, built before any job is planned."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from tidelens.kernels.linalg import block_diag


@dataclass(frozen=True)
class Noise:
    """Process variance of one state dimension, with an inverse-gamma prior."""

    dim: int
    initial: float
    prior_shape: float = 1.0
    prior_scale: float = 1.0


@dataclass(frozen=True)
class Regression:
    """Static coefficients under a g-prior with inclusion indicators."""

    start: int
    size: int
    prior_inclusion: float
    g: float


@dataclass(frozen=True)
class ModelSpec:
    """x_t = F x_{t-1} + noise, y_t = H_t x_t + noise. h is a row, or a row for each step."""

    f: np.ndarray
    h: np.ndarray
    x0: np.ndarray
    p0: np.ndarray
    obs_var: float = 1.0
    noise: tuple[Noise, ...] = field(default_factory=tuple)
    obs_prior_shape: float = 1.0
    obs_prior_scale: float = 1.0
    regression: Regression | None = None

    @property
    def dim(self) -> int:
        return len(self.x0)

    @property
    def varying(self) -> bool:
        return self.h.ndim == 2

    def rows(self, start: int, n: int) -> np.ndarray:
        """H for n steps from start."""
        if not self.varying:
            return np.tile(self.h, (n, 1))
        if start + n > len(self.h):
            raise ValueError(f"the model has {len(self.h)} observation rows, {start + n} are needed")
        return self.h[start : start + n]

    def q(self) -> np.ndarray:
        return np.diag(self.q_diagonal())

    def q_diagonal(self) -> np.ndarray:
        d = np.zeros(self.dim)
        for s in self.noise:
            d[s.dim] = s.initial
        return d

    def validate(self) -> ModelSpec:
        n = self.dim
        if self.f.shape != (n, n) or self.p0.shape != (n, n) or self.h.shape[-1] != n:
            raise ValueError("F, P0 and H must fit the state")
        dims = [s.dim for s in self.noise]
        if len(set(dims)) != len(dims):
            raise ValueError(f"noise dimensions must be unique, got: {dims}")
        if any(not 0 <= d < n for d in dims):
            raise ValueError("a noise dimension lies outside the state")
        if min([self.obs_prior_shape, self.obs_prior_scale, *(v for s in self.noise for v in (s.prior_shape, s.prior_scale))]) <= 0:
            raise ValueError("priors must be positive")
        return self


def local_level(process_var=1.0, obs_var=1.0, initial_state=0.0, initial_cov=1.0, prior_shape=1.0, prior_scale=1.0) -> ModelSpec:
    return ModelSpec(
        np.eye(1), np.ones(1), np.array([float(initial_state)]), np.array([[float(initial_cov)]]), obs_var, (Noise(0, process_var, prior_shape, prior_scale),), prior_shape, prior_scale
    ).validate()


def local_linear_trend(var_level=1.0, var_slope=0.1, obs_var=1.0, initial_level=0.0, initial_slope=0.0, initial_cov_level=1.0, initial_cov_slope=1.0, prior_shape=1.0, prior_scale=1.0) -> ModelSpec:
    return ModelSpec(
        np.array([[1.0, 1.0], [0.0, 1.0]]),
        np.array([1.0, 0.0]),
        np.array([initial_level, initial_slope], np.float64),
        np.diag([float(initial_cov_level), float(initial_cov_slope)]),
        obs_var,
        (Noise(0, var_level, prior_shape, prior_scale), Noise(1, var_slope, prior_shape, prior_scale)),
        prior_shape,
        prior_scale,
    ).validate()


def seasonal_transition(seasons: int) -> np.ndarray:
    if seasons < 2:
        raise ValueError("a season has two steps at least")
    f = np.eye(seasons - 1, k=-1)
    f[0] = -1.0
    return f


def seasonal(seasons: int, process_var=0.1, obs_var=1.0, initial_cov=1.0, prior_shape=1.0, prior_scale=1.0) -> ModelSpec:
    n = seasons - 1
    return ModelSpec(
        seasonal_transition(seasons), np.eye(1, n)[0], np.zeros(n), np.eye(n) * initial_cov, obs_var, (Noise(0, process_var, prior_shape, prior_scale),), prior_shape, prior_scale
    ).validate()


def regression(x, mode="dynamic", var_beta=0.01, obs_var=1.0, prior_shape=1.0, prior_scale=1.0, prior_inclusion=None, g=None, initial_betas=None, initial_cov=None) -> ModelSpec:
    """Coefficients that walk at random (dynamic), or static ones with in-loop selection (spike_and_slab)."""
    x = np.asarray(x, np.float64)
    if x.ndim != 2:
        raise ValueError("regressors must be a matrix with a row for each step")
    t, p = x.shape
    betas = np.zeros(p) if initial_betas is None else np.asarray(initial_betas, np.float64)
    if mode == "dynamic":
        cov = np.full(p, 1.0 if initial_cov is None else initial_cov)
        noise = tuple(Noise(d, float(v), prior_shape, prior_scale) for d, v in enumerate(np.broadcast_to(var_beta, p)))
        return ModelSpec(np.eye(p), x, betas, np.diag(cov), obs_var, noise, prior_shape, prior_scale).validate()
    if mode != "spike_and_slab":
        raise ValueError(f"unknown regression mode {mode}")
    inclusion = min(0.5, 3.0 / max(p, 1)) if prior_inclusion is None else prior_inclusion
    g = float(max(t, 1)) if g is None else float(g)
    if not 0 < inclusion < 1 or g <= 0:
        raise ValueError("prior_inclusion must be in (0, 1) and g positive")
    cov = np.full(p, 10.0 if initial_cov is None else initial_cov)
    return ModelSpec(np.eye(p), x, betas, np.diag(cov), obs_var, (), prior_shape, prior_scale, Regression(0, p, inclusion, g)).validate()


def compose(a: ModelSpec, b: ModelSpec) -> ModelSpec:
    """Both models' states side by side; the observation noise and its prior are a's."""
    if a.regression and b.regression:
        raise ValueError("at most one regression block")
    if a.varying and b.varying and len(a.h) != len(b.h):
        raise ValueError("observation rows must be as many")
    n = a.dim
    steps = len(a.h) if a.varying else len(b.h) if b.varying else 0
    h = np.concatenate([a.rows(0, steps), b.rows(0, steps)], axis=1) if steps else np.concatenate([a.h, b.h])
    moved = replace(b.regression, start=b.regression.start + n) if b.regression else a.regression
    return ModelSpec(
        block_diag([a.f, b.f]),
        h,
        np.concatenate([a.x0, b.x0]),
        block_diag([a.p0, b.p0]),
        a.obs_var,
        (*a.noise, *(replace(s, dim=s.dim + n) for s in b.noise)),
        a.obs_prior_shape,
        a.obs_prior_scale,
        moved,
    ).validate()


def build_spec(model_spec: ModelSpec | None = None, seasonality=None, regressors=None, regression_mode="dynamic", **trend) -> ModelSpec | None:
    """The model that options ask for: an explicit one wins; none of them: None, a plain local level."""
    if model_spec is not None:
        return model_spec
    if seasonality is None and regressors is None:
        return None
    spec = local_linear_trend(**trend)
    for s in [] if seasonality is None else [seasonality] if np.isscalar(seasonality) else seasonality:
        spec = compose(spec, seasonal(int(s)))
    return spec if regressors is None else compose(spec, regression(regressors, mode=regression_mode))


def rolling_spec(num_seasons: int = 96, regressors=None, **options) -> ModelSpec:
    """Trend, season and regressors of a rolling baseline."""
    spec = compose(local_linear_trend(**{k: v for k, v in options.items() if not k.startswith("seasonal_")}), seasonal(num_seasons, options.get("seasonal_var", 0.1)))
    return spec if regressors is None else compose(spec, regression(regressors, prior_scale=0.001))


def regression_width(spec: ModelSpec) -> int:
    """Trailing dimensions whose observation row changes over time."""
    if spec.regression:
        return spec.regression.size
    if not spec.varying:
        return 0
    moves = (np.abs(spec.h - spec.h[0]) > 1e-10).any(axis=0)
    width = 0
    while width < spec.dim and moves[spec.dim - 1 - width]:
        width += 1
    return width


def future_rows(spec: ModelSpec, future_x, width: int, horizon: int) -> np.ndarray:
    """H for the steps of a forecast: the structural part, then the future regressors."""
    if not width:
        return np.tile(spec.h[-1] if spec.varying else spec.h, (horizon, 1))
    if future_x is None:
        raise ValueError("future regressors are required")
    x = np.asarray(future_x, np.float64)
    if x.shape != (horizon, width):
        raise ValueError(f"future regressors must be of shape {(horizon, width)}, got: {x.shape}")
    fixed = spec.h[:, : spec.dim - width] if spec.varying else spec.h[None, : spec.dim - width]
    if not np.allclose(fixed, fixed[0], atol=1e-10, rtol=1e-10):
        raise ValueError("the structural part of the observation rows must not change over time")
    return np.concatenate([np.tile(fixed[0], (horizon, 1)), x], axis=1)


def prior_variance(shape: float, scale: float) -> float:
    """The fixed variance that stands for a prior."""
    return scale / max(shape - 1.0, 0.5)


def fixed_q(spec: ModelSpec, source: str = "initial") -> np.ndarray:
    """Process variances of the fixed-variance lane: the initial ones, or those of the priors."""
    if source == "initial":
        return spec.q()
    d = np.zeros(spec.dim)
    for s in spec.noise:
        d[s.dim] = prior_variance(s.prior_shape, s.prior_scale)
    return np.diag(d)


def normalize_weights(weights, n: int) -> np.ndarray:
    w = np.asarray(weights, np.float64)
    if w.shape != (n,) or not np.isfinite(w).all() or (w <= 0).any():
        raise ValueError(f"weights must be {n} positive finite numbers")
    return w


def prewhiten(y: np.ndarray, spec: ModelSpec, weights) -> tuple[np.ndarray, ModelSpec]:
    """Observations and rows over the root of their variance weights, so all noise has one variance."""
    w = np.sqrt(normalize_weights(weights, len(y)))
    return y / w, replace(spec, h=spec.rows(0, len(y)) / w[:, None])
