"""Model operators over many series: a task per series (and chain), NumPy inside, draws and paths as rows.

Input is (series_id, t, y); missing y is NULL or NaN. Each operator shuffles once, by its group. Filters and projections
belong before these operators: they don't pass through a grouped map. A single very long series is one task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions import columns as c
from tidelens.kernels import forward, gibbs, impact, kalman
from tidelens.kernels import series as ks
from tidelens.kernels.linalg import stream, z_score
from tidelens.kernels.spec import ModelSpec, future_rows, local_level, regression_width

SERIES = ["series_id", "t", "y"]


def each_series(df: DataFrame, run: Callable[[str, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """run(series_id, t, y) for each series, in order of t."""

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        out = run(pdf["series_id"].iloc[0], pdf["t"].to_numpy(), pdf["y"].to_numpy(np.float64, na_value=np.nan))
        out.insert(0, "series_id", pdf["series_id"].iloc[0])
        return out

    return df.select(*SERIES).groupBy("series_id").applyInPandas(grouped, f"series_id string, {schema}")


def first_observed(df: DataFrame) -> DataFrame:
    """The first observation of each series that isn't missing; 0 if there is none."""
    y = c.observed(F.col("y"))
    return df.groupBy("series_id").agg(F.coalesce(F.min_by(y, F.when(y.isNotNull(), F.col("t"))), F.lit(0.0)).alias("first_obs"))


def filter_terminal(df: DataFrame, q: float, r: float, p0: float, x0: float | None = None) -> DataFrame:
    """x and p after the last step of a local-level filter; x0 None: the first observation. A fold in the JVM."""
    steps = df.groupBy("series_id").agg(c.history(F.col("t"), F.col("y").cast("double").alias("y")).alias("steps"))
    known = F.filter("steps", lambda s: s["y"].isNotNull() & ~F.isnan(s["y"]))
    start = F.coalesce(F.get(known, F.lit(0))["y"], F.lit(0.0)) if x0 is None else F.lit(float(x0))
    end = c.local_level_terminal(F.col("steps"), q, r, start, p0)
    return steps.select("series_id", F.size("steps").cast("long").alias("n"), F.inline(F.array(end)))


def filter_path(df: DataFrame, f=1.0, h=1.0, q=1.0, r=1.0, x0=0.0, p0=1.0) -> DataFrame:
    """Predicted and filtered mean and variance of each step; h: a number, or a function of t."""

    def run(_, t, y):
        fit = kalman.filter_scalar(y, f, np.array([h(v) for v in t.tolist()]) if callable(h) else h, q, r, x0, p0)
        return pd.DataFrame({"t": t} | fit)

    return each_series(df, run, "t long, x_pred double, p_pred double, x_filt double, p_filt double")


def smooth_path(df: DataFrame, f=1.0, q=1.0, r=1.0, x0=0.0, p0=1.0) -> DataFrame:
    """Smoothed mean and variance of each step, and the covariance with the next (NULL at the last)."""

    def run(_, t, y):
        fit = kalman.filter_scalar(y, f, 1.0, q, r, x0, p0)
        s = kalman.smooth_scalar(fit["x_filt"], fit["p_filt"], f, q)
        return pd.DataFrame({"t": t, "x_smooth": s["x_smooth"], "p_smooth": s["p_smooth"], "lag1": np.append(s["lag1"], np.nan)})

    out = each_series(df, run, "t long, x_smooth double, p_smooth double, lag1 double")
    return out.withColumn("lag1", F.when(~F.isnan("lag1"), F.col("lag1")))


def filter_structured(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Filtered state of a structural model as arrays."""

    def run(_, t, y):
        fit = kalman.filter_matrix(y, spec.f, spec.rows(0, len(y)), spec.q(), spec.obs_var, spec.x0, spec.p0)
        return pd.DataFrame({"t": t, "x": list(fit["x_filt"]), "p": [np.diag(p) for p in fit["p_filt"]]})

    return each_series(df, run, "t long, x array<double>, p array<double>")


def simulate_states(df: DataFrame, draws: int, q=1.0, r=1.0, x0=0.0, p0=1.0, seed=0) -> DataFrame:
    """Draws of a local level's states given the observations, as rows (draw, t, x)."""

    def run(sid, t, y):
        fit = kalman.filter_scalar(y, 1.0, 1.0, q, r, x0, p0)
        x = [kalman.simulate_scalar(fit["x_filt"], fit["p_filt"], 1.0, q, stream(seed, sid, d)) for d in range(draws)]
        return pd.DataFrame({"draw": np.repeat(np.arange(draws), len(t)), "t": np.tile(t, draws), "x": np.concatenate(x) if len(t) else []})

    return each_series(df, run, "draw long, t long, x double")


def simulate_given(df: DataFrame, noise: str = "z", q=1.0, r=1.0, x0=0.0, p0=1.0) -> DataFrame:
    """One draw of a local level's states (t, x) given the observations and the standard normal noise of each step.

    A null noise is 0, the mean of a normal variate; repeated steps keep their order by t and noise.
    """

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "z"], kind="stable")
        fit = kalman.filter_scalar(pdf["y"].to_numpy(np.float64, na_value=np.nan), 1.0, 1.0, q, r, x0, p0)
        x = kalman.simulate_scalar(fit["x_filt"], fit["p_filt"], 1.0, q, noise=pdf["z"].fillna(0.0).to_numpy())
        return pd.DataFrame({"series_id": pdf["series_id"], "t": pdf["t"], "x": x})

    return df.select(*SERIES, F.col(noise).cast("double").alias("z")).groupBy("series_id").applyInPandas(grouped, "series_id string, t long, x double")


def forecast_fixed(df: DataFrame, spec: ModelSpec, horizon: int, gap: int = 0) -> DataFrame:
    """Exact forecast with known variances: mean, variance and the variance of the running sum of each step ahead."""

    def run(_, t, y):
        rows = spec.rows(0, len(y))
        fit = kalman.filter_matrix(y, spec.f, rows, spec.q(), spec.obs_var, spec.x0, spec.p0)
        got = forward.forecast(fit["x_filt"][-1], fit["p_filt"][-1], spec, spec.q(), np.tile(rows[-1], (horizon, 1)), spec.obs_var, gap)
        return pd.DataFrame({"h": np.arange(1, horizon + 1)} | got)

    return each_series(df, run, "h long, mean double, variance double, cumulative_variance double")


# ---- sampling ----------------------------------------------------------------------------------------------------


def chains(df: DataFrame, n_chains: int, samples: int, burn_in: int | None = None, thin: int = 1, spec: ModelSpec | None = None, seed: int = 0) -> DataFrame:
    """Posterior draws of independent chains, a task for each series and chain: parameters and the terminal state.

    (series_id, chain, draw, obs_var, q, x_last, p_last, beta, gamma). A chain's random stream follows from the seed, the
    series and the chain, so a task that runs again draws the same.
    """
    burn = samples // 2 if burn_in is None else burn_in
    keyed = df.select(*SERIES).crossJoin(F.broadcast(df.sparkSession.range(n_chains).select(F.col("id").cast("int").alias("chain"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        sid, chain = pdf["series_id"].iloc[0], int(pdf["chain"].iloc[0])
        y = pdf["y"].to_numpy(np.float64, na_value=np.nan)
        rng = stream(seed, sid, chain)
        if spec is None:
            known = y[~np.isnan(y)]
            d = gibbs.sample_scalar(y, samples, rng, x0=float(known[0]) if len(known) else 0.0, burn_in=burn, thin=thin)
        else:
            d = gibbs.sample_structured(y, spec, samples, rng, burn, thin)
        none = [None] * samples
        return pd.DataFrame({
            "series_id": sid, "chain": chain, "draw": np.arange(samples), "obs_var": d.r, "q": list(d.q), "x_last": list(d.x), "p_last": [p.ravel() for p in d.p],
            "beta": none if d.beta is None else list(d.beta), "gamma": none if d.gamma is None else [g.tolist() for g in d.gamma],
        })

    return keyed.groupBy("series_id", "chain").applyInPandas(run, "series_id string, chain int, draw long, obs_var double, q array<double>, x_last array<double>, p_last array<double>, beta array<double>, gamma array<int>")


def inclusion(posterior: DataFrame) -> DataFrame:
    """Share of the draws in which each regressor is in the model, and its mean coefficient."""
    rows = posterior.select("series_id", F.posexplode(F.arrays_zip("gamma", "beta")).alias("regressor", "v"))
    return rows.groupBy("series_id", "regressor").agg(F.avg(F.col("v.gamma").cast("double")).alias("inclusion"), F.avg("v.beta").alias("mean_beta"))


def forecast_draws(df: DataFrame, horizon: int, samples: int = 200, burn_in: int | None = None, spec: ModelSpec | None = None, future_x=None, weights=None, future_weights=None, seed: int = 0) -> DataFrame:
    """Joint posterior predictive draws (series_id, draw, h, value): fit, then a path for each draw.

    weights: variance weights of the observations; the model sees y and H over their roots, and the draws are scaled back
    by those of the future steps.
    """
    from tidelens.kernels.spec import normalize_weights, prewhiten

    def run(sid, t, y):
        burn = samples // 2 if burn_in is None else burn_in
        own = local_level(obs_var=1.0) if spec is None and weights is not None else spec
        back = np.sqrt(normalize_weights(future_weights, horizon)) if future_weights is not None else np.ones(horizon)
        if own is None:
            known = y[~np.isnan(y)]
            d = gibbs.sample_scalar(y, samples, stream(seed, sid, "fit"), x0=float(known[0]) if len(known) else 0.0, burn_in=burn)
            paths = forward.scalar_paths(d.x[:, 0], d.q[:, 0], d.r, horizon, stream(seed, sid, "predict"))
        else:
            width = regression_width(own)
            ahead = future_rows(own, future_x, width, horizon) / back[:, None]
            seen, model = prewhiten(y, own, weights) if weights is not None else (y, own)
            d = gibbs.sample_structured(seen, model, samples, stream(seed, sid, "fit"), burn)
            paths = forward.structured_paths(d.x, own.f, ahead, d.q, d.r, stream(seed, sid, "predict")) * back
        return pd.DataFrame({"draw": np.repeat(np.arange(samples), horizon), "h": np.tile(np.arange(1, horizon + 1), samples), "value": paths.ravel()})

    return each_series(df, run, "draw long, h long, value double")


def predict_draws(posterior: DataFrame, horizon: int, spec: ModelSpec | None = None, future_x=None, seed: int = 0) -> DataFrame:
    """Joint predictive draws (series_id, chain, draw, h, value) from a kept fit: the rows that chains gave, stored or not.

    A path for each row, whose noise follows from the seed, the series, the chain and the draw: a longer horizon begins
    with the shorter one's path, and nothing is sampled again. No shuffle: rows are independent.
    """
    rows = future_rows(spec, future_x, regression_width(spec), horizon) if spec is not None else None

    def run(batches):
        for pdf in batches:
            parts = []
            for sid, chain, draw, r, q, x in pdf.itertuples(index=False, name=None):
                rng = stream(seed, sid, int(chain), int(draw))
                if spec is None:
                    z = rng.standard_normal((horizon, 2))
                    path = x[0] + np.cumsum(z[:, 0]) * np.sqrt(max(q[0], 0.0)) + z[:, 1] * np.sqrt(max(r, 0.0))
                else:
                    path = forward.structured_paths(np.asarray(x)[None, :], spec.f, rows, np.asarray(q)[None, :], np.array([r]), rng)[0]
                parts.append(pd.DataFrame({"series_id": sid, "chain": chain, "draw": draw, "h": np.arange(1, horizon + 1), "value": path}))
            yield pd.concat(parts) if parts else pd.DataFrame(columns=["series_id", "chain", "draw", "h", "value"])

    return posterior.select("series_id", "chain", "draw", "obs_var", "q", "x_last").mapInPandas(run, "series_id string, chain int, draw long, h long, value double")


def decompose(df: DataFrame, spec: ModelSpec, samples: int = 200, burn_in: int | None = None, seed: int = 0) -> DataFrame:
    """Posterior mean states of each step, and the fitted value that they give."""

    def run(sid, t, y):
        d = gibbs.sample_structured(y, spec, samples, stream(seed, sid, "fit"), samples // 2 if burn_in is None else burn_in)
        return pd.DataFrame({"t": t, "states": list(d.mean_states), "fitted": (spec.rows(0, len(y)) * d.mean_states).sum(axis=1)})

    return each_series(df, run, "t long, states array<double>, fitted double")


def scalar_moments(posterior: DataFrame, horizon: int) -> DataFrame:
    """Forecast moments of a local level from draws, in closed form: k q + r within, and the sample variance between."""
    per = posterior.groupBy("series_id").agg(F.avg(F.get("x_last", F.lit(0))).alias("m"), F.coalesce(F.var_samp(F.get("x_last", F.lit(0))), F.lit(0.0)).alias("b"), F.avg(F.get("q", F.lit(0))).alias("q"), F.avg("obs_var").alias("r"))
    steps = per.withColumn("h", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))))
    return steps.select("series_id", "h", F.col("m").alias("mean"), F.sqrt(F.col("b") + F.col("h") * F.col("q") + F.col("r")).alias("sd"))


def rolling_baseline(df: DataFrame, spec: ModelSpec, horizon: int, previous: dict[str, gibbs.Draws] | None = None, samples: int = 200, burn_in: int | None = None, seed: int = 0) -> DataFrame:
    """Counterfactual moments of the next steps, warm-started from former fits where a series has one."""
    held = previous or {}

    def run(sid, t, y):
        own = ks.warm_started(spec, held[sid]) if sid in held else spec
        burn = (50 if sid in held else 100) if burn_in is None else burn_in
        d = gibbs.sample_structured(y, own, samples, stream(seed, sid, "rolling"), burn)
        rows = np.tile(own.h[-1] if own.varying else own.h, (horizon, 1))
        got = forward.baseline_moments(d.x, d.p, own.f, rows, d.q, d.r)
        state = ks.convergence(d, own)
        return pd.DataFrame({"h": np.arange(1, horizon + 1), "cf_mean": got["mean"], "cf_var": got["variance"], "obs_variance": got["obs_variance"], "converged": state["converged"]})

    return each_series(df, run, "h long, cf_mean double, cf_var double, obs_variance double, converged boolean")


def ar_fit(df: DataFrame, order: int = 1, ridge: float = 1e-6) -> DataFrame:
    """Autoregression: coefficients (intercept first), innovation deviation and in-sample error."""

    def run(_, t, y):
        fit = ks.fit_ar(y, order, ridge)
        return pd.DataFrame({"coefficients": [fit["coefficients"]], "innovation_sd": [fit["innovation_sd"]], "rmse": [fit["rmse"]]})

    return each_series(df, run, "coefficients array<double>, innovation_sd double, rmse double")


def ar_draws(df: DataFrame, horizon: int, order: int = 1, samples: int = 200, ridge: float = 1e-6, seed: int = 0) -> DataFrame:
    def run(sid, t, y):
        paths = ks.predict_ar(ks.fit_ar(y, order, ridge), horizon, samples, stream(seed, sid, "ar"))
        return pd.DataFrame({"draw": np.repeat(np.arange(samples), horizon), "h": np.tile(np.arange(1, horizon + 1), samples), "value": paths.ravel()})

    return each_series(df, run, "draw long, h long, value double")


# ---- impact ------------------------------------------------------------------------------------------------------


def impact_draws(df: DataFrame, pre, post, spec: ModelSpec | None = None, samples: int = 200, burn_in: int | None = None, seed: int = 0) -> DataFrame:
    """Draws of an intervention's effect: (series_id, draw, t, actual, counterfactual, effect); periods are 1-based."""

    def run(sid, t, y):
        got = impact.estimate(y, pre, post, spec, samples, burn_in, seed=seed, key=(sid,))
        n = post[1] - post[0] + 1
        return pd.DataFrame({"draw": np.repeat(np.arange(samples), n), "t": np.tile(t[post[0] - 1 : post[1]], samples), "actual": np.tile(got["actual"], samples), "counterfactual": got["counterfactual"].ravel(), "effect": got["effect"].ravel()})

    return each_series(df, run, "draw long, t long, actual double, counterfactual double, effect double")


def _bounds(value: str, alpha: float) -> list:
    v = F.col(value)
    return [F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), c.linear_quantile(v, alpha / 2).alias("lower"), c.linear_quantile(v, 1 - alpha / 2).alias("upper")]


def impact_summary(draws: DataFrame, alpha: float = 0.05) -> dict[str, DataFrame]:
    """Point, cumulative and relative effects over draws: mean, deviation, interpolated bounds."""
    totals = draws.groupBy("series_id", "draw").agg(F.sum("effect").alias("total"), F.sum("counterfactual").alias("base"))
    totals = totals.withColumn("relative", c.relative_effect(F.col("total"), F.col("base")))
    return {
        "point": draws.groupBy("series_id", "t").agg(*_bounds("effect", alpha)),
        "cumulative": totals.groupBy("series_id").agg(*_bounds("total", alpha)),
        "relative": totals.groupBy("series_id").agg(*_bounds("relative", alpha)),
    }


def local_level_impact(df: DataFrame, pre, post, q: float, r: float, p0: float, alpha: float = 0.05) -> dict[str, DataFrame]:
    """Fixed-variance impact of a local level, in closed form from the filter's terminal state; no Python runs."""
    (a, b), (s, e) = pre, post
    gap, n = s - b - 1, e - s + 1
    end = filter_terminal(df.filter(F.col("t").between(a - 1, b - 1)), q, r, p0)
    after = df.filter(F.col("t").between(s - 1, e - 1))
    z = c.z_of(alpha)
    k = F.col("t") - (s - 1) + 1
    sd = F.sqrt(F.col("p") + (F.lit(gap) + k) * q + r)
    effect = F.col("y") - F.col("x")
    point = after.join(end, "series_id").select("series_id", "t", "y", F.col("x").alias("baseline"), effect.alias("effect"), sd.alias("sd"), (effect - z * sd).alias("lower"), (effect + z * sd).alias("upper"))
    total_sd = F.sqrt(F.lit(float(n * n)) * (F.first("p") + gap * q) + q * n * (n + 1) * (2 * n + 1) / 6.0 + n * r)
    sums = after.join(end, "series_id").groupBy("series_id").agg(F.sum(effect).alias("effect"), F.sum("x").alias("base"), total_sd.alias("sd"))
    cumulative = sums.select("series_id", "effect", "sd", (F.col("effect") - z * F.col("sd")).alias("lower"), (F.col("effect") + z * F.col("sd")).alias("upper"))
    rel, rel_sd = c.relative_effect(F.col("effect"), F.col("base")), c.relative_effect(F.col("sd"), F.abs("base"))
    relative = sums.select("series_id", rel.alias("effect"), rel_sd.alias("sd"), (rel - z * rel_sd).alias("lower"), (rel + z * rel_sd).alias("upper"))
    return {"point": point, "cumulative": cumulative, "relative": relative}


def structured_impact(df: DataFrame, pre, post, spec: ModelSpec, alpha: float = 0.05, baseline: str = "forecast") -> DataFrame:
    """Fixed-variance impact of any model: a row for each post step with the cumulative and relative effect beside it."""
    prepared = impact.prepare(spec, pre, post)

    def run(_, t, y):
        got = impact.operational(prepared, y, alpha, baseline)
        point, total, rel = got["point"], got["cumulative"], got["relative"]
        return pd.DataFrame({"t": t[post[0] - 1 : post[1]], "baseline": got["baseline"], "effect": point["mean"], "sd": point["sd"], "lower": point["lower"], "upper": point["upper"], "cumulative": total["mean"], "cumulative_sd": total["sd"], "relative": rel["mean"]})

    return each_series(df, run, "t long, baseline double, effect double, sd double, lower double, upper double, cumulative double, cumulative_sd double, relative double")


# ---- anomalies ---------------------------------------------------------------------------------------------------


def anomaly_scores(df: DataFrame, train: int, method: str = "filter", alpha: float = 0.01, q: float = 1.0, r: float = 1.0, p0: float = 1.0, samples: int = 200, seed: int = 0, spec: ModelSpec | None = None, future_x=None) -> DataFrame:
    """Scores of the steps from train on by a detector fitted on those before it.

    spec: a structural model. Method "filter" runs its filter with known variances through all steps and scores each
    against its prediction; otherwise the model is sampled on the training steps, and future_x are its regressors' rows
    of the steps to score.
    """
    names = ["value", "predicted", "predicted_sd", "residual", "z_score", "p_value", "anomaly", "severity"]

    def run(sid, t, y):
        later = t >= train
        if spec is not None and method == "filter":
            rows = spec.rows(0, len(y))
            fit = kalman.filter_matrix(y, spec.f, rows, spec.q(), spec.obs_var, spec.x0, spec.p0)
            mean = (rows * fit["x_pred"]).sum(axis=1)
            sd = np.sqrt(np.maximum(np.einsum("ti,tij,tj->t", rows, fit["p_pred"], rows), 0.0) + spec.obs_var)
            z = z_score(alpha)
            scores = [ks.score_of(None if np.isnan(v) else float(v), float(m), float(s), z) for v, m, s in zip(y[later], mean[later], sd[later], strict=True)]
        else:
            d = ks.fit_detector(y[~later], method, alpha, spec, q=q, r=r, p0=p0, samples=samples, seed=seed, key=(sid,))
            ahead = future_rows(spec, future_x, regression_width(spec), int(later.sum())) if spec is not None and future_x is not None else None
            scores = ks.score_series(d, y[later], ahead)
        return pd.DataFrame(scores, columns=names).assign(t=t[later])[["t", *names]]

    return each_series(df, run, "t long, value double, predicted double, predicted_sd double, residual double, z_score double, p_value double, anomaly boolean, severity string")


def detect(scores: DataFrame, least: str = "warning") -> DataFrame:
    return scores.filter(F.col("anomaly") & F.col("severity").isin(*(["critical"] if least == "critical" else ["warning", "critical"])))


def anomaly_summary(scores: DataFrame) -> DataFrame:
    n = F.count("*")
    return scores.groupBy("series_id").agg(
        n.alias("total"),
        F.count_if("anomaly").alias("anomalies"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "critical").alias("criticals"),
        (F.count_if("anomaly") / n).alias("anomaly_rate"),
        F.max(F.abs("z_score")).alias("max_abs_z"),
    )


# ---- controls ----------------------------------------------------------------------------------------------------


def pearson_controls(target: DataFrame, controls: DataFrame, threshold: float = 0.1, most: int = 10) -> DataFrame:
    """Controls (control_id, t, y) by the size of their correlation with the target (t, y): the best above a threshold."""
    pairs = controls.select("control_id", "t", F.col("y").alias("x")).join(target.select("t", "y"), "t").filter("x IS NOT NULL AND y IS NOT NULL")
    r = pairs.groupBy("control_id").agg(F.coalesce(F.nanvl(F.corr("x", "y"), F.lit(0.0)), F.lit(0.0)).alias("r"))
    # The number of controls is that of the model's columns: few, so one ordering of them all is no bottleneck.
    rank = F.row_number().over(Window.orderBy(F.abs("r").desc(), "control_id"))
    return r.filter(F.abs("r") >= threshold).withColumn("rank", rank).filter(F.col("rank") <= most)


def search_controls(target: DataFrame, controls: DataFrame, samples: int = 500, burn_in: int = 500, seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """Inclusion probability and mean coefficient of each control under a continuous spike and slab, one task per target."""
    pairs = controls.select("control_id", "t", F.col("y").alias("x")).join(target.select("series_id", "t", "y"), "t")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="t", columns="control_id", values="x").sort_index()
        y = pdf.drop_duplicates("t").set_index("t")["y"].reindex(wide.index)
        ok = wide.notna().all(axis=1) & y.notna()
        got = ks.search_controls(y[ok].to_numpy(), wide[ok].to_numpy(), samples, burn_in, seed=seed, threshold=threshold)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[0], "control_id": wide.columns, "inclusion": got["pip"], "mean_beta": got["beta"], "selected": got["pip"] >= threshold})

    return pairs.groupBy("series_id").applyInPandas(run, "series_id string, control_id string, inclusion double, mean_beta double, selected boolean")
