"""Validation metrics and convergence diagnostics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions import columns as c
from tidelens.kernels import diagnostics
from tidelens.kernels.linalg import z_score


def prediction_error(pairs: DataFrame) -> DataFrame:
    """Root mean squared and mean absolute percentage error of (series_id, actual, baseline); denominators from 1."""
    e = F.col("actual") - F.col("baseline")
    return pairs.groupBy("series_id").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e) / F.greatest(F.abs("actual"), F.lit(1.0))).alias("mape"), F.count(e).alias("n"))


def coverage(pairs: DataFrame, obs_variance: float, h: float = 1.0, level: float = 0.95) -> DataFrame:
    """Share of actual values inside the interval around the baseline; variance: the state's."""
    half = F.lit(z_score(round(1 - level, 12))) * F.sqrt(F.lit(h * h) * F.col("variance") + obs_variance)
    inside = (F.col("actual") >= F.col("baseline") - half) & (F.col("actual") <= F.col("baseline") + half)
    return pairs.groupBy("series_id").agg(F.avg(inside.cast("double")).alias("pct"), F.count_if(inside).alias("n_covered"), F.count("*").alias("n_total"))


def durbin_watson(residuals: DataFrame) -> DataFrame:
    """Of (series_id, t, residual); 2 without residuals' variance, NULL below three points."""
    lagged = residuals.withColumn("_d", F.col("residual") - F.lag("residual").over(Window.partitionBy("series_id").orderBy("t")))
    top, bottom, n = F.sum(F.col("_d") * F.col("_d")), F.sum(F.col("residual") * F.col("residual")), F.count("residual")
    return lagged.groupBy("series_id").agg(F.when(n >= 3, F.when(bottom > 0, top / bottom).otherwise(F.lit(2.0))).alias("statistic"), n.alias("n"))


def assess(metrics: DataFrame) -> DataFrame:
    """pass, warn, fail or skip for the columns mape, pct, statistic, placebo_significant, placebo_pct and max_pct_change."""
    m, p, d, s = (F.col(x) for x in ("mape", "pct", "statistic", "max_pct_change"))
    placebo = F.when(F.col("placebo_pct").isNull(), "skip").when(~F.col("placebo_significant") & (F.abs("placebo_pct") < 0.05), "pass").otherwise("fail")
    return metrics.select(
        "series_id",
        c.verdict(m, m <= 0.10, m <= 0.20).alias("prediction_error"),
        c.verdict(p, (p >= 0.85) & (p <= 0.99), (p >= 0.80) & (p <= 1.0)).alias("coverage"),
        c.verdict(d, (d >= 1.5) & (d <= 2.5), (d >= 1.0) & (d <= 3.0)).alias("durbin_watson"),
        placebo.alias("placebo"),
        c.verdict(s, s <= 0.10, s <= 0.25).alias("effect_stability"),
    )


def evaluate(pairs: DataFrame, obs_variance: float, off_air: DataFrame | None = None, placebo: DataFrame | None = None, stable: DataFrame | None = None, level: float = 0.95) -> DataFrame:
    """All checks of (series_id, t, actual, baseline, variance) side by side with their verdicts.

    off_air: the steps (series_id, t) that count; placebo: (series_id, placebo_significant, placebo_pct); stable: what
    stability gives. A check without its input is skipped.
    """
    used = pairs if off_air is None else pairs.join(off_air.select("series_id", "t"), ["series_id", "t"], "left_semi")
    used = used.withColumn("residual", F.col("actual") - F.col("baseline"))
    out = prediction_error(used).withColumnRenamed("n", "n_errors").join(coverage(used, obs_variance, level=level), "series_id", "left").join(durbin_watson(used).drop("n"), "series_id", "left")
    none = {"placebo_significant": F.lit(None).cast("boolean"), "placebo_pct": F.lit(None).cast("double")}
    out = out.withColumns(none) if placebo is None else out.join(placebo.select("series_id", *none), "series_id", "left")
    out = out.withColumn("max_pct_change", F.lit(None).cast("double")) if stable is None else out.join(stable.select("series_id", "max_pct_change"), "series_id", "left")
    names = ("prediction_error", "coverage", "durbin_watson", "placebo", "effect_stability")
    return out.join(assess(out).select("series_id", *[F.col(n).alias(f"{n}_verdict") for n in names]), "series_id")


def placebo_window(steps: DataFrame, on_air: DataFrame) -> DataFrame:
    """The fake window in the middle of the steps off air, as long as the true one; none where they are too few."""
    off = steps.select("series_id", "t").join(on_air.select("series_id", "t"), ["series_id", "t"], "left_anti")
    sizes = on_air.groupBy("series_id").agg(F.count("*").alias("_k"))
    placed = off.withColumn("_i", F.row_number().over(Window.partitionBy("series_id").orderBy("t")) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("series_id"))).join(sizes, "series_id")
    start = F.greatest(F.floor(F.col("_n") / 2) - F.floor(F.col("_k") / 2), F.lit(0))
    return placed.filter((F.col("_n") >= 2 * F.col("_k")) & (F.col("_i") >= start) & (F.col("_i") < start + F.col("_k"))).select("series_id", "t")


def mean_lift(steps: DataFrame, window: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Lift over the steps (series_id, t) of a window against the mean of the other steps: lift, lift_pct, sd, lower, upper.

    steps: (series_id, t, y); missing values are left out. The sum of k values less k times a mean of n has the variance
    v (k + k k / n), v that of the other steps. A series without steps on both sides has no row.
    """
    marked = steps.select("series_id", "t", c.observed(F.col("y")).alias("y")).filter("y IS NOT NULL").join(window.select("series_id", "t", F.lit(True).alias("_in")), ["series_id", "t"], "left")
    inside = F.col("_in").isNotNull()
    sums = marked.groupBy("series_id").agg(F.sum(F.when(inside, F.col("y"))).alias("_sum"), F.count_if(inside).alias("_k"), F.avg(F.when(~inside, F.col("y"))).alias("_mean"), F.var_samp(F.when(~inside, F.col("y"))).alias("_v"), F.count_if(~inside).alias("_n"))
    base, z = F.col("_k") * F.col("_mean"), c.z_of(alpha)
    lift, sd = F.col("_sum") - base, F.sqrt(F.col("_v") * (F.col("_k") + F.col("_k") * F.col("_k") / F.col("_n")))
    return sums.filter("_k > 0 AND _n > 1").select("series_id", lift.alias("lift"), (100 * c.relative_effect(lift, base)).alias("lift_pct"), sd.alias("sd"), (lift - z * sd).alias("lower"), (lift + z * sd).alias("upper"))


def placebo_test(steps: DataFrame, on_air: DataFrame, estimate=mean_lift) -> DataFrame:
    """What the estimate finds in a window without an effect: its row for each series, and placebo_significant.

    estimate: of (steps, window) a table with series_id, lift, lift_pct, lower and upper. It sees only the steps off air.
    A series whose steps off air are fewer than twice those on air has no row.
    """
    fake = placebo_window(steps, on_air)
    off = steps.join(on_air.select("series_id", "t"), ["series_id", "t"], "left_anti")
    return estimate(off, fake).withColumn("placebo_significant", (F.col("lower") > 0) | (F.col("upper") < 0)).withColumn("placebo_pct", F.col("lift_pct"))


def effect_stability(estimate_at, width: int, delta: int = 5) -> DataFrame:
    """The lift estimated again at a narrower and a wider window, and its largest change.

    estimate_at: of a width a table (series_id, lift). Series that an estimate has no row for are left out.
    """
    widths = {"lift_base": width, "lift_low": max(5, width - delta), "lift_high": width + delta}
    out = None
    for name, w in widths.items():
        part = estimate_at(w).select("series_id", F.col("lift").alias(name))
        out = part if out is None else out.join(part, "series_id")
    return stability(out).withColumn("window_low", F.lit(widths["lift_low"])).withColumn("window_high", F.lit(widths["lift_high"]))


def stability(lifts: DataFrame) -> DataFrame:
    """Largest change of a lift at a narrower and a wider window: (series_id, lift_base, lift_low, lift_high)."""
    far = F.greatest(F.abs(F.col("lift_low") - F.col("lift_base")), F.abs(F.col("lift_high") - F.col("lift_base")))
    return lifts.withColumn("max_pct_change", F.when(F.abs("lift_base") > 0.01, far / F.abs("lift_base")).otherwise(F.lit(0.0)))


def pre_trend(series: DataFrame) -> DataFrame:
    """Slope of a line through (series_id, t, y), its standard error and t statistic; NULL below three points."""
    y = c.observed(F.col("y"))
    base = series.withColumn("_y", y).filter("_y IS NOT NULL")
    stats = base.groupBy("series_id").agg(F.count("*").alias("n"), F.regr_slope("_y", "t").alias("b"), F.regr_sxx("_y", "t").alias("sxx"), F.regr_syy("_y", "t").alias("syy"), F.regr_sxy("_y", "t").alias("sxy"))
    left = F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0))
    se = F.sqrt(left / (F.col("n") - 2) / F.col("sxx"))
    enough = F.col("n") >= 3
    return stats.select("series_id", "n", F.when(enough, F.col("b")).alias("slope"), F.when(enough, se).alias("slope_se"), F.when(enough, F.when(se > 1e-10, F.col("b") / se).otherwise(F.lit(0.0))).alias("t_statistic"))


# ---- chains (param, chain, i, value) -------------------------------------------------------------------------------


def _pooled(chains: DataFrame) -> DataFrame:
    """Within-chain variance w, pooled variance v, chains m and their common length n; longer chains are cut."""
    sizes = chains.groupBy("param", "chain").agg(F.count("*").alias("_k")).groupBy("param").agg(F.min("_k").alias("n"))
    cut = chains.join(sizes, "param").filter(F.col("i") <= F.col("n"))
    each = cut.groupBy("param", "chain", "n").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    both = each.groupBy("param", "n").agg(F.count("*").alias("m"), F.avg("var").alias("w"), (F.col("n") * F.var_samp("mean")).alias("b"))
    return both.filter("m >= 2 AND n >= 2").withColumn("v", (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b") / F.col("n"))


def r_hat(chains: DataFrame) -> DataFrame:
    """Potential scale reduction of each parameter; i counts a chain's draws from 1."""
    return _pooled(chains).select("param", F.when(F.col("w") != 0, F.sqrt(F.col("v") / F.col("w"))).alias("r_hat"))


def effective_sample_size(chains: DataFrame) -> DataFrame:
    all_ = F.col("m") * F.col("n")
    return _pooled(chains).select("param", F.when(F.col("v") != 0, F.least(all_ * F.col("w") / F.col("v"), all_.cast("double"))).alias("ess"))


def split_r_hat(chains: DataFrame) -> DataFrame:
    """R-hat of each chain's two halves."""
    n = F.count("*").over(Window.partitionBy("param", "chain"))
    halves = chains.withColumn("_n", n).filter("_n >= 4").withColumn("_h", F.floor(F.col("_n") / 2))
    side = F.when(F.col("i") <= F.col("_h"), 0).when(F.col("i") > F.col("_n") - F.col("_h"), 1)
    named = halves.withColumn("_side", side).filter("_side IS NOT NULL")
    key = F.concat_ws("|", "param", F.col("chain").cast("string"))
    i = F.when(F.col("_side") == 0, F.col("i")).otherwise(F.col("i") - (F.col("_n") - F.col("_h")))
    got = r_hat(named.select(key.alias("param"), F.col("_side").alias("chain"), i.alias("i"), "value"))
    return got.select(F.split_part("param", F.lit("|"), F.lit(1)).alias("param"), F.split_part("param", F.lit("|"), F.lit(2)).cast("int").alias("chain"), "r_hat")


def chain_diagnostics(chains: DataFrame) -> DataFrame:
    """Effective size by the initial monotone sequence and Geweke's z of each chain; a task per chain."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("i")["value"].to_numpy()
        ess, z = diagnostics.ess_single(x), diagnostics.geweke_z(x)
        ok = diagnostics.geweke_pass(x)
        return pd.DataFrame({"param": [pdf["param"].iloc[0]], "chain": [pdf["chain"].iloc[0]], "ess": [None if math.isnan(ess) else ess], "geweke_z": [None if math.isnan(z) else z], "geweke_pass": [ok]})

    return chains.groupBy("param", "chain").applyInPandas(run, "param string, chain int, ess double, geweke_z double, geweke_pass boolean")
