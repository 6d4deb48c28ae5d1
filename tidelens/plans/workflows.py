"""Whole analyses: options become a model and a lane, the lane becomes one plan over all series.

Lanes: "operational" (fixed variances, exact and fast) and "bayesian" (posterior draws). A lane never gives way to the
other silently.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions import columns as c
from tidelens.kernels import impact
from tidelens.kernels.linalg import validate_alpha
from tidelens.kernels.spec import ModelSpec, build_spec, local_level, rolling_spec
from tidelens.operators import attribution, checks, draws, models

MODES = ("operational", "bayesian")
METHODS = {"filter": "operational", "operational": "operational", "mcmc": "bayesian", "bayesian": "bayesian"}
CONTROL_VALUES = 5_000_000  # of all controls at most: they are a model's columns, which the driver holds
ANALYSIS_OPTIONS = frozenset("mode method alpha seasonality regressors regression_mode model_spec samples burn_in seed baseline controls control_threshold max_controls".split())


def resolve_mode(mode: str | None = None, method: str | None = None, default: str = "operational") -> str:
    """mode before method before the default."""
    found = mode or METHODS.get(method or "", method) or default
    if found not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got: {found}")
    return found


def measured(run: Callable):
    """What run() returns, and the milliseconds that it took, rounded up."""
    began = time.perf_counter()
    out = run()
    return out, int(-(-(time.perf_counter() - began) * 1000 // 1))


def metadata(mode: str, engine: str, method: str, elapsed_ms: int, **more) -> dict:
    if mode not in MODES or elapsed_ms < 0:
        raise ValueError("unknown mode or negative time")
    return {"mode": mode, "engine": engine, "method_used": method, "elapsed_ms": elapsed_ms} | more


def steps_of(df: DataFrame, post: tuple[int, int]) -> DataFrame:
    return df.filter(F.col("t").between(post[0] - 1, post[1] - 1))


def validate_spots(spots: DataFrame, length: int) -> DataFrame:
    """spots as they are; one whose window is empty or outside the post-period raises when it is read."""
    bad = (F.col("ws") < 0) | (F.col("ws") >= F.col("we")) | (F.col("we") > length)
    return spots.withColumn("ws", F.when(bad, F.raise_error(F.concat(F.lit("bad window of spot "), F.col("spot_id"))).cast("long")).otherwise(F.col("ws")))


def run_pipeline(df: DataFrame, pre, post, spots: DataFrame, spec: ModelSpec | None = None, mode: str | None = None, method: str | None = None, alpha: float = 0.05, samples: int = 200, seed: int = 0) -> tuple[DataFrame, dict]:
    """Impact and attribution of the spots' windows in the post-period; operational unless asked otherwise."""
    lane = resolve_mode(mode, method, "operational")
    spots = validate_spots(spots, post[1] - post[0] + 1)

    def go() -> DataFrame:
        if lane == "operational":
            cf = models.structured_impact(df, pre, post, spec or local_level(), alpha)
            # sd is that of the whole prediction: the attribution adds no observation variance to it.
            both = cf.select("series_id", (F.col("t") - (post[0] - 1)).alias("t"), (F.col("baseline") + F.col("effect")).alias("y"), F.col("baseline").alias("cf_mean"), (F.col("sd") * F.col("sd")).alias("cf_var"))
            return attribution.attribute(both, spots, 0.0, alpha)
        d = models.impact_draws(df, pre, post, spec, samples, seed=seed)
        return attribution.attribute_draws(d.withColumn("t", F.col("t") - (post[0] - 1)), spots, alpha)

    out, ms = measured(go)
    return out, metadata(lane, "spark", "filter" if lane == "operational" else "mcmc", ms)


def analyze(df: DataFrame, pre, post, **options) -> dict:
    """Impact of an intervention: point, cumulative and relative effect, and whether the interval of the sum excludes 0."""
    if unknown := options.keys() - ANALYSIS_OPTIONS:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    alpha = validate_alpha(options.get("alpha", 0.05))
    impact.validate_periods(post[1], pre, post)
    lane = resolve_mode(options.get("mode"), options.get("method"), "bayesian")
    regressors = options.get("regressors")
    if (controls := options.get("controls")) is not None:
        regressors = control_matrix(df, controls, pre, post[1], options.get("control_threshold"), options.get("max_controls", 10))
    spec = build_spec(options.get("model_spec"), options.get("seasonality"), regressors, options.get("regression_mode", "dynamic"))
    if lane == "bayesian":
        d = models.impact_draws(df, pre, post, spec, options.get("samples", 200), options.get("burn_in"), options.get("seed", 0))
        parts = models.impact_summary(d, alpha)
    else:
        got = models.structured_impact(df, pre, post, spec or local_level(), alpha, options.get("baseline", "forecast"))
        z = c.z_of(alpha)
        one = got.groupBy("series_id").agg(F.first("cumulative").alias("mean"), F.first("cumulative_sd").alias("sd"), F.first("relative").alias("_rel"), F.sum("baseline").alias("_base"))
        rel_sd = c.relative_effect(F.col("sd"), F.abs("_base"))
        parts = {
            "point": got.select("series_id", "t", F.col("effect").alias("mean"), "sd", "lower", "upper"),
            "cumulative": one.select("series_id", "mean", "sd", (F.col("mean") - z * F.col("sd")).alias("lower"), (F.col("mean") + z * F.col("sd")).alias("upper")),
            "relative": one.select("series_id", F.col("_rel").alias("mean"), rel_sd.alias("sd"), (F.col("_rel") - z * rel_sd).alias("lower"), (F.col("_rel") + z * rel_sd).alias("upper")),
        }
    parts["cumulative"] = parts["cumulative"].withColumn("significant", (F.col("lower") > 0) | (F.col("upper") < 0))
    return parts | {"mode": lane, "alpha": alpha, "steps": post[1] - post[0] + 1}


def analyze_at(df: DataFrame, start: int, end: int, **options) -> dict:
    """analyze with everything before the 1-based step start as the pre-period."""
    if start < 2:
        raise ValueError("the intervention must start at step 2 at least")
    return analyze(df, (1, start - 1), (start, end), **options)


def control_matrix(target: DataFrame, controls: DataFrame, pre, length: int, threshold: float | None, most: int):
    """Controls (control_id, t, y) as a matrix with a row for each step, chosen by correlation in the pre-period if asked.

    A model's regressors are a few columns of one series' length, so the driver holds them, as it holds the model.
    """
    import numpy as np

    chosen = controls.filter(F.col("t") < length)
    if threshold is not None:
        window = F.col("t").between(pre[0] - 1, pre[1] - 1)
        best = models.pearson_controls(target.filter(window).groupBy("t").agg(F.avg("y").alias("y")), chosen.filter(window), threshold, most)
        chosen = chosen.join(F.broadcast(best.select("control_id")), "control_id")
    if chosen.limit(CONTROL_VALUES + 1).count() > CONTROL_VALUES:
        raise ValueError(f"controls have more than {CONTROL_VALUES} values; select some by control_threshold and max_controls")
    rows = chosen.groupBy("control_id").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("v")).orderBy("control_id").collect()
    if not rows:
        return None
    x = np.array([[p["y"] for p in r["v"]] for r in rows], np.float64).T
    if len(x) != length:
        raise ValueError(f"controls have {len(x)} steps, {length} are needed")
    return x


def effects(analysis: dict) -> DataFrame:
    """The eight numbers that applications report for each series, and significance."""
    n = analysis["steps"]
    safe = lambda x: F.when(F.col(x).isNull() | F.isnan(x), F.lit(0.0)).otherwise(F.col(x))
    total = analysis["cumulative"].select("series_id", safe("mean").alias("cumulative"), safe("sd").alias("cumulative_sd"), safe("lower").alias("cumulative_lower"), safe("upper").alias("cumulative_upper"), "significant")
    rel = analysis["relative"].select("series_id", safe("mean").alias("relative"), safe("sd").alias("relative_sd"))
    return total.join(rel, "series_id").withColumn("per_period", F.col("cumulative") / n).withColumn("per_period_sd", F.col("cumulative_sd") / n)


def report(effect: DataFrame) -> DataFrame:
    """A line of text for each series."""
    text = F.format_string(
        "Cumulative effect: %.2f (SD %.2f), interval %.2f to %.2f; relative %.1f%%; significant: %s",
        "cumulative", "cumulative_sd", "cumulative_lower", "cumulative_upper", F.col("relative") * 100, F.when(F.col("significant"), "yes").otherwise("no"),
    )
    return effect.select("series_id", text.alias("report"))


# ---- applications -------------------------------------------------------------------------------------------------


def campaign_indices(dates: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Campaigns by date as campaigns by 1-based index of the calendar (date); a date that isn't there raises."""
    index = dates.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")).cast("long"))
    out = campaigns
    for name in ("start_date", "end_date", "baseline_start_date", "baseline_end_date"):
        found = index.select(F.col("date").alias(name), F.col("i").alias(name.replace("_date", "_index")))
        out = out.join(found, name, "left")
        got = F.col(name.replace("_date", "_index"))
        out = out.withColumn(name.replace("_date", "_index"), F.when(got.isNull(), F.raise_error(F.concat(F.lit("no such date: "), F.col(name).cast("string"))).cast("long")).otherwise(got))
    return out


def observed_relative(effect: DataFrame, series: DataFrame, baseline: tuple[int, int], campaign: tuple[int, int]) -> DataFrame:
    """Campaign effects against the observed mean of the baseline, and the means of both windows."""
    mean = lambda w: F.avg(F.when(F.col("t").between(w[0] - 1, w[1] - 1), F.col("y")))
    means = series.groupBy("series_id").agg(F.coalesce(mean(baseline), F.lit(0.0)).alias("baseline_mean"), F.coalesce(mean(campaign), F.lit(0.0)).alias("actual_mean"))
    base = F.col("baseline_mean") * (campaign[1] - campaign[0] + 1)
    return effect.drop("relative", "relative_sd").join(means, "series_id").withColumn("relative", c.relative_effect(F.col("cumulative"), base)).withColumn("relative_sd", c.relative_effect(F.col("cumulative_sd"), F.abs(base)))


def campaign_lift(series: DataFrame, campaign: dict, **options) -> DataFrame:
    """Lift of one campaign: start_index, end_index, baseline_start, baseline_end, all 1-based."""
    pre, post = (campaign["baseline_start"], campaign["baseline_end"]), (campaign["start_index"], campaign["end_index"])
    out = observed_relative(effects(analyze(series, pre, post, **options)), series, pre, post)
    return out.withColumn("campaign", F.lit(campaign["name"]))


def campaign_lift_by_date(series: DataFrame, dates: DataFrame, campaign: dict, **options) -> DataFrame:
    """Lift of one campaign given by dates: name, start_date, end_date, baseline_start_date, baseline_end_date.

    dates: the calendar of the series' steps, one date for each. One row of four indices comes to the driver.
    """
    keys = ("start_date", "end_date", "baseline_start_date", "baseline_end_date")
    asked = series.sparkSession.createDataFrame([tuple(campaign[k] for k in keys)], ", ".join(f"{k} date" for k in keys))
    at = campaign_indices(dates, asked).first()
    own = {"name": campaign["name"], "start_index": at["start_index"], "end_index": at["end_index"], "baseline_start": at["baseline_start_index"], "baseline_end": at["baseline_end_index"]}
    return campaign_lift(series, own, **options)


def campaigns_lift(series: DataFrame, campaigns: list[dict], **options) -> DataFrame:
    """Lift of campaigns; those that overlap share one model and split its draws.

    campaign_group numbers the groups that overlap, and group_sd is the deviation of a group's whole lift.
    """
    from tidelens.kernels.shapley import overlap_groups

    by = {x["name"]: x for x in campaigns}
    out = None
    for g, group in enumerate(overlap_groups([(x["name"], x["start_index"], x["end_index"] + 1) for x in campaigns])):
        own = [by[x[0]] for x in group]
        if len(own) == 1:
            part = campaign_lift(series, own[0], **options).select("series_id", "campaign", "cumulative", "cumulative_sd", "cumulative_lower", "cumulative_upper", "significant", "relative", F.col("cumulative_sd").alias("group_sd"))
        else:
            pre = (min(x["baseline_start"] for x in own), max(x["baseline_end"] for x in own))
            post = (min(x["start_index"] for x in own), max(x["end_index"] for x in own))
            spec = build_spec(options.get("model_spec"), options.get("seasonality"), options.get("regressors"))
            d = models.impact_draws(series, pre, post, spec, options.get("samples", 200), options.get("burn_in"), options.get("seed", 0))
            spark = series.sparkSession
            windows = spark.createDataFrame([(x["name"], x["start_index"] - post[0], x["end_index"] - post[0] + 1, x["baseline_start"], x["baseline_end"]) for x in own], "spot_id string, ws long, we long, b0 long, b1 long")
            spots = series.select("series_id").distinct().crossJoin(F.broadcast(windows.select("spot_id", "ws", "we")))
            got = attribution.attribute_draws(d.withColumn("t", F.col("t") - (post[0] - 1)), spots, options.get("alpha", 0.05))
            means = series.join(F.broadcast(windows), F.col("t").between(F.col("b0") - 1, F.col("b1") - 1)).groupBy("series_id", "spot_id").agg(F.avg("y").alias("_mean"))
            part = got.join(means, ["series_id", "spot_id"]).select(
                "series_id", F.col("spot_id").alias("campaign"), F.col("lift").alias("cumulative"), F.col("lift_sd").alias("cumulative_sd"), F.col("lift_lower").alias("cumulative_lower"), F.col("lift_upper").alias("cumulative_upper"),
                ((F.col("lift_lower") > 0) | (F.col("lift_upper") < 0)).alias("significant"), c.relative_effect(F.col("lift"), F.col("_mean") * (F.col("we") - F.col("ws"))).alias("relative"),
            )
            covered = d.join(F.broadcast(windows.select("ws", "we")), (F.col("t") - (post[0] - 1) >= F.col("ws")) & (F.col("t") - (post[0] - 1) < F.col("we")), "left_semi")
            whole = covered.groupBy("series_id", "draw").agg(F.sum("effect").alias("_total")).groupBy("series_id").agg(F.coalesce(F.stddev_samp("_total"), F.lit(0.0)).alias("group_sd"))
            part = part.join(whole, "series_id")
        part = part.withColumn("campaign_group", F.lit(g))
        out = part if out is None else out.unionByName(part)
    return out


def campaigns_total(lifts: DataFrame) -> DataFrame:
    """Total lift of each series over what campaigns_lift gives, and its deviation, groups taken as independent."""
    groups = lifts.groupBy("series_id", "campaign_group").agg(F.sum("cumulative").alias("_sum"), F.first("group_sd").alias("_sd"))
    return groups.groupBy("series_id").agg(F.sum("_sum").alias("total_lift"), F.sqrt(F.sum(F.col("_sd") * F.col("_sd"))).alias("total_lift_sd"))


def policy_effect(series: DataFrame, pre_start: int, at: int, end: int, lag: int = 0, **options) -> DataFrame:
    """Interrupted time series: the effect from the 1-based step `at`, plus a lag; a metric is a series."""
    if lag < 0 or at + lag > end:
        raise ValueError("lag must not be negative and leave a post-period")
    return effects(analyze(series, (pre_start, at + lag - 1), (at + lag, end), **options))


def pre_trend_check(series: DataFrame, pre_start: int, at: int) -> DataFrame:
    """Slope before an intervention, and whether |t| is over 2."""
    got = checks.pre_trend(series.filter(F.col("t").between(pre_start - 1, at - 2)).withColumn("t", F.col("t") - (pre_start - 1)))
    return got.withColumn("significant_trend", F.abs("t_statistic") > 2.0)


def pre_trend_controls(series: DataFrame, controls: DataFrame, pre_start: int, at: int) -> DataFrame:
    """Of each series and control (control_id, t, y): the control's mean before an intervention, and the mean difference.

    Steps where either is missing are left out of the difference; missing control values of its mean.
    """
    window = F.col("t").between(pre_start - 1, at - 2)
    own = controls.filter(window).select("control_id", "t", c.observed(F.col("y")).alias("_x"))
    means = own.groupBy("control_id").agg(F.avg("_x").alias("control_mean"))
    pairs = series.filter(window).select("series_id", "t", c.observed(F.col("y")).alias("_y")).join(own, "t")
    return pairs.groupBy("series_id", "control_id").agg(F.avg(F.col("_y") - F.col("_x")).alias("mean_difference")).join(means, "control_id").select("series_id", "control_id", "control_mean", "mean_difference")


def promotion_impact(series: DataFrame, start: int, end: int, seasonality=None, regressors=None, **options) -> DataFrame:
    """Effect of a promotion over the 1-based steps start to end, against a forecast from everything before it."""
    return effects(analyze_at(series, start, end, seasonality=seasonality, regressors=regressors, **options))


def forecast_with_decomposition(series: DataFrame, horizon: int, spec: ModelSpec, samples: int = 200, alpha: float = 0.05, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The forecast's bands and the fitted components of the same chains."""
    return draws.summary_outward(models.forecast_draws(series, horizon, samples, None, spec, seed=seed), alpha), models.decompose(series, spec, samples, seed=seed)


def demand_forecast(series: DataFrame, horizon: int, seasonality=None, regressors=None, future_x=None, samples: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Mean, deviation and outward bands of the next steps under a trend, seasons and promotions."""
    spec = build_spec(None, seasonality, regressors)
    return draws.summary_outward(models.forecast_draws(series, horizon, samples, None, spec, future_x, seed=seed), alpha)


def tv_baseline(series: DataFrame, horizon: int, num_seasons: int = 96, **options) -> DataFrame:
    """Counterfactual of the next steps of a daily rhythm."""
    return models.rolling_baseline(series, rolling_spec(num_seasons), horizon, **options)


def tv_attribution(series: DataFrame, pre, post, spots: DataFrame, seasonality: int = 96, **options) -> tuple[DataFrame, dict]:
    return run_pipeline(series, pre, post, spots, build_spec(None, seasonality), **options)
