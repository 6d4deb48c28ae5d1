"""Algebra of joint draws (series_id, draw, h, value) and risk measures; all in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.functions import columns as c
from tidelens.kernels.linalg import z_score

BY = ["series_id", "h"]


def checked(draws: DataFrame) -> DataFrame:
    """Draws as they are; a value that isn't finite raises when it is read."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return draws.withColumn("value", F.when(bad, F.raise_error(F.lit("draws must be finite")).cast("double")).otherwise(F.col("value")))


def summary_interpolated(draws: DataFrame, alpha: float = 0.05) -> DataFrame:
    v = F.col("value")
    return draws.groupBy(*BY).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), c.linear_quantile(v, alpha / 2).alias("lower"), c.linear_quantile(v, 1 - alpha / 2).alias("upper"))


def summary_outward(draws: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Bands from order statistics, rounded outward."""
    v = F.col("value")
    a, held = F.col("_a"), draws.groupBy(*BY).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), c.ordered(v).alias("_a"))
    return held.select(*BY, "mean", "sd", c.lower_outward(a, alpha).alias("lower"), c.upper_outward(a, alpha).alias("upper"))


def summary_nearest(draws: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Median and bounds by nearest rank."""
    v = F.col("value")
    a, held = F.col("_a"), draws.groupBy(*BY).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), c.ordered(v).alias("_a"))
    return held.select(*BY, "mean", "sd", c.nearest_rank(a, 0.5).alias("median"), c.nearest_rank(a, alpha / 2).alias("lower"), c.nearest_rank(a, 1 - alpha / 2).alias("upper"))


def quantile(draws: DataFrame, p: float) -> DataFrame:
    return draws.groupBy(*BY).agg(c.ordered(F.col("value")).alias("_a")).select(*BY, c.nearest_rank(F.col("_a"), p).alias("quantile"))


def hpd(draws: DataFrame, level: float = 0.95) -> DataFrame:
    """The shortest interval with the level's share of a step's draws; the lowest of equal ones."""
    a = F.array_sort(F.collect_list("value"))
    rows = draws.groupBy(*BY).agg(a.alias("a")).withColumn("k", F.least(F.greatest(F.ceil(F.lit(level) * F.size("a")), F.lit(1)), F.size("a")).cast("int"))
    spans = F.transform(F.sequence(F.lit(1), F.size("a") - F.col("k") + 1), lambda i: F.struct((F.element_at("a", i + F.col("k") - 1) - F.element_at("a", i)).alias("width"), F.element_at("a", i).alias("lower"), F.element_at("a", i + F.col("k") - 1).alias("upper")))
    best = F.array_min(spans)
    return rows.select(*BY, best["lower"].alias("lower"), best["upper"].alias("upper"))


def to_lists(draws: DataFrame) -> DataFrame:
    """A row for each draw with its values in order of the steps."""
    return draws.groupBy("series_id", "draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "value"))), lambda s: s["value"]).alias("values"))


def mapped(draws: DataFrame, f) -> DataFrame:
    return draws.withColumn("value", f(F.col("value")))


def combine(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """f of the values of two sets of draws, paired by series, draw and step."""
    right = b.select("series_id", "draw", "h", F.col("value").alias("_other"))
    return a.join(right, ["series_id", "draw", "h"]).select("series_id", "draw", "h", f(F.col("value"), F.col("_other")).alias("value"))


def audience(viewing: DataFrame, share: DataFrame, universe: float | DataFrame) -> DataFrame:
    """Draw-wise product of viewing level, share and universe.

    universe: a number, a table (h, value) with a row for each step, or draws of its own (series_id, draw, h, value);
    values that aren't finite or are negative raise when they are read.
    """
    both = combine(viewing, share, lambda x, y: x * y)
    if not isinstance(universe, DataFrame):
        if not 0 <= universe < float("inf"):
            raise ValueError("the universe must be finite and not negative")
        return mapped(both, lambda v: v * float(universe))
    v = F.col("value")
    sound = checked(universe).withColumn("value", F.when(v < 0, F.raise_error(F.lit("the universe must not be negative")).cast("double")).otherwise(v))
    if "draw" in universe.columns:
        return combine(both, sound, lambda x, y: x * y)
    return scaled(both, sound.select("h", F.col("value").alias("weight")))


from_hut_share = audience


def scaled(draws: DataFrame, weights: DataFrame) -> DataFrame:
    """Draws times the weights (h, weight) of their steps; the weights are as many as the horizon has steps."""
    return draws.join(F.broadcast(weights), "h").select("series_id", "draw", "h", (F.col("value") * F.col("weight")).alias("value"))


def summed(draws: DataFrame) -> DataFrame:
    """The horizon's sum of each draw, as one step."""
    return draws.groupBy("series_id", "draw").agg(F.sum("value").alias("value")).select("series_id", "draw", F.lit(1).cast("long").alias("h"), "value")


def weighted_sum(draws: DataFrame, weights: DataFrame) -> DataFrame:
    return summed(scaled(draws, weights))


def risk(draws: DataFrame, threshold: float | Column) -> DataFrame:
    """P(below), expected shortfall, and the shortfall given that there is one (0 if there is none)."""
    t = F.lit(float(threshold)) if not isinstance(threshold, Column) else threshold
    v = F.col("value")
    return draws.groupBy(*BY).agg(
        F.avg((v < t).cast("double")).alias("probability_below"),
        F.avg(F.greatest(t - v, F.lit(0.0))).alias("expected_shortfall"),
        F.coalesce(F.avg(F.when(v < t, t - v)), F.lit(0.0)).alias("conditional_shortfall"),
    )


def makegood(draws: DataFrame, weights: DataFrame, guarantee: float, alpha: float = 0.05, reserve: float = 0.10) -> DataFrame:
    """Risk that a weighted delivery misses its guarantee."""
    total = weighted_sum(draws, weights)
    return summary_nearest(total, alpha).join(quantile(total, reserve).withColumnRenamed("quantile", "conservative"), BY).join(risk(total, guarantee), BY).drop("h")


def makegood_units(result: DataFrame, per_unit: float) -> DataFrame:
    if per_unit <= 0:
        raise ValueError("impressions per unit must be positive")
    return result.withColumn("makegood_units", F.col("expected_shortfall") / per_unit)


def safety_stock(forecast: DataFrame, service_level: float = 0.95, lead_time: int = 1) -> DataFrame:
    """z times the deviation of each step, and of the lead time's sum, for (series_id, h, sd)."""
    z = F.lit(z_score(round(2 * (1 - service_level), 12)))
    sd = F.greatest(F.col("sd"), F.lit(0.0))
    total = z * F.sqrt(F.sum(F.when(F.col("h") <= lead_time, sd * sd).otherwise(F.lit(0.0))))
    sums = forecast.groupBy(F.col("series_id").alias("_s")).agg(total.alias("total"))
    return forecast.join(sums, F.col("series_id") == F.col("_s")).select("series_id", "h", F.greatest(z * F.col("sd"), F.lit(0.0)).alias("per_period"), "total")
