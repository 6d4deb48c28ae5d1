"""Column expressions: quantile rules, scalar recursions, effects and normal probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelens.kernels.linalg import z_score

ADSTOCK_BLOCK = 256
NEAR_ZERO = 1e-10


def z_of(alpha: float) -> Column:
    return F.lit(z_score(alpha))


def observed(y: Column) -> Column:
    """y, with NaN as NULL: both are missing."""
    return F.when(~F.isnan(y), y)


# ---- quantiles: four rules, each with its own place --------------------------------------------------------------


def linear_quantile(v: Column, p: float) -> Column:
    """Linear interpolation at p (n - 1); exact."""
    return F.percentile(v, F.lit(p))


def ordered(v: Column) -> Column:
    """An aggregate: a group's values in order, gathered once for all the places that are taken from them."""
    return F.array_sort(F.collect_list(v))


def lower_outward(a: Column, alpha: float) -> Column:
    """Of ordered values the one at alpha / 2, rounded down."""
    return F.element_at(a, (F.floor(F.lit(alpha / 2) * (F.size(a) - 1)) + 1).cast("int"))


def upper_outward(a: Column, alpha: float) -> Column:
    """Of ordered values the one at 1 - alpha / 2, rounded up."""
    return F.element_at(a, (F.ceil(F.lit(1 - alpha / 2) * (F.size(a) - 1)) + 1).cast("int"))


def nearest_rank(a: Column, p: float) -> Column:
    """Of ordered values the one at p (n - 1), rounded half away from zero."""
    return F.element_at(a, (F.floor(F.lit(p) * (F.size(a) - 1) + 0.5) + 1).cast("int"))


# ---- recursions that keep a state of fixed size --------------------------------------------------------------------


def history(t: Column, *values: Column) -> Column:
    """A group's values in order of t, for a fold."""
    return F.array_sort(F.collect_list(F.struct(t.alias("t"), *values)))


def local_level_terminal(steps: Column, q: float, r: float, x0: Column | float, p0: float) -> Column:
    """Terminal mean x and variance p of a local-level filter over structs with a field y, as one fold in the JVM."""
    init = F.struct(F.lit(x0).cast("double").alias("x") if not isinstance(x0, Column) else x0.cast("double").alias("x"), F.lit(float(p0)).alias("p"))

    def step(s: Column, o: Column) -> Column:
        pp = s["p"] + q
        k = pp / (pp + r)
        seen = o["y"].isNotNull() & ~F.isnan(o["y"])
        x = F.when(seen, s["x"] + k * (o["y"] - s["x"])).otherwise(s["x"])
        p = F.when(seen, (1 - k) * pp * (1 - k) + k * r * k).otherwise(pp)
        return F.struct(x.alias("x"), p.alias("p"))

    return F.aggregate(steps, init, step)


def adstock_path(values: Column, decay: float) -> Column:
    """Adstock of an array of doubles, as an array. Blocks of ADSTOCK_BLOCK values are folded apart, so no long array grows by copies."""
    size = F.lit(ADSTOCK_BLOCK)
    firsts = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values), size)).otherwise(F.array().cast("array<int>"))
    empty = F.array().cast("array<double>")
    last = lambda run, start: F.when(F.size(run) > 0, F.element_at(run, -1)).otherwise(start)

    def block(acc: Column, at: Column) -> Column:
        start = acc["last"]
        path = F.aggregate(F.slice(values, at, size), empty, lambda run, v: F.concat(run, F.array(v + decay * last(run, start))))
        # The path is bound once: a fold's expressions are evaluated wherever they stand.
        return F.element_at(F.transform(F.array(path), lambda p: F.struct(F.element_at(p, -1).alias("last"), F.concat(acc["paths"], F.array(p)).alias("paths"))), 1)

    start = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<array<double>>").alias("paths"))
    return F.flatten(F.aggregate(firsts, start, block, lambda acc: acc["paths"]))


def adstock_total(values: Column, decay: float) -> Column:
    """Sum of the adstock of an array of doubles: a fold with a state of two numbers, however long the array is."""
    init = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(s: Column, v: Column) -> Column:
        run = v + decay * s["run"]
        return F.struct(run.alias("run"), (s["sum"] + run).alias("sum"))

    return F.aggregate(values, init, step, lambda s: s["sum"])


def hill(x: Column, half: float, slope: float) -> Column:
    if half <= 0 or slope <= 0:
        raise ValueError("half and slope must be positive")
    up = F.pow(x, F.lit(slope))
    return F.when(x <= 0, F.lit(0.0)).otherwise(up / (up + half**slope))


def fourier(t: Column, config: dict) -> Column:
    """Level, trend, daily and weekly waves at minute t."""
    out = F.lit(config["intercept"]) + F.lit(config["trend"]) * t / 1440.0
    for waves, period in ((config["daily"], 1440.0), (config["weekly"], 10080.0)):
        for k, (a, b) in enumerate(waves, 1):
            angle = t * F.lit(2 * math.pi * k / period)
            out = out + a * F.sin(angle) + b * F.cos(angle)
    return out


# ---- effects -----------------------------------------------------------------------------------------------------


def relative_effect(total: Column, base: Column) -> Column:
    """total / base; 0 where the base is next to nothing."""
    return F.when(F.abs(base) > NEAR_ZERO, total / base).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def erfc(x: Column) -> Column:
    """Complementary error function, which Spark SQL lacks: a series of positive terms up to 3, a continued fraction beyond."""
    return F.element_at(F.transform(F.array(x), _erfc), 1)  # binds x, which stands in every term


def _erfc(x: Column) -> Column:
    a = F.abs(x)
    near, far = F.least(a, F.lit(3.0)), F.greatest(a, F.lit(3.0))
    down = lambda n: F.sequence(F.lit(n), F.lit(1), F.lit(-1))
    # Folds and not nested sums: the plan stays small.
    series = F.aggregate(down(60), F.lit(1.0), lambda s, k: 1.0 + 2.0 * near * near / (2 * k + 1) * s)
    fraction = F.aggregate(down(30), far, lambda s, k: far + k / 2.0 / s)
    root = math.sqrt(math.pi)
    upper = F.when(a <= 3.0, 1.0 - 2.0 / root * near * F.exp(-near * near) * series).otherwise(F.exp(-far * far) / root / fraction)
    return F.when(x.isNotNull(), F.when(x < 0, 2.0 - upper).otherwise(upper))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function; null and NaN stay."""
    return F.when(F.isnan(z), z).otherwise(0.5 * erfc(-z / math.sqrt(2)))


def p_positive(mean: Column, variance: Column) -> Column:
    """P(effect > 0) of a normal effect with a mean and a variance; 1, 0 or 1/2 without variance; null for a null."""
    sure = F.when(mean > 0, 1.0).when(mean < 0, 0.0).when(mean == 0, 0.5)
    return F.when(variance <= 0, sure).otherwise(normal_cdf(mean / F.sqrt(variance)))


def severity(z: Column, threshold: float) -> Column:
    return F.when(F.abs(z) > 2 * threshold, "critical").when(F.abs(z) > threshold, "warning").otherwise("normal")


def verdict(value: Column, good: Column, fair: Column) -> Column:
    """pass, warn or fail by two conditions; skip without a value."""
    return F.when(value.isNull(), "skip").when(good, "pass").when(fair, "warn").otherwise("fail")
