"""Attribution of lift to activity windows (series_id, spot_id, ws, we): 0-based, end exclusive."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions import columns as c
from tidelens.kernels import shapley
from tidelens.kernels.linalg import z_score


def overlap_groups(spots: DataFrame) -> DataFrame:
    """spots with group_id, from 0 in each series: chains of windows that overlap; windows that only touch don't."""
    order = Window.partitionBy("series_id").orderBy("ws", "we", "spot_id")
    reach = F.max("we").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("ws") >= reach), 1).otherwise(0)
    return spots.withColumn("_new", fresh).withColumn("group_id", (F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("_new")


def running_lift(cf: DataFrame, obs_variance: float = 0.0) -> DataFrame:
    """(series_id, t, lift, var): sums of y - cf_mean and cf_var + obs_variance over the steps before t, t up to n."""
    order = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    sums = cf.select("series_id", (F.col("t") + 1).alias("t"), F.sum(F.col("y") - F.col("cf_mean")).over(order).alias("lift"), F.sum(F.col("cf_var") + obs_variance).over(order).alias("var"))
    zero = cf.select("series_id").distinct().select("series_id", F.lit(0).cast("long").alias("t"), F.lit(0.0).alias("lift"), F.lit(0.0).alias("var"))
    return sums.unionByName(zero)


def window_lift(cf: DataFrame, spots: DataFrame, obs_variance: float = 0.0) -> DataFrame:
    """Lift and variance of each window: two equality joins with the running sums, whatever the windows' lengths."""
    run = running_lift(cf, obs_variance)
    start = run.select("series_id", F.col("t").alias("ws"), F.col("lift").alias("_l0"), F.col("var").alias("_v0"))
    end = run.select("series_id", F.col("t").alias("we"), F.col("lift").alias("_l1"), F.col("var").alias("_v1"))
    return spots.join(start, ["series_id", "ws"]).join(end, ["series_id", "we"]).select("series_id", "spot_id", "ws", "we", (F.col("_l1") - F.col("_l0")).alias("lift"), (F.col("_v1") - F.col("_v0")).alias("variance"))


def union_lift(cf: DataFrame, spots: DataFrame, by: list[str], obs_variance: float = 0.0) -> DataFrame:
    """Lift and variance over the union of the windows of each group: windows cut to what earlier ones left open."""
    order = Window.partitionBy("series_id", *by).orderBy("ws", "we").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("we").over(order), F.lit(0))
    parts = spots.withColumn("_from", F.greatest("ws", reach)).filter("_from < we").select("series_id", *by, F.monotonically_increasing_id().alias("spot_id"), F.col("_from").alias("ws"), "we")
    lifts = window_lift(cf, parts.select("series_id", "spot_id", "ws", "we"), obs_variance)
    return parts.select("series_id", "spot_id", *by).join(lifts, ["series_id", "spot_id"]).groupBy("series_id", *by).agg(F.sum("lift").alias("lift"), F.sum("variance").alias("variance"))


def attribute(cf: DataFrame, spots: DataFrame, obs_variance: float = 0.0, alpha: float = 0.05, mode: str | None = None, decay: float = 0.7) -> DataFrame:
    """Lift, deviation, bounds and P(lift > 0) of each spot; overlap groups share their union's lift by Shapley.

    cf: (series_id, t, y, cf_mean, cf_var). Groups are found by a window over the spots, running sums meet the windows'
    edges by equality joins, and each overlap group is shared out in a task of its own, whatever the series' length.
    Spots outside the series, empty ones and ids that repeat in a series raise an error.
    """
    z = z_score(alpha)
    run = running_lift(cf, obs_variance)
    start, end = (run.select("series_id", F.col("t").alias(e), F.col("lift").alias(f"_l{k}"), F.col("var").alias(f"_v{k}")) for k, e in enumerate(("ws", "we")))
    again = F.count("*").over(Window.partitionBy("series_id", "spot_id")) > 1
    own = overlap_groups(spots.select("series_id", "spot_id", "ws", "we").withColumn("_again", again))
    edged = own.join(start, ["series_id", "ws"], "left").join(end, ["series_id", "we"], "left")

    def share(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["ws"], r["we"], r["spot_id"]))
        if any(r["_again"] for r in rows):
            raise ValueError("spot ids must be unique")
        if any(r["_l0"] is None or r["_l1"] is None or r["ws"] >= r["we"] for r in rows):
            raise ValueError("a spot's window lies outside the series or is empty")
        lift_at, var_at = ({r[e]: r[f"_{x}{k}"] for r in rows for k, e in enumerate(("ws", "we"))} for x in "lv")
        found = shapley.share_group([(r["spot_id"], r["ws"], r["we"]) for r in rows], lift_at, var_at, mode, decay)
        out = [{c: r[c] for c in ("series_id", "spot_id", "ws", "we", "group_id")} | {"lift": x, "variance": v} for r, (_, x, v) in zip(rows, found, strict=True)]
        return pa.Table.from_pylist(out, pa.schema([*(table.schema.field(c) for c in ("series_id", "spot_id", "ws", "we", "group_id")), ("lift", pa.float64()), ("variance", pa.float64())]))

    shared = edged.groupBy("series_id", "group_id").applyInArrow(share, "series_id string, spot_id string, ws long, we long, group_id long, lift double, variance double")
    sd = F.sqrt(F.greatest("variance", F.lit(0.0)))
    return shared.select(
        "series_id", "spot_id", "ws", "we", "group_id", "lift", sd.alias("lift_sd"), (F.col("lift") - z * sd).alias("lift_lower"), (F.col("lift") + z * sd).alias("lift_upper"), c.p_positive(F.col("lift"), F.greatest("variance", F.lit(0.0))).alias("p_positive")
    )


def totals(attributed: DataFrame) -> DataFrame:
    """Total lift of a series and its deviation, spots taken as independent."""
    return attributed.groupBy("series_id").agg(F.sum("lift").alias("total_lift"), F.sqrt(F.sum(F.col("lift_sd") * F.col("lift_sd"))).alias("total_lift_sd"))


def attribute_draws(draws: DataFrame, spots: DataFrame, alpha: float = 0.05, decay: float = 0.7) -> DataFrame:
    """Spots' lifts over posterior draws (series_id, draw, t, actual, counterfactual), t from 0 in the post-period.

    Lifts are shared out in each draw, a task for each series and draw; then mean, deviation, outward order statistics
    and the share of draws above 0.
    """
    keyed = draws.select("series_id", "draw", "t", "actual", "counterfactual")
    with_spots = keyed.groupBy("series_id", "draw").agg(F.array_sort(F.collect_list(F.struct("t", "actual", "counterfactual"))).alias("steps"))
    cast = spots.groupBy("series_id").agg(F.collect_list(F.struct("spot_id", "ws", "we")).alias("spots"))

    def run(batches):
        for pdf in batches:
            out = []
            for sid, draw, steps, own in pdf[["series_id", "draw", "steps", "spots"]].itertuples(index=False, name=None):
                y = [s["actual"] for s in steps]
                m = [s["counterfactual"] for s in steps]
                out += [(sid, draw, r[0], r[1], r[2], r[3]) for r in shapley.attribute(y, m, np.zeros(len(y)), 0.0, [(s["spot_id"], s["ws"], s["we"]) for s in own], None, decay)]
            yield pd.DataFrame(out, columns=["series_id", "draw", "spot_id", "ws", "we", "lift"])

    lifts = with_spots.join(cast, "series_id").mapInPandas(run, "series_id string, draw long, spot_id string, ws long, we long, lift double")
    v = F.col("lift")
    by = ["series_id", "spot_id", "ws", "we"]
    held = lifts.groupBy(*by).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("lift_sd"), c.ordered(v).alias("_a"), F.avg((v > 0).cast("double")).alias("p_positive"))
    return held.select(*by, F.col("mean").alias("lift"), "lift_sd", c.lower_outward(F.col("_a"), alpha).alias("lift_lower"), c.upper_outward(F.col("_a"), alpha).alias("lift_upper"), "p_positive")


# ---- Shapley as joins --------------------------------------------------------------------------------------------


def shapley_exact(coalitions: DataFrame, players: int) -> DataFrame:
    """Shapley shares from (group_id, mask, value) of all coalitions of the same number of players, as one self join."""
    if not 1 <= players <= shapley.EXACT_PLAYERS:
        raise ValueError(f"1 to {shapley.EXACT_PLAYERS} players")
    size = F.bit_count("mask")
    weight = F.element_at(F.array(*[F.lit(math.factorial(s) * math.factorial(players - s - 1) / math.factorial(players)) for s in range(players)]), (size + 1).cast("int"))
    worth = coalitions.select("group_id", F.col("mask").cast("long").alias("mask"), "value")
    steps = worth.withColumn("player", F.explode(F.sequence(F.lit(0), F.lit(players - 1)))).withColumn("_bit", F.element_at(F.array(*[F.lit(1 << i).cast("long") for i in range(players)]), F.col("player") + 1))
    steps = steps.filter(F.col("mask").bitwiseAND(F.col("_bit")) == 0).withColumn("_with", F.col("mask").bitwiseOR(F.col("_bit")))
    grown = worth.select("group_id", F.col("mask").alias("_with"), F.col("value").alias("_value"))
    return steps.join(grown, ["group_id", "_with"]).groupBy("group_id", "player").agg(F.sum(weight * (F.col("_value") - F.col("value"))).alias("share"))


def normalize_to_total(shares: DataFrame, group: str, share: str, total: str) -> DataFrame:
    """Shares rescaled to their group's total; equal ones where they sum to nothing."""
    w = Window.partitionBy(group)
    now, n = F.sum(share).over(w), F.count("*").over(w)
    return shares.withColumn("normalized", F.when(F.abs(now) < 1e-10, F.col(total) / n).otherwise(F.col(share) * F.col(total) / now))


def rank_decay_value(lifts: DataFrame, group: str, lift: str, decay: float = 0.7) -> DataFrame:
    """Value of each group of lifts: by size, each worth less by its rank; equal sizes share their ranks' mean weight."""
    order = Window.partitionBy(group).orderBy(F.abs(lift).desc())
    weighed = lifts.withColumn("_w", F.pow(F.lit(decay), F.row_number().over(order) - 1)).withColumn("_size", F.abs(lift))
    mean = F.avg("_w").over(Window.partitionBy(group, "_size"))
    return weighed.withColumn("_mean", mean).groupBy(group).agg(F.sum(F.col(lift) * F.col("_mean")).alias("value"))


def time_decay_value(lifts: DataFrame, group: str, lift: str, time: str, half_life: float = 7.0) -> DataFrame:
    """Value of each group of lifts that fade with their age against the latest of the group."""
    if half_life <= 0:
        raise ValueError("half_life must be positive")
    latest = F.max(time).over(Window.partitionBy(group))
    return lifts.withColumn("_age", latest - F.col(time)).groupBy(group).agg(F.sum(F.col(lift) * F.exp(F.lit(-math.log(2) / half_life) * F.col("_age"))).alias("value"))
