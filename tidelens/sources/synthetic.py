"""Synthetic series with known effects, as DataFrames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.functions.columns import fourier
from tidelens.kernels import series as ks
from tidelens.kernels import shapley
from tidelens.kernels.linalg import stream


def baseline(spark: SparkSession, total: int, config: dict) -> DataFrame:
    """(t, baseline) from column expressions alone."""
    return spark.range(total).select(F.col("id").alias("t"), fourier(F.col("id"), config).alias("baseline"))


def _lift(total: int, spots, effect: dict) -> float:
    return float(ks.effect_signal(_impulse(total, spots), effect).sum())


def _impulse(total: int, spots) -> np.ndarray:
    on = np.zeros(total)
    for s in spots:
        on[s["start"] : s["end"]] = 1.0
    return on


def true_attribution(config: dict) -> dict[str, float]:
    """Shapley shares of the true effect among the spots of each overlap group."""
    by = {s["id"]: s for s in config["spots"]}
    out: dict[str, float] = {}
    for group in shapley.overlap_groups([(s["id"], s["start"], s["end"]) for s in config["spots"]]):
        ids = [g[0] for g in group]
        total = _lift(config["total"], [by[i] for i in ids], config["effect"])
        if len(ids) <= 8:
            value = lambda some: _lift(config["total"], [by[i] for i in some], config["effect"]) if some else 0.0
        else:
            value = shapley.rank_decay({i: _lift(config["total"], [by[i]], config["effect"]) for i in ids})
        out |= shapley.allocate(ids, total, value)
    return out


def generate(config: dict) -> dict:
    """Observations, their parts, the spots' true shares and correlated controls of one scenario."""
    parts = _plain(config)
    controls = ks.correlated_controls(parts["contribution"], config["controls"]["count"], config["controls"]["correlation"], stream(config["seed"], "controls"))
    return parts | {"attribution": true_attribution(config), "controls": controls, "spots": config["spots"]}


def scenario_series(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """(series_id, t, y, baseline, contribution) of the scenarios, each generated in a task of its own."""
    chosen = {k: v for k, v in ks.scenarios().items() if names is None or k in names}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["series_id"].iloc[0]
        g = _plain(chosen[name])
        return pd.DataFrame({"series_id": name, "t": np.arange(len(g["y"])), "y": g["y"], "baseline": g["baseline"], "contribution": g["contribution"]})

    ids = spark.createDataFrame([(k,) for k in chosen], "series_id string")
    return ids.groupBy("series_id").applyInPandas(run, "series_id string, t long, y double, baseline double, contribution double")


def _plain(config: dict) -> dict:
    """One scenario's series without shares and controls, which take longer."""
    t = np.arange(config["total"])
    base = ks.fourier_baseline(t, config["baseline"])
    lift = ks.effect_signal(_impulse(config["total"], config["spots"]), config["effect"])
    return {"y": base + lift + stream(config["seed"], "noise").standard_normal(len(t)) * config["noise_sd"], "baseline": base, "contribution": lift}
