"""Online anomaly scoring: one filter step for each observation of a stream, with the filter's state kept by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelens.kernels.linalg import z_score
from tidelens.kernels.series import score_of, step_detector

SCHEMA = "series_id string, ts timestamp, value double, predicted double, predicted_sd double, z_score double, anomaly boolean, severity string"


def score_stream(events: DataFrame, q: float = 1.0, r: float = 1.0, p0: float = 1.0, alpha: float = 0.01, delay: str = "1 hour", idle_ms: int | None = None) -> DataFrame:
    """Scores of (series_id, ts, y). Steps of a micro-batch are taken in order of ts; rows behind the watermark are dropped.

    The first observation starts a series' state and is not scored against itself. A missing y only predicts. A row that
    is older than the last step of its series, but not late, is scored after it: the filter has no way back. A row
    without ts is dropped. idle_ms: the state of a series goes once the watermark is so far behind its latest row.
    """
    z, live = z_score(alpha), events.isStreaming
    names = ["series_id", "ts", "value", "predicted", "predicted_sd", "z_score", "anomaly", "severity"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=names)
            return
        rows = pd.concat(list(frames)).sort_values("us", kind="stable")
        mark = state.getCurrentWatermarkMs() if live else -1
        x, p, latest = state.get if state.exists else (None, None, None)
        out = []
        for ts, us, y in rows[["ts", "us", "y"]].itertuples(index=False, name=None):
            if us < mark * 1000:
                continue
            latest = us if latest is None else max(latest, us)
            y = None if y is None or y != y else float(y)
            if x is None:
                if y is not None:
                    x, p = y, p0
                continue
            m, sd, x, p = step_detector(x, p, y, 1.0, 1.0, q, r)
            s = score_of(y, m, sd, z)
            out.append((key[0], ts, y, m, sd, s["z_score"], s["anomaly"], s["severity"]))
        if x is not None:
            state.update((x, p, latest))
            if live and idle_ms is not None:
                state.setTimeoutTimestamp(max(latest // 1000 + idle_ms, mark + 1))
        yield pd.DataFrame(out, columns=names)

    timed = events.select("series_id", F.col("ts").cast("timestamp").alias("ts"), F.col("y").cast("double").alias("y")).filter("ts IS NOT NULL")
    if live:
        timed = timed.withWatermark("ts", delay)
    timed = timed.withColumn("us", F.unix_micros("ts"))
    forget = GroupStateTimeout.EventTimeTimeout if live and idle_ms is not None else GroupStateTimeout.NoTimeout
    return timed.groupBy("series_id").applyInPandasWithState(step, SCHEMA, "x double, p double, latest long", "append", forget)


def windowed_series(events: DataFrame, every: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(series_id, ts, y): sums by event-time window of a stream (series_id, ts, value), late rows behind the watermark dropped.

    Event times without a time zone are taken as timestamps first: a watermark needs those.
    """
    timed = events.select("series_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).withWatermark("ts", delay)
    return timed.groupBy("series_id", F.window("ts", every).alias("w")).agg(F.sum("value").alias("y")).select("series_id", F.col("w.start").alias("ts"), "y")
