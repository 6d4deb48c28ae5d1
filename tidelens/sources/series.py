"""Series from event tables: (series_id, t, ts, y) with a dense index, gaps as NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense_series(rows: DataFrame, series: Column, ts: Column, value: Column, unit: str = "day") -> DataFrame:
    """Sums of value for each series and calendar step; steps without rows, between the table's first and last, are NULL.

    One aggregation shuffles, with partial sums before it; the calendar of a series is built where its sums are.
    """
    step = {"day": "INTERVAL 1 DAY", "hour": "INTERVAL 1 HOUR"}[unit]
    base = rows.select(series.cast("string").alias("series_id"), F.date_trunc(unit, ts.cast("timestamp")).alias("ts"), value.cast("double").alias("v")).filter("series_id IS NOT NULL AND ts IS NOT NULL")
    sums = base.groupBy("series_id", "ts").agg(F.sum("v").alias("y"))
    ends = sums.agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    # One row: the ends of the calendar, known before the join is planned as a broadcast.
    calendar = sums.select("series_id").distinct().crossJoin(F.broadcast(ends)).select("series_id", F.posexplode(F.sequence("first", "last", F.expr(step))).alias("t", "ts"))
    return calendar.join(sums, ["series_id", "ts"], "left").select("series_id", F.col("t").cast("long").alias("t"), "ts", "y")


def event_series(spark, sf_dir: str, unit: str = "day") -> DataFrame:
    """Value of events by type and step."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    return dense_series(e, F.col("event_type"), F.col("ts"), F.col("value"), unit)


def order_series(spark, sf_dir: str, by: str = "o_orderpriority") -> DataFrame:
    """Order totals by day and one of the orders' columns."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(by, "o_orderdate", "o_totalprice")
    return dense_series(o, F.col(by), F.col("o_orderdate"), F.col("o_totalprice"), "day")


def embedding_draws(spark, sf_dir: str) -> DataFrame:
    """(series_id, draw, h, value): vectors as joint draws, their places as the horizon."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return v.select(F.col("label").cast("string").alias("series_id"), F.col("vec_id").alias("draw"), F.posexplode("embedding").alias("h", "value")).select("series_id", "draw", (F.col("h") + 1).cast("long").alias("h"), F.col("value").cast("double").alias("value"))


def price_chains(spark, sf_dir: str) -> DataFrame:
    """(param, chain, i, value): prices of line items as chains, by return flag and line number."""
    from pyspark.sql import Window

    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linenumber", "l_orderkey", "l_extendedprice")  # noqa: E741
    order = Window.partitionBy("l_returnflag", "l_linenumber").orderBy("l_orderkey", "l_extendedprice")
    return l.select(F.col("l_returnflag").alias("param"), F.col("l_linenumber").cast("int").alias("chain"), F.row_number().over(order).cast("long").alias("i"), F.col("l_extendedprice").cast("double").alias("value"))
