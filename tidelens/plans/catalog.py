"""Registry of the engine's queries and of the SQL that each must agree with.

Every query runs over whole tables. Doubles are rounded on both sides, as sums may be taken in any order.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelens.functions import columns as c
from tidelens.kernels import spec as ms
from tidelens.kernels.linalg import z_score
from tidelens.kernels.series import scenarios
from tidelens.operators import attribution, checks, draws, models
from tidelens.plans import workflows
from tidelens.sources import scratch, synthetic
from tidelens.sources import series as src
from tidelens.streaming import online

Q, R, P0, X0 = 400.0, 20000.0, 10000.0, 3300.0  # of the daily event series
PRE, POST = (1, 21), (22, 30)
Z05, Z01 = z_score(0.05), z_score(0.01)

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql.strip()
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, to) for n in names})


def settled(df: DataFrame, *names: str, to: int = 4) -> DataFrame:
    """rounded, for numbers that often lie half way between two: a little is added, so sums in any order round alike."""
    return df.withColumns({n: F.round(F.col(n) + 1e-8, to) for n in names})


# ---- inputs ------------------------------------------------------------------------------------------------------


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_series(spark, sf_dir).withColumn("y", F.round("y", 2))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series without every fifth day."""
    return daily(spark, sf_dir).withColumn("y", F.when(F.col("t") % 5 != 3, F.col("y")))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_series(spark, sf_dir, "hour").withColumn("y", F.round("y", 2))


def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series against their own running weekday-free mean, with a variance that moves with the hour."""
    h = hourly(spark, sf_dir).withColumn("y", F.coalesce("y", F.lit(0.0)))
    return h.select("series_id", "t", "y", (F.lit(140.0) + F.col("t") % 24).cast("double").alias("cf_mean"), (F.lit(100.0) + F.col("t") % 7).cast("double").alias("cf_var"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 2 to 6 hours from the hours whose sum is over 300, by series."""
    h = hourly(spark, sf_dir)
    h = h.crossJoin(F.broadcast(h.agg((F.max("t") + 1).alias("n"))))  # one row: the calendar's length
    w = h.filter("y > 300").select("series_id", F.concat(F.lit("s"), F.col("t").cast("string")).alias("spot_id"), F.col("t").alias("ws"), F.least(F.col("t") + 2 + F.col("t") % 5, F.col("n")).cast("long").alias("we"))
    return w


DAILY = """
WITH RECURSIVE d0 AS (SELECT event_type AS series_id, date_trunc('day', ts) AS ts, sum(value) AS y FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2),
e0 AS (SELECT min(ts) AS a, max(ts) AS b FROM d0),
c0 AS (SELECT i.series_id, unnest(generate_series(e0.a, e0.b, INTERVAL 1 DAY)) AS ts FROM (SELECT DISTINCT series_id FROM d0) i, e0),
s AS (SELECT c0.series_id, CAST(date_diff('day', e0.a, c0.ts) AS BIGINT) AS t, round(d0.y, 2) AS y FROM c0 JOIN e0 ON true LEFT JOIN d0 ON d0.series_id = c0.series_id AND d0.ts = c0.ts)"""
GAPPY = DAILY.replace("round(d0.y, 2) AS y", "CASE WHEN date_diff('day', e0.a, c0.ts) % 5 <> 3 THEN round(d0.y, 2) END AS y")
HOURLY = DAILY.replace("'day'", "'hour'").replace("1 DAY", "1 HOUR")
CF = HOURLY + """,
cf AS (SELECT series_id, t, coalesce(y, 0.0) AS y, CAST(140.0 + t % 24 AS DOUBLE) AS cf_mean, CAST(100.0 + t % 7 AS DOUBLE) AS cf_var FROM s),
w AS (SELECT series_id, 's' || t AS spot_id, t AS ws, CAST(least(t + 2 + t % 5, (SELECT max(t) + 1 FROM s)) AS BIGINT) AS we FROM s WHERE y > 300)"""


def _filter_sql(h: str = "1.0", x0: str = str(X0), q: float = Q, r: float = R, p0: float = P0) -> str:
    """A scalar filter as a recursive query: k(series_id, t, xp, pp, x, p)."""
    return f""",
i(series_id, t, x, p) AS (SELECT DISTINCT series_id, CAST(-1 AS BIGINT), CAST({x0} AS DOUBLE), CAST({p0} AS DOUBLE) FROM s),
k(series_id, t, xp, pp, x, p) AS (
  SELECT series_id, t, x, p, x, p FROM i
  UNION ALL
  SELECT k.series_id, s.t, k.x, k.p + {q},
         CASE WHEN s.y IS NULL THEN k.x ELSE k.x + (k.p + {q}) * ({h}) / (({h}) * (k.p + {q}) * ({h}) + {r}) * (s.y - ({h}) * k.x) END,
         CASE WHEN s.y IS NULL THEN k.p + {q} ELSE
           (1 - (k.p + {q}) * ({h}) / (({h}) * (k.p + {q}) * ({h}) + {r}) * ({h})) * (k.p + {q}) * (1 - (k.p + {q}) * ({h}) / (({h}) * (k.p + {q}) * ({h}) + {r}) * ({h}))
           + (k.p + {q}) * ({h}) / (({h}) * (k.p + {q}) * ({h}) + {r}) * {r} * (k.p + {q}) * ({h}) / (({h}) * (k.p + {q}) * ({h}) + {r}) END
  FROM k JOIN s ON s.series_id = k.series_id AND s.t = k.t + 1)"""


# ---- series and filters ------------------------------------------------------------------------------------------


@query(DAILY + " SELECT series_id, t, y FROM s")
def daily_series_densify(spark, sf_dir):
    return daily(spark, sf_dir).select("series_id", "t", "y")


@query(GAPPY + " SELECT series_id, coalesce(arg_min(y, t) FILTER (y IS NOT NULL), 0.0) AS first_obs, CAST(count(*) FILTER (y IS NULL) AS BIGINT) AS missing FROM s GROUP BY 1")
def first_obs(spark, sf_dir):
    df = gappy(spark, sf_dir)
    return models.first_observed(df).join(df.groupBy("series_id").agg(F.count_if(F.col("y").isNull()).alias("missing")), "series_id")


@query(GAPPY + _filter_sql() + " SELECT series_id, CAST(t + 1 AS BIGINT) AS n, round(x, 6) AS x, round(p, 6) AS p FROM k WHERE t = (SELECT max(t) FROM s)")
def kf_local_level_terminal(spark, sf_dir):
    return rounded(models.filter_terminal(gappy(spark, sf_dir), Q, R, P0, X0), "x", "p")


_PATH = " SELECT series_id, t, round(xp, 6) AS x_pred, round(pp, 6) AS p_pred, round(x, 6) AS x_filt, round(p, 6) AS p_filt FROM k WHERE t >= 0"


@query(DAILY + _filter_sql() + _PATH)
def kf_local_level_path(spark, sf_dir):
    return rounded(models.filter_path(daily(spark, sf_dir), q=Q, r=R, x0=X0, p0=P0), "x_pred", "p_pred", "x_filt", "p_filt")


@query(GAPPY + _filter_sql() + _PATH)
def kf_missing(spark, sf_dir):
    return rounded(models.filter_path(gappy(spark, sf_dir), q=Q, r=R, x0=X0, p0=P0), "x_pred", "p_pred", "x_filt", "p_filt")


@query(DAILY + _filter_sql("1.0 + 0.1 * (s.t % 3)") + _PATH)
def kf_time_varying_h(spark, sf_dir):
    return rounded(models.filter_path(daily(spark, sf_dir), h=lambda t: 1.0 + 0.1 * (t % 3), q=Q, r=R, x0=X0, p0=P0), "x_pred", "p_pred", "x_filt", "p_filt")


@query(GAPPY + _filter_sql() + f""",
f AS (SELECT series_id, t, x, p FROM k WHERE t >= 0),
b(series_id, t, x, p, lag1) AS (
  SELECT series_id, t, x, p, CAST(NULL AS DOUBLE) FROM f WHERE t = (SELECT max(t) FROM s)
  UNION ALL
  SELECT f.series_id, f.t, f.x + f.p / (f.p + {Q}) * (b.x - f.x), f.p + f.p / (f.p + {Q}) * (b.p - (f.p + {Q})) * f.p / (f.p + {Q}), b.p * f.p / (f.p + {Q})
  FROM b JOIN f ON f.series_id = b.series_id AND f.t = b.t - 1)
SELECT series_id, t, round(x, 6) AS x_smooth, round(p, 6) AS p_smooth, round(lag1, 6) AS lag1 FROM b""")
def rts_local_level(spark, sf_dir):
    return rounded(models.smooth_path(gappy(spark, sf_dir), q=Q, r=R, x0=X0, p0=P0), "x_smooth", "p_smooth", "lag1")


_LLT = {"var_level": 1e6, "var_slope": 1e3, "obs_var": 1e8, "initial_level": 1e5, "initial_cov_level": 1e8, "initial_cov_slope": 1e4}


@query(f"""
WITH RECURSIVE d0 AS (SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts, sum(o_totalprice) AS y FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1, 2),
e0 AS (SELECT min(ts) AS a, max(ts) AS b FROM d0),
c0 AS (SELECT i.series_id, unnest(generate_series(e0.a, e0.b, INTERVAL 1 DAY)) AS ts FROM (SELECT DISTINCT series_id FROM d0) i, e0),
s AS (SELECT c0.series_id, date_diff('day', e0.a, c0.ts) AS t, round(d0.y, 2) AS y FROM c0 JOIN e0 ON true LEFT JOIN d0 ON d0.series_id = c0.series_id AND d0.ts = c0.ts),
k(series_id, t, l, b, p11, p12, p22) AS (
  SELECT DISTINCT series_id, CAST(-1 AS BIGINT), CAST(1e5 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1e8 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1e4 AS DOUBLE) FROM s
  UNION ALL
  SELECT series_id, t,
    CASE WHEN y IS NULL THEN lp ELSE lp + a11 / (a11 + 1e8) * (y - lp) END,
    CASE WHEN y IS NULL THEN b ELSE b + a12 / (a11 + 1e8) * (y - lp) END,
    CASE WHEN y IS NULL THEN a11 ELSE a11 * 1e8 / (a11 + 1e8) END,
    CASE WHEN y IS NULL THEN a12 ELSE a12 * 1e8 / (a11 + 1e8) END,
    CASE WHEN y IS NULL THEN a22 ELSE a22 - a12 * a12 / (a11 + 1e8) END
  FROM (SELECT k.series_id, s.t, s.y, k.l + k.b AS lp, k.b, k.p11 + 2 * k.p12 + k.p22 + 1e6 AS a11, k.p12 + k.p22 AS a12, k.p22 + 1e3 AS a22 FROM k JOIN s ON s.series_id = k.series_id AND s.t = k.t + 1)),
z AS (SELECT * FROM k WHERE t = (SELECT max(t) FROM s)),
f(series_id, h, l, b, p11, p12, p22) AS (
  SELECT series_id, CAST(0 AS BIGINT), l, b, p11, p12, p22 FROM z
  UNION ALL SELECT series_id, h + 1, l + b, b, p11 + 2 * p12 + p22 + 1e6, p12 + p22, p22 + 1e3 FROM f WHERE h < 7)
SELECT series_id, h, round(l, 1) AS mean, round(sqrt(p11 + 1e8), 1) AS sd FROM f WHERE h > 0""")
def llt_forecast(spark, sf_dir):
    s = src.order_series(spark, sf_dir).withColumn("y", F.round("y", 2))
    got = models.forecast_fixed(s, ms.local_linear_trend(**_LLT), 7)
    return got.select("series_id", "h", F.round("mean", 1).alias("mean"), F.round(F.sqrt("variance"), 1).alias("sd"))


# ---- impact with fixed variances ---------------------------------------------------------------------------------

_FIRST = "(SELECT z.y FROM s z WHERE z.series_id = s.series_id AND z.t = 0)"
_IMPACT = DAILY + _filter_sql(x0=_FIRST) + f""",
e AS (SELECT series_id, x, p FROM k WHERE t = {PRE[1] - 1}),
a AS (SELECT s.series_id, s.t, s.y, e.x, e.p, s.y - e.x AS effect, sqrt(e.p + (s.t - {POST[0] - 1} + 1) * {Q} + {R}) AS sd FROM s JOIN e ON e.series_id = s.series_id WHERE s.t BETWEEN {POST[0] - 1} AND {POST[1] - 1})"""
_N = POST[1] - POST[0] + 1
_TOTAL = f", g AS (SELECT series_id, sum(effect) AS effect, sum(x) AS base, sqrt({_N * _N}.0 * any_value(p) + {Q} * {_N} * {_N + 1} * {2 * _N + 1} / 6.0 + {_N} * {R}) AS sd FROM a GROUP BY 1)"


@query(_IMPACT + f" SELECT series_id, t, y, round(x, 6) AS baseline, round(effect, 6) AS effect, round(sd, 6) AS sd, round(effect - {Z05} * sd, 6) AS lower, round(effect + {Z05} * sd, 6) AS upper FROM a")
def operational_impact_point(spark, sf_dir):
    return rounded(models.local_level_impact(daily(spark, sf_dir), PRE, POST, Q, R, P0)["point"], "baseline", "effect", "sd", "lower", "upper")


@query(_IMPACT + _TOTAL + f" SELECT series_id, round(effect, 6) AS effect, round(sd, 6) AS sd, round(effect - {Z05} * sd, 6) AS lower, round(effect + {Z05} * sd, 6) AS upper FROM g")
def operational_impact_cumulative(spark, sf_dir):
    return rounded(models.local_level_impact(daily(spark, sf_dir), PRE, POST, Q, R, P0)["cumulative"], "effect", "sd", "lower", "upper")


@query(_IMPACT + _TOTAL + f" SELECT series_id, round(effect / base, 8) AS effect, round(sd / abs(base), 8) AS sd, round(effect / base - {Z05} * sd / abs(base), 8) AS lower, round(effect / base + {Z05} * sd / abs(base), 8) AS upper FROM g")
def operational_impact_relative(spark, sf_dir):
    return rounded(models.local_level_impact(daily(spark, sf_dir), PRE, POST, Q, R, P0)["relative"], "effect", "sd", "lower", "upper", to=8)


@query(DAILY + _filter_sql() + f""",
e AS (SELECT series_id, x, p FROM k WHERE t = {PRE[1] - 1}),
g AS (SELECT e.series_id, sum(s.y - e.x) AS total, sqrt({_N * _N}.0 * any_value(p) + {Q} * {_N} * {_N + 1} * {2 * _N + 1} / 6.0 + {_N} * {R}) AS sd FROM s JOIN e ON e.series_id = s.series_id WHERE s.t BETWEEN {POST[0] - 1} AND {POST[1] - 1} GROUP BY 1)
SELECT series_id, round(total, 5) AS cumulative, round(sd, 5) AS cumulative_sd, (total - {Z05} * sd > 0) OR (total + {Z05} * sd < 0) AS significant FROM g""")
def intervention_operational(spark, sf_dir):
    spec = ms.local_level(Q, R, X0, P0)
    got = workflows.analyze(daily(spark, sf_dir), PRE, POST, mode="operational", model_spec=spec)["cumulative"]
    return got.select("series_id", F.round("mean", 5).alias("cumulative"), F.round("sd", 5).alias("cumulative_sd"), "significant")


@query(DAILY + f"""
SELECT series_id, round(avg(y) FILTER (t BETWEEN {PRE[0] - 1} AND {PRE[1] - 1}), 6) AS baseline_mean, round(avg(y) FILTER (t BETWEEN {POST[0] - 1} AND {POST[1] - 1}), 6) AS actual_mean FROM s GROUP BY 1""")
def campaign_means(spark, sf_dir):
    spec = ms.local_level(Q, R, X0, P0)
    got = workflows.campaign_lift(daily(spark, sf_dir), {"name": "c", "start_index": POST[0], "end_index": POST[1], "baseline_start": PRE[0], "baseline_end": PRE[1]}, mode="operational", model_spec=spec)
    return got.select("series_id", F.round("baseline_mean", 6).alias("baseline_mean"), F.round("actual_mean", 6).alias("actual_mean"))


_EFFECT = DAILY + _filter_sql() + f""",
k0 AS (SELECT series_id, x, p FROM k WHERE t = {PRE[1] - 1}),
g AS (SELECT k0.series_id, sum(s.y - x) AS total, sum(x) AS base, sqrt({_N * _N}.0 * any_value(p) + {Q} * {_N} * {_N + 1} * {2 * _N + 1} / 6.0 + {_N} * {R}) AS sd FROM s JOIN k0 ON k0.series_id = s.series_id WHERE s.t BETWEEN {POST[0] - 1} AND {POST[1] - 1} GROUP BY 1),
m AS (SELECT series_id, avg(y) FILTER (t BETWEEN {PRE[0] - 1} AND {PRE[1] - 1}) AS baseline_mean, avg(y) FILTER (t BETWEEN {POST[0] - 1} AND {POST[1] - 1}) AS actual_mean FROM s GROUP BY 1)"""
_TOTALS = f"round(total, 5) AS cumulative, round(sd, 5) AS cumulative_sd, round(total - {Z05} * sd, 5) AS cumulative_lower, round(total + {Z05} * sd, 5) AS cumulative_upper, (total - {Z05} * sd > 0) OR (total + {Z05} * sd < 0) AS significant, round(total / {_N}, 6) AS per_period, round(sd / {_N}, 6) AS per_period_sd"
_NUMBERS = ("cumulative", "cumulative_sd", "cumulative_lower", "cumulative_upper")


@query(_EFFECT + f" SELECT g.series_id, {_TOTALS}, round(total / base, 8) AS relative, round(sd / abs(base), 8) AS relative_sd FROM g")
def policy_operational(spark, sf_dir):
    got = workflows.policy_effect(daily(spark, sf_dir), PRE[0], POST[0] - 2, POST[1], lag=2, mode="operational", model_spec=ms.local_level(Q, R, X0, P0))
    return rounded(rounded(rounded(got, *_NUMBERS, to=5), "per_period", "per_period_sd"), "relative", "relative_sd", to=8)


@query(_EFFECT + f" SELECT g.series_id, 'c' AS campaign, {_TOTALS}, round(total / (baseline_mean * {_N}), 8) AS relative, round(sd / abs(baseline_mean * {_N}), 8) AS relative_sd, round(baseline_mean, 6) AS baseline_mean, round(actual_mean, 6) AS actual_mean FROM g JOIN m ON m.series_id = g.series_id")
def campaign_lift_by_date(spark, sf_dir):
    """A campaign given by dates of the calendar of the events, measured from one end to the other."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type IS NOT NULL AND ts IS NOT NULL")
    first = events.agg(F.min(F.to_date("ts")).alias("d")).first()["d"]
    days = spark.range(POST[1]).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))
    on = lambda step: first + datetime.timedelta(days=step - 1)
    campaign = {"name": "c", "start_date": on(POST[0]), "end_date": on(POST[1]), "baseline_start_date": on(PRE[0]), "baseline_end_date": on(PRE[1])}
    got = workflows.campaign_lift_by_date(daily(spark, sf_dir), days, campaign, mode="operational", model_spec=ms.local_level(Q, R, X0, P0))
    return rounded(rounded(rounded(got, *_NUMBERS, to=5), "per_period", "per_period_sd", "baseline_mean", "actual_mean"), "relative", "relative_sd", to=8)


@query(_EFFECT.replace(f"BETWEEN {POST[0] - 1} AND {POST[1] - 1} GROUP BY 1),", f"BETWEEN {POST[0] - 1} AND {POST[1] - 1} GROUP BY 1),\nj AS (SELECT k0.series_id, sum(s.y - x) AS total, sqrt(16.0 * any_value(p) + {Q} * 4 * 5 * 9 / 6.0 + 4 * {R}) AS sd FROM s JOIN k0 ON k0.series_id = s.series_id WHERE s.t BETWEEN 21 AND 24 GROUP BY 1),\nj2 AS (SELECT k0.series_id, sum(s.y - x) AS total, sqrt(9.0 * (any_value(p) + 5 * {Q}) + {Q} * 3 * 4 * 7 / 6.0 + 3 * {R}) AS sd FROM s JOIN k0 ON k0.series_id = s.series_id WHERE s.t BETWEEN 26 AND 28 GROUP BY 1),") + " SELECT j.series_id, round(j.total + j2.total, 4) AS total_lift, round(sqrt(j.sd * j.sd + j2.sd * j2.sd), 4) AS total_lift_sd FROM j JOIN j2 ON j2.series_id = j.series_id")
def campaigns_total(spark, sf_dir):
    """Two campaigns apart from each other, measured against the same baseline."""
    own = [{"name": "x", "start_index": 22, "end_index": 25, "baseline_start": 1, "baseline_end": 21}, {"name": "y", "start_index": 27, "end_index": 29, "baseline_start": 1, "baseline_end": 21}]
    got = workflows.campaigns_lift(daily(spark, sf_dir), own, mode="operational", model_spec=ms.local_level(Q, R, X0, P0))
    return rounded(workflows.campaigns_total(got), "total_lift", "total_lift_sd", to=4)


@query(DAILY + """
SELECT a.series_id, b.series_id AS control_id, round(m.mean, 6) AS control_mean, round(avg(a.y - b.y), 6) AS mean_difference
FROM s a JOIN s b ON b.t = a.t AND b.series_id <> a.series_id JOIN (SELECT series_id, avg(y) AS mean FROM s WHERE t < 20 GROUP BY 1) m ON m.series_id = b.series_id WHERE a.t < 20 AND a.series_id = 'click' GROUP BY a.series_id, b.series_id, m.mean""")
def pretrend_controls(spark, sf_dir):
    d = daily(spark, sf_dir)
    controls = d.filter("series_id <> 'click'").select(F.col("series_id").alias("control_id"), "t", "y")
    return rounded(workflows.pre_trend_controls(d.filter("series_id = 'click'"), controls, 1, 21), "control_mean", "mean_difference")


@query("""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), i AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS BIGINT) AS i FROM d),
c AS (SELECT min(date) AS a, max(date) AS z FROM d)
SELECT 'all' AS name, s.i AS start_index, e.i AS end_index, b.i AS baseline_start_index, f.i AS baseline_end_index FROM c JOIN i s ON s.date = c.z JOIN i e ON e.date = c.z JOIN i b ON b.date = c.a JOIN i f ON f.date = c.a""")
def marketing_lift_date_lookup(spark, sf_dir):
    dates = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("date"))
    ends = dates.agg(F.min("date").alias("a"), F.max("date").alias("z"))
    campaigns = ends.select(F.lit("all").alias("name"), F.col("z").alias("start_date"), F.col("z").alias("end_date"), F.col("a").alias("baseline_start_date"), F.col("a").alias("baseline_end_date"))
    return workflows.campaign_indices(dates, campaigns).select("name", "start_index", "end_index", "baseline_start_index", "baseline_end_index")


# ---- attribution -------------------------------------------------------------------------------------------------

_GROUPS = """,
o AS (SELECT *, CASE WHEN max(we) OVER v IS NULL OR ws >= max(we) OVER v THEN 1 ELSE 0 END AS fresh FROM w WINDOW v AS (PARTITION BY series_id ORDER BY ws, we, spot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT series_id, spot_id, ws, we, CAST(sum(fresh) OVER (PARTITION BY series_id ORDER BY ws, we, spot_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS group_id FROM o)"""


@query(CF + _GROUPS + " SELECT * FROM g")
def overlap_groups(spark, sf_dir):
    return attribution.overlap_groups(windows(spark, sf_dir))


@query(CF + " SELECT w.series_id, spot_id, ws, we, round(sum(y - cf_mean), 4) AS lift, round(sum(cf_var + 0.5), 4) AS variance FROM w JOIN cf ON cf.series_id = w.series_id AND t >= ws AND t < we GROUP BY ALL")
def window_lift(spark, sf_dir):
    return rounded(attribution.window_lift(counterfactual(spark, sf_dir), windows(spark, sf_dir), 0.5), "lift", "variance", to=4)


_UNION = _GROUPS + ", u AS (SELECT series_id, group_id, round(sum(y - cf_mean), 4) AS lift, round(sum(cf_var + 0.5), 4) AS variance FROM (SELECT DISTINCT g.series_id, group_id, t, y, cf_mean, cf_var FROM g JOIN cf ON cf.series_id = g.series_id AND t >= ws AND t < we) GROUP BY ALL)"


@query(CF + _UNION + " SELECT * FROM u")
def coalition_lift(spark, sf_dir):
    grouped = attribution.overlap_groups(windows(spark, sf_dir))
    return rounded(attribution.union_lift(counterfactual(spark, sf_dir), grouped, ["group_id"], 0.5), "lift", "variance", to=4)


@query(CF + _UNION + " SELECT series_id, round(sum(lift), 3) AS total_lift FROM u GROUP BY 1")
def attribution_total(spark, sf_dir):
    got = attribution.attribute(counterfactual(spark, sf_dir), windows(spark, sf_dir), 0.5)
    return attribution.totals(got).select("series_id", F.round("total_lift", 3).alias("total_lift"))


#: erf by a series of positive terms, as DuckDB has none.
_ERF = "(CASE WHEN abs({x}) > 5.9 THEN sign({x}) ELSE sign({x}) * 2 / sqrt(pi()) * list_sum(list_transform(generate_series(0, 120), lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln(greatest(abs({x}), 1e-300)) + lgamma(n + 1) - lgamma(2 * n + 2) - {x} * {x}))) END)"


def _attributed_sql(obs: float) -> str:
    """Shares of the groups g over the counterfactual cf, with an observation variance."""
    return f""",
z AS (SELECT series_id, group_id, count(*) AS n FROM g GROUP BY 1, 2),
c AS (SELECT g.series_id, group_id, t, any_value(y - cf_mean) AS d, any_value(cf_var + {obs}) AS v, count(*) AS k FROM g JOIN cf ON cf.series_id = g.series_id AND t >= ws AND t < we GROUP BY 1, 2, 3),
u AS (SELECT series_id, group_id, sum(d) AS total, sum(v) AS var FROM c GROUP BY 1, 2),
x AS (SELECT g.*, z.n, sum(c.d) AS own, sum(c.d / c.k) AS shared FROM g JOIN z ON z.series_id = g.series_id AND z.group_id = g.group_id JOIN c ON c.series_id = g.series_id AND c.group_id = g.group_id AND c.t >= ws AND c.t < we GROUP BY ALL),
r AS (SELECT *, round(abs(own), 6) AS m, row_number() OVER (PARTITION BY series_id, group_id ORDER BY abs(own) DESC, spot_id) - 1 AS k FROM x),
q AS (SELECT *, (1 - pow(0.7, k + 1)) / 0.3 / (k + 1) AS added, CASE WHEN k = 0 THEN 0 ELSE -((1 - pow(0.7, k)) / k - (1 - pow(0.7, k + 1)) / (k + 1)) / 0.3 END AS pushed, k - min(k) OVER (PARTITION BY series_id, group_id, m) AS place FROM r),
e AS (SELECT series_id, group_id, m, count(*) AS ties, sum(own) AS s, avg(added) AS added, avg(pushed) AS pushed, sum(place * pushed) / greatest(count(*) * (count(*) - 1), 1) AS inside FROM q GROUP BY 1, 2, 3),
a AS (SELECT *, coalesce(sum(s * pushed) OVER (PARTITION BY series_id, group_id ORDER BY m DESC ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after FROM e),
p AS (SELECT q.series_id, q.group_id, spot_id, ws, we, n, CASE WHEN n <= 6 THEN shared ELSE own * a.added + after + (s - own) * inside END AS share FROM q JOIN a ON a.series_id = q.series_id AND a.group_id = q.group_id AND a.m = q.m),
f AS (SELECT *, sum(share) OVER o AS now FROM p WINDOW o AS (PARTITION BY series_id, group_id)),
h AS (SELECT f.series_id, f.group_id, spot_id, ws, we, n, var, CASE WHEN n = 1 THEN share WHEN abs(now) < 1e-10 THEN total / n ELSE total * share / now END AS lift FROM f JOIN u ON u.series_id = f.series_id AND u.group_id = f.group_id),
b AS (SELECT *, sqrt(CASE WHEN size > 1e-15 THEN var * abs(lift) / size ELSE var / n END) AS sd FROM (SELECT *, sum(abs(lift)) OVER (PARTITION BY series_id, group_id) AS size FROM h))
SELECT series_id, spot_id, ws, we, group_id, round(lift, 4) AS lift, round(sd, 4) AS lift_sd, round(lift - {Z05} * sd, 4) AS lift_lower, round(lift + {Z05} * sd, 4) AS lift_upper,
       round(CASE WHEN sd = 0 THEN CASE WHEN lift > 0 THEN 1.0 WHEN lift < 0 THEN 0.0 ELSE 0.5 END ELSE 0.5 + 0.5 * {_ERF.format(x="(lift / sd / sqrt(2))")} END, 6) AS p_positive FROM b"""


@query(CF + _GROUPS + _attributed_sql(0.5))
def attribution_spots(spark, sf_dir):
    got = attribution.attribute(counterfactual(spark, sf_dir), windows(spark, sf_dir), 0.5)
    return rounded(got, "lift", "lift_sd", "lift_lower", "lift_upper", to=4).withColumn("p_positive", F.round("p_positive", 6))


@query("""
WITH RECURSIVE p AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS i, n_regionkey, CAST(n_nationkey * n_nationkey % 17 + 1 AS DOUBLE) AS w, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation),
m AS (SELECT CAST(range AS BIGINT) AS mask FROM range(32)),
v AS (SELECT n_regionkey AS group_id, mask, sqrt(coalesce(sum(w * w) FILTER ((mask >> CAST(k AS INTEGER)) & 1 = 1), 0)) AS value FROM p, m GROUP BY ALL),
b AS (SELECT CAST(range AS INTEGER) AS player FROM range(5))
SELECT CAST(a.group_id AS BIGINT) AS group_id, player, round(sum((c.value - a.value) * CASE bit_count(a.mask) WHEN 0 THEN 0.2 WHEN 1 THEN 0.05 WHEN 2 THEN 4.0 / 120 WHEN 3 THEN 0.05 ELSE 0.2 END), 8) AS share
FROM v a JOIN b ON (a.mask >> player) & 1 = 0 JOIN v c ON c.group_id = a.group_id AND c.mask = (a.mask | (1 << player)) GROUP BY ALL""")
def shapley_exact(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    own = n.select(F.col("n_regionkey").cast("long").alias("group_id"), ((F.col("n_nationkey") * F.col("n_nationkey")) % 17 + 1).cast("double").alias("w"), (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).alias("k"))
    masks = spark.range(32).select(F.col("id").alias("mask"))
    # 25 rows by 32 coalitions: the lattice of a table of fixed size.
    on = F.when(F.expr("shiftright(mask, k)").bitwiseAND(1) == 1, F.col("w") * F.col("w")).otherwise(F.lit(0.0))
    worth = own.crossJoin(F.broadcast(masks)).groupBy("group_id", "mask").agg(F.sqrt(F.sum(on)).alias("value"))
    return rounded(attribution.shapley_exact(worth, 5), "share", to=8)


_SPOTLIFT = CF + _GROUPS + ", x AS (SELECT g.series_id, group_id, spot_id, ws, round(sum(y - cf_mean), 4) AS lift FROM g JOIN cf ON cf.series_id = g.series_id AND t >= ws AND t < we GROUP BY ALL)"


def _spot_lifts(spark, sf_dir) -> DataFrame:
    grouped = attribution.overlap_groups(windows(spark, sf_dir))
    lifts = attribution.window_lift(counterfactual(spark, sf_dir), windows(spark, sf_dir)).select("series_id", "spot_id", F.round("lift", 4).alias("lift"))
    return grouped.join(lifts, ["series_id", "spot_id"]).withColumn("group", F.concat_ws("/", "series_id", F.col("group_id").cast("string")))


@query(_SPOTLIFT + """
SELECT "group", round(sum(lift * w), 4) AS value FROM (
  SELECT series_id || '/' || group_id AS "group", lift, avg(pow(0.7, r)) OVER (PARTITION BY series_id, group_id, abs(lift)) AS w FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id, group_id ORDER BY abs(lift) DESC) - 1 AS r FROM x)) GROUP BY 1""")
def rank_decay_value(spark, sf_dir):
    return rounded(attribution.rank_decay_value(_spot_lifts(spark, sf_dir), "group", "lift"), "value", to=4)


@query(_SPOTLIFT + """
SELECT "group", round(sum(lift * exp(-ln(2) / 7 * (last - ws))), 4) AS value FROM (SELECT series_id || '/' || group_id AS "group", lift, ws, max(ws) OVER (PARTITION BY series_id, group_id) AS last FROM x) GROUP BY 1""")
def time_decay_value(spark, sf_dir):
    return rounded(attribution.time_decay_value(_spot_lifts(spark, sf_dir), "group", "lift", "ws"), "value", to=4)


@query(_SPOTLIFT + """
SELECT series_id, spot_id, round(CASE WHEN abs(s) < 1e-10 THEN 100.0 / n ELSE lift * 100.0 / s END, 4) AS normalized FROM (SELECT *, sum(lift) OVER v AS s, count(*) OVER v AS n FROM x WINDOW v AS (PARTITION BY series_id, group_id))""")
def normalize_total(spark, sf_dir):
    lifts = _spot_lifts(spark, sf_dir).withColumn("total", F.lit(100.0))
    return attribution.normalize_to_total(lifts, "group", "lift", "total").select("series_id", "spot_id", F.round("normalized", 4).alias("normalized"))


# ---- draws -------------------------------------------------------------------------------------------------------

DRAWS = """
WITH v AS (SELECT CAST(label AS VARCHAR) AS series_id, vec_id AS draw, CAST(unnest(generate_series(1, len(embedding))) AS BIGINT) AS h, unnest(embedding)::DOUBLE AS value FROM embeddings),
l AS (SELECT series_id, h, list_sort(list(value)) AS a, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS q0, quantile_cont(value, 0.975) AS q1 FROM v GROUP BY 1, 2)"""


@query(DRAWS + " SELECT series_id, h, round(mean, 8) AS mean, round(sd, 8) AS sd, round(q0, 8) AS lower, round(q1, 8) AS upper FROM l")
def draw_summary_linear(spark, sf_dir):
    return rounded(draws.summary_interpolated(src.embedding_draws(spark, sf_dir)), "mean", "sd", "lower", "upper", to=8)


@query(DRAWS + " SELECT series_id, h, round(mean, 8) AS mean, round(sd, 8) AS sd, a[CAST(floor(0.025 * (len(a) - 1)) AS BIGINT) + 1] AS lower, a[CAST(ceil(0.975 * (len(a) - 1)) AS BIGINT) + 1] AS upper FROM l")
def draw_summary_outward(spark, sf_dir):
    return rounded(draws.summary_outward(src.embedding_draws(spark, sf_dir)), "mean", "sd", to=8)


@query(DRAWS + " SELECT series_id, h, round(mean, 8) AS mean, round(sd, 8) AS sd, a[CAST(floor(0.5 * (len(a) - 1) + 0.5) AS BIGINT) + 1] AS median, a[CAST(floor(0.025 * (len(a) - 1) + 0.5) AS BIGINT) + 1] AS lower, a[CAST(floor(0.975 * (len(a) - 1) + 0.5) AS BIGINT) + 1] AS upper FROM l")
def draw_nearest_rank(spark, sf_dir):
    return rounded(draws.summary_nearest(src.embedding_draws(spark, sf_dir)), "mean", "sd", to=8)


@query(DRAWS + """,
k AS (SELECT series_id, h, a, least(greatest(CAST(ceil(0.95 * len(a)) AS BIGINT), 1), len(a)) AS k FROM l),
r AS (SELECT series_id, h, a, k, unnest(generate_series(1, len(a) - k + 1)) AS i FROM k),
m AS (SELECT series_id, h, arg_min(i, (a[i + k - 1] - a[i], a[i])) AS i, any_value(a) AS a, any_value(k) AS k FROM r GROUP BY 1, 2)
SELECT series_id, h, a[i] AS lower, a[i + k - 1] AS upper FROM m""")
def hpd(spark, sf_dir):
    return draws.hpd(src.embedding_draws(spark, sf_dir))


@query(DRAWS + " SELECT series_id, h, round(avg(CASE WHEN value < 0.05 THEN 1.0 ELSE 0.0 END), 8) AS probability_below, round(avg(greatest(0.05 - value, 0.0)), 8) AS expected_shortfall, round(coalesce(avg(0.05 - value) FILTER (value < 0.05), 0.0), 8) AS conditional_shortfall FROM v GROUP BY 1, 2")
def threshold_risk(spark, sf_dir):
    return rounded(draws.risk(src.embedding_draws(spark, sf_dir), 0.05), "probability_below", "expected_shortfall", "conditional_shortfall", to=8)


def _weights(spark) -> DataFrame:
    return spark.range(1, 65).select(F.col("id").alias("h"), (F.lit(1.0) / F.col("id")).alias("weight"))


@query(DRAWS + " SELECT series_id, draw, CAST(1 AS BIGINT) AS h, round(sum(value / h), 8) AS value FROM v GROUP BY 1, 2")
def weighted_sum(spark, sf_dir):
    return rounded(draws.weighted_sum(src.embedding_draws(spark, sf_dir), _weights(spark)), "value", to=8)


@query(DRAWS + " SELECT series_id, draw, h, round(value * (value * value + 1.0) * 3.0, 8) AS value FROM v")
def combine_product(spark, sf_dir):
    d = src.embedding_draws(spark, sf_dir)
    return rounded(draws.audience(d, draws.mapped(d, lambda v: v * v + 1.0), 3.0), "value", to=8)


@query(DRAWS + " SELECT series_id, draw, h, round(value * (value + 2.0) * 10.0 * h, 8) AS value FROM v")
def audience_by_step(spark, sf_dir):
    d = src.embedding_draws(spark, sf_dir)
    universe = spark.range(1, 65).select(F.col("id").alias("h"), (F.col("id") * 10.0).alias("value"))
    return rounded(draws.from_hut_share(d, draws.mapped(d, lambda v: v + 2.0), universe), "value", to=8)


@query("""
WITH e AS (SELECT CAST(label AS VARCHAR) AS series_id, vec_id AS draw, embedding[1]::DOUBLE AS x FROM embeddings)
SELECT series_id, 0 AS chain, draw, CAST(h AS BIGINT) AS h, round(x, 8) AS value FROM e, (SELECT unnest(generate_series(1, 5)) AS h)""")
def predict_from_kept_fit(spark, sf_dir):
    """Paths of a kept fit whose variances are 0: each stays where its draw's state is."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("string").alias("series_id"), F.lit(0).alias("chain"), F.col("vec_id").alias("draw"), F.lit(0.0).alias("obs_var"), F.array(F.lit(0.0)).alias("q"), F.slice(F.col("embedding").cast("array<double>"), 1, 1).alias("x_last"))
    return rounded(models.predict_draws(e, 5), "value", to=8)


@query(DRAWS + """,
d AS (SELECT series_id, draw, sum(value / h) AS value FROM v GROUP BY 1, 2),
a AS (SELECT series_id, list_sort(list(value)) AS a, avg(value) AS mean, avg(CASE WHEN value < 0.1 THEN 1.0 ELSE 0.0 END) AS p, avg(greatest(0.1 - value, 0.0)) AS s, coalesce(avg(0.1 - value) FILTER (value < 0.1), 0.0) AS c FROM d GROUP BY 1)
SELECT series_id, round(mean, 8) AS mean, round(a[CAST(floor(0.1 * (len(a) - 1) + 0.5) AS BIGINT) + 1], 8) AS conservative, round(p, 8) AS probability_below, round(s, 8) AS expected_shortfall, round(c, 8) AS conditional_shortfall, round(s / 0.01, 6) AS makegood_units FROM a""")
def makegood_risk(spark, sf_dir):
    got = draws.makegood_units(draws.makegood(src.embedding_draws(spark, sf_dir), _weights(spark), 0.1), 0.01)
    got = rounded(got, "mean", "conservative", "probability_below", "expected_shortfall", "conditional_shortfall", to=8)
    return got.select("series_id", "mean", "conservative", "probability_below", "expected_shortfall", "conditional_shortfall", F.round("makegood_units", 6).alias("makegood_units"))


@query(DRAWS + f" SELECT series_id, h, round(greatest({z_score(0.1)} * sd, 0.0), 8) AS per_period, round({z_score(0.1)} * sqrt(sum(CASE WHEN h <= 5 THEN sd * sd ELSE 0 END) OVER (PARTITION BY series_id)), 8) AS total FROM l")
def safety_stock(spark, sf_dir):
    f = draws.summary_interpolated(src.embedding_draws(spark, sf_dir)).select("series_id", "h", "sd")
    return rounded(draws.safety_stock(f, 0.95, 5), "per_period", "total", to=8)


# ---- validation --------------------------------------------------------------------------------------------------

PAIRS = DAILY + ", b AS (SELECT series_id, t, y AS actual, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS baseline FROM s), p AS (SELECT *, actual - baseline AS residual, CAST(1000.0 + t AS DOUBLE) AS variance FROM b WHERE actual IS NOT NULL AND baseline IS NOT NULL)"


def _pairs(spark, sf_dir) -> DataFrame:
    d = daily(spark, sf_dir)
    lagged = d.select("series_id", "t", F.col("y").alias("actual"), F.lag("y").over(Window.partitionBy("series_id").orderBy("t")).alias("baseline"))
    return lagged.filter("actual IS NOT NULL AND baseline IS NOT NULL").withColumn("residual", F.col("actual") - F.col("baseline")).withColumn("variance", (F.lit(1000.0) + F.col("t")).cast("double"))


@query(PAIRS + " SELECT series_id, round(sqrt(avg(residual * residual)), 6) AS rmse, round(avg(abs(residual) / greatest(abs(actual), 1.0)), 8) AS mape, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1")
def prediction_error(spark, sf_dir):
    got = checks.prediction_error(_pairs(spark, sf_dir))
    return got.select("series_id", F.round("rmse", 6).alias("rmse"), F.round("mape", 8).alias("mape"), "n")


@query(PAIRS + f" SELECT series_id, round(avg(CASE WHEN abs(residual) <= {Z05} * sqrt(variance + {R}) THEN 1.0 ELSE 0.0 END), 8) AS pct, CAST(count(*) FILTER (abs(residual) <= {Z05} * sqrt(variance + {R})) AS BIGINT) AS n_covered, CAST(count(*) AS BIGINT) AS n_total FROM p GROUP BY 1")
def ci_coverage(spark, sf_dir):
    return rounded(checks.coverage(_pairs(spark, sf_dir), R), "pct", to=8)


@query(PAIRS + " SELECT series_id, round(CASE WHEN count(*) < 3 THEN NULL WHEN sum(residual * residual) > 0 THEN sum(d * d) / sum(residual * residual) ELSE 2.0 END, 8) AS statistic, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, residual - lag(residual) OVER (PARTITION BY series_id ORDER BY t) AS d FROM p) GROUP BY 1")
def durbin_watson(spark, sf_dir):
    return rounded(checks.durbin_watson(_pairs(spark, sf_dir)), "statistic", to=8)


_ASSESS = PAIRS + f""",
m AS (SELECT series_id, avg(abs(residual) / greatest(abs(actual), 1.0)) AS mape, avg(CASE WHEN abs(residual) <= {Z05} * sqrt(variance + {R}) THEN 1.0 ELSE 0.0 END) AS pct, sum(d * d) / sum(residual * residual) AS dw
  FROM (SELECT *, residual - lag(residual) OVER (PARTITION BY series_id ORDER BY t) AS d FROM p) GROUP BY 1)
SELECT series_id, CASE WHEN mape <= 0.1 THEN 'pass' WHEN mape <= 0.2 THEN 'warn' ELSE 'fail' END AS prediction_error,
  CASE WHEN pct BETWEEN 0.85 AND 0.99 THEN 'pass' WHEN pct BETWEEN 0.8 AND 1.0 THEN 'warn' ELSE 'fail' END AS coverage,
  CASE WHEN dw BETWEEN 1.5 AND 2.5 THEN 'pass' WHEN dw BETWEEN 1.0 AND 3.0 THEN 'warn' ELSE 'fail' END AS durbin_watson, 'skip' AS placebo, 'skip' AS effect_stability FROM m"""


@query(_ASSESS)
def validation_verdicts(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    both = checks.prediction_error(p).drop("n").join(checks.coverage(p, R), "series_id").join(checks.durbin_watson(p).drop("n"), "series_id")
    none = {"placebo_significant": F.lit(None).cast("boolean"), "placebo_pct": F.lit(None).cast("double"), "max_pct_change": F.lit(None).cast("double")}
    return checks.assess(both.withColumns(none))


@query(DAILY + ", o AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM s WHERE t < 24) SELECT series_id, t FROM o WHERE i >= n // 2 - 3 AND i < n // 2 - 3 + 6")
def placebo_window(spark, sf_dir):
    d = daily(spark, sf_dir).select("series_id", "t")
    return checks.placebo_window(d, d.filter("t >= 24"))


def _mean_lift_sql(window: str, steps: str = "s") -> str:
    """lift, lift_pct and sd over the steps of a window (series_id, t) against the mean of the others."""
    return f"""SELECT series_id, total - k * mean AS lift, 100 * (total - k * mean) / (k * mean) AS pct, sqrt(v * (k + k * k / n)) AS sd FROM (
  SELECT x.series_id, sum(y) FILTER (w.t IS NOT NULL) AS total, count(*) FILTER (w.t IS NOT NULL) AS k, avg(y) FILTER (w.t IS NULL) AS mean, var_samp(y) FILTER (w.t IS NULL) AS v, count(*) FILTER (w.t IS NULL) AS n
  FROM (SELECT * FROM {steps} WHERE y IS NOT NULL) x LEFT JOIN {window} w ON w.series_id = x.series_id AND w.t = x.t GROUP BY 1)"""


@query(DAILY + f""", off AS (SELECT * FROM s WHERE t < 24),
o AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM off),
f AS (SELECT series_id, t FROM o WHERE i >= n // 2 - 3 AND i < n // 2 - 3 + 6), e AS ({_mean_lift_sql("f", "off")})
SELECT series_id, round(lift + 1e-8, 4) AS lift, round(pct, 6) AS lift_pct, round(sd + 1e-8, 4) AS sd, round(lift - {Z05} * sd + 1e-8, 4) AS lower, round(lift + {Z05} * sd + 1e-8, 4) AS upper, lift - {Z05} * sd > 0 OR lift + {Z05} * sd < 0 AS placebo_significant, round(pct, 6) AS placebo_pct FROM e""")
def placebo_effect(spark, sf_dir):
    d = daily(spark, sf_dir)
    got = checks.placebo_test(d, d.filter("t >= 24").select("series_id", "t"))
    return rounded(settled(got, "lift", "sd", "lower", "upper"), "lift_pct", "placebo_pct")


@query(HOURLY + f""", w0 AS (SELECT series_id, t FROM s WHERE t BETWEEN 300 AND 329), w1 AS (SELECT series_id, t FROM s WHERE t BETWEEN 300 AND 324), w2 AS (SELECT series_id, t FROM s WHERE t BETWEEN 300 AND 334),
a AS ({_mean_lift_sql("w0")}), b AS ({_mean_lift_sql("w1")}), d AS ({_mean_lift_sql("w2")})
SELECT a.series_id, round(a.lift + 1e-8, 4) AS lift_base, round(b.lift + 1e-8, 4) AS lift_low, round(d.lift + 1e-8, 4) AS lift_high, round(CASE WHEN abs(a.lift) > 0.01 THEN greatest(abs(b.lift - a.lift), abs(d.lift - a.lift)) / abs(a.lift) ELSE 0.0 END, 5) AS max_pct_change, 25 AS window_low, 35 AS window_high FROM a JOIN b ON b.series_id = a.series_id JOIN d ON d.series_id = a.series_id""")
def effect_stability(spark, sf_dir):
    h = hourly(spark, sf_dir)
    got = checks.effect_stability(lambda w: checks.mean_lift(h, h.filter(F.col("t").between(300, 299 + w)).select("series_id", "t")), 30)
    return rounded(settled(got, "lift_base", "lift_low", "lift_high"), "max_pct_change", to=5)


@query("""
SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, round(sum(value), 4) AS y FROM events WHERE event_type IS NOT NULL
GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type IS NOT NULL)""")
def stream_hourly_sums(spark, sf_dir):
    """Event-time windows of the events as a stream that ends with the table: those that the watermark has closed."""
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    keyed = events.filter("event_type IS NOT NULL").select(F.col("event_type").alias("series_id"), "ts", "value")
    path = scratch.scratch_path(spark, "windows")
    sums = online.windowed_series(keyed)
    sums.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    got = spark.read.schema("series_id string, ts timestamp, y double").parquet(f"{path}/rows")
    return got.select("series_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("y", 4).alias("y"))


@query(DRAWS + ", l2 AS (SELECT series_id, draw, list(value ORDER BY h) AS values FROM v GROUP BY 1, 2) SELECT series_id, draw, values FROM l2")
def draws_as_lists(spark, sf_dir):
    return draws.to_lists(src.embedding_draws(spark, sf_dir))


@query("SELECT vec_id, round(list_sum(list_transform(generate_series(1, len(embedding)), lambda i: embedding[i]::DOUBLE * (1.0 / i))), 8) AS predicted FROM embeddings")
def regressor_product(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    beta = F.transform(F.sequence(F.lit(1), F.size("x")), lambda i: F.lit(1.0) / i)
    return e.select("vec_id", F.round(c.dot(beta, F.col("x")), 8).alias("predicted"))


@query(DAILY + ", r AS (SELECT series_id, CAST(count(y) AS BIGINT) AS n, regr_slope(y, t) AS b, regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, regr_sxy(y, t) AS sxy FROM s WHERE t < 20 AND y IS NOT NULL GROUP BY 1) SELECT series_id, n, round(b, 6) AS slope, round(sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS slope_se, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS t_statistic, abs(b / sqrt((syy - b * sxy) / (n - 2) / sxx)) > 2 AS significant_trend FROM r")
def pretrend_ols(spark, sf_dir):
    return rounded(workflows.pre_trend_check(daily(spark, sf_dir), 1, 21), "slope", "slope_se", "t_statistic")


CHAINS = """
WITH c AS (SELECT l_returnflag AS param, CAST(l_linenumber AS INTEGER) AS chain, row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_orderkey, l_extendedprice) AS i, CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem),
n AS (SELECT param, min(k) AS n FROM (SELECT param, chain, count(*) AS k FROM c GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT c.param, chain, n.n, avg(value) AS mean, var_samp(value) AS var FROM c JOIN n ON n.param = c.param WHERE i <= n.n GROUP BY 1, 2, 3),
p AS (SELECT param, n, count(*) AS m, avg(var) AS w, (n - 1) / n * avg(var) + var_samp(mean) AS v FROM e GROUP BY 1, 2)"""


@query(CHAINS + " SELECT param, round(sqrt(v / w), 8) AS r_hat FROM p")
def r_hat(spark, sf_dir):
    return rounded(checks.r_hat(src.price_chains(spark, sf_dir)), "r_hat", to=8)


@query(CHAINS + " SELECT param, round(least(m * n * w / v, m * n), 4) AS ess FROM p")
def ess_multi(spark, sf_dir):
    return rounded(checks.effective_sample_size(src.price_chains(spark, sf_dir)), "ess", to=4)


@query("""
WITH c AS (SELECT l_returnflag AS param, CAST(l_linenumber AS INTEGER) AS chain, row_number() OVER v AS i, count(*) OVER (PARTITION BY l_returnflag, l_linenumber) AS k, CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem WINDOW v AS (PARTITION BY l_returnflag, l_linenumber ORDER BY l_orderkey, l_extendedprice)),
h AS (SELECT param, chain, CASE WHEN i <= k // 2 THEN 0 WHEN i > k - k // 2 THEN 1 END AS side, k // 2 AS n, value FROM c WHERE k >= 4),
e AS (SELECT param, chain, side, n, avg(value) AS mean, var_samp(value) AS var FROM h WHERE side IS NOT NULL GROUP BY ALL),
p AS (SELECT param, chain, avg(var) AS w, (any_value(n) - 1) / any_value(n) * avg(var) + var_samp(mean) AS v FROM e GROUP BY 1, 2)
SELECT param, chain, round(sqrt(v / w), 8) AS r_hat FROM p""")
def split_r_hat(spark, sf_dir):
    return rounded(checks.split_r_hat(src.price_chains(spark, sf_dir)), "r_hat", to=8)


@query("""
WITH c AS (SELECT l_returnflag AS param, CAST(l_linenumber AS INTEGER) AS chain, row_number() OVER v AS i, count(*) OVER (PARTITION BY l_returnflag, l_linenumber) AS n, CAST(l_extendedprice AS DOUBLE) AS value FROM lineitem WINDOW v AS (PARTITION BY l_returnflag, l_linenumber ORDER BY l_orderkey, l_extendedprice)),
w AS (SELECT param, chain, 0 AS part, i, n, n AS m, value FROM c
  UNION ALL SELECT param, chain, 1, i, n, greatest(CAST(floor(n * 0.1) AS BIGINT), 2), value FROM c WHERE n >= 20 AND i <= greatest(CAST(floor(n * 0.1) AS BIGINT), 2)
  UNION ALL SELECT param, chain, 2, i - (n - greatest(CAST(floor(n * 0.5) AS BIGINT), 2)), n, greatest(CAST(floor(n * 0.5) AS BIGINT), 2), value FROM c WHERE n >= 20 AND i > n - greatest(CAST(floor(n * 0.5) AS BIGINT), 2)),
d AS (SELECT *, value - avg(value) OVER (PARTITION BY param, chain, part) AS x, avg(value) OVER (PARTITION BY param, chain, part) AS mean FROM w),
a AS (SELECT p.param, p.chain, p.part, q.i - p.i AS k, any_value(p.n) AS n, any_value(p.m) AS m, any_value(p.mean) AS mean, sum(p.x * q.x) / any_value(p.m) AS a
  FROM d p JOIN d q ON q.param = p.param AND q.chain = p.chain AND q.part = p.part AND q.i >= p.i AND (p.part = 0 OR q.i - p.i <= least(greatest(CAST(floor(sqrt(p.m)) AS BIGINT), 1), p.m - 1)) GROUP BY 1, 2, 3, 4),
h AS (SELECT param, chain, k // 2 AS j, sum(a) AS s, any_value(n) AS n FROM a WHERE part = 0 AND k <= 2 * ((n - 2) // 2) + 1 GROUP BY 1, 2, 3),
l AS (SELECT *, min(CASE WHEN s <= 0 THEN j END) OVER (PARTITION BY param, chain) AS stop, min(s) OVER (PARTITION BY param, chain ORDER BY j) AS low FROM h),
e AS (SELECT l.param, l.chain, any_value(l.n) AS n, any_value(z.a) AS a0, 2 * coalesce(sum(low) FILTER (stop IS NULL OR j < stop), 0) - any_value(z.a) AS spread FROM l JOIN a z ON z.param = l.param AND z.chain = l.chain AND z.part = 0 AND z.k = 0 GROUP BY 1, 2),
g AS (SELECT param, chain, part, any_value(m) AS m, any_value(mean) AS mean, sum(CASE WHEN k = 0 THEN a ELSE 2 * (1 - k / (least(greatest(floor(sqrt(m)), 1), m - 1) + 1)) * a END) AS s FROM a WHERE part > 0 GROUP BY 1, 2, 3),
t AS (SELECT x.param, x.chain, (x.mean - y.mean) / sqrt(x.s / x.m + y.s / y.m) AS z FROM g x JOIN g y ON y.param = x.param AND y.chain = x.chain AND x.part = 1 AND y.part = 2 WHERE x.s > 0 AND y.s > 0)
SELECT b.param, b.chain, round(CASE WHEN b.n < 4 OR e.a0 = 0 THEN NULL WHEN spread <= 1e-15 THEN 1.0 ELSE least(greatest(e.n * a0 / spread, 1.0), e.n) END, 4) AS ess, round(t.z, 6) AS geweke_z, abs(t.z) <= """ + str(Z05) + """ AS geweke_pass
FROM (SELECT param, chain, any_value(n) AS n FROM c GROUP BY 1, 2) b LEFT JOIN e ON e.param = b.param AND e.chain = b.chain LEFT JOIN t ON t.param = b.param AND t.chain = b.chain""")
def chain_diagnostics(spark, sf_dir):
    return rounded(checks.chain_diagnostics(src.price_chains(spark, sf_dir)), "ess", to=4).withColumn("geweke_z", F.round("geweke_z", 6))


# ---- controls, autoregression, signals ---------------------------------------------------------------------------


@query(DAILY + """,
t AS (SELECT t, y FROM s WHERE series_id = 'click'), r AS (SELECT x.series_id AS control_id, corr(x.y, t.y) AS r FROM s x JOIN t ON t.t = x.t WHERE x.series_id <> 'click' GROUP BY 1),
o AS (SELECT control_id, round(r, 8) AS r, CAST(row_number() OVER (ORDER BY abs(r) DESC, control_id) AS INTEGER) AS "rank" FROM r WHERE abs(r) >= 0.01)
SELECT * FROM o WHERE "rank" <= 3""")
def pearson_topk(spark, sf_dir):
    d = daily(spark, sf_dir)
    controls = d.filter("series_id <> 'click'").select(F.col("series_id").alias("control_id"), "t", "y")
    return rounded(models.pearson_controls(d.filter("series_id = 'click'"), controls, 0.01, 3), "r", to=8)


@query(DAILY + """,
x AS (SELECT series_id, y, lag(y) OVER (PARTITION BY series_id ORDER BY t) AS z FROM s),
m AS (SELECT series_id, count(*) + 1e-6 AS n, sum(z) AS sz, sum(z * z) + 1e-6 AS szz, sum(y) AS sy, sum(z * y) AS szy FROM x WHERE z IS NOT NULL GROUP BY 1)
SELECT series_id, round((szz * sy - sz * szy) / (n * szz - sz * sz), 2) AS intercept, round((n * szy - sz * sy) / (n * szz - sz * sz), 5) AS slope FROM m""")
def ar1_ridge(spark, sf_dir):
    return models.ar_fit(daily(spark, sf_dir), 1).select("series_id", F.round(F.get("coefficients", F.lit(0)), 2).alias("intercept"), F.round(F.get("coefficients", F.lit(1)), 5).alias("slope"))


@query(HOURLY + ", a AS (SELECT series_id, sum(coalesce(y, 0.0) * (1 - pow(0.5, (SELECT max(t) FROM s) - t + 1)) / 0.5) AS total FROM s GROUP BY 1) SELECT series_id, round(total, 3) AS total FROM a")
def adstock_total(spark, sf_dir):
    h = hourly(spark, sf_dir).groupBy("series_id").agg(c.history(F.col("t"), F.coalesce("y", F.lit(0.0)).alias("y")).alias("v"))
    return h.select("series_id", F.round(c.adstock_total(F.transform("v", lambda s: s["y"]), 0.5), 3).alias("total"))


@query(DAILY + ", k(series_id, t, a) AS (SELECT series_id, t, y FROM s WHERE t = 0 UNION ALL SELECT s.series_id, s.t, s.y + 0.6 * k.a FROM k JOIN s ON s.series_id = k.series_id AND s.t = k.t + 1) SELECT series_id, t, round(a, 4) AS adstock, round(pow(a, 2.0) / (pow(a, 2.0) + 64000000.0), 8) AS saturated FROM k")
def adstock_hill(spark, sf_dir):
    d = daily(spark, sf_dir).groupBy("series_id").agg(c.history(F.col("t"), F.coalesce("y", F.lit(0.0)).alias("y")).alias("v"))
    path = d.select("series_id", F.posexplode(c.adstock_path(F.transform("v", lambda s: s["y"]), 0.6)).alias("t", "a"))
    return path.select("series_id", F.col("t").cast("long").alias("t"), F.round("a", 4).alias("adstock"), F.round(c.hill(F.col("a"), 8000.0, 2.0), 8).alias("saturated"))


_A = scenarios()["a"]


@query(f"""
SELECT CAST(range AS BIGINT) AS t, round(50.0 + 0.5 * range / 1440.0 + 10.0 * sin(2 * pi() * range / 1440.0) + 5.0 * cos(2 * pi() * range / 1440.0) + 3.0 * sin(4 * pi() * range / 1440.0) + 2.0 * cos(4 * pi() * range / 1440.0) + 4.0 * sin(2 * pi() * range / 10080.0) + 3.0 * cos(2 * pi() * range / 10080.0), 6) AS baseline FROM range({_A["total"]})""")
def fourier_baseline(spark, sf_dir):
    return rounded(synthetic.baseline(spark, _A["total"], _A["baseline"]), "baseline")


# ---- anomalies ---------------------------------------------------------------------------------------------------

_TRAIN = 480
_ANOMALY = HOURLY + f""",
i AS (SELECT series_id, coalesce(arg_min(y, t) FILTER (y IS NOT NULL), 0.0) AS x FROM s WHERE t < {_TRAIN} GROUP BY 1),
k(series_id, t, xp, pp, x, p) AS (
  SELECT series_id, CAST(-1 AS BIGINT), x, CAST(100 AS DOUBLE), x, CAST(100 AS DOUBLE) FROM i
  UNION ALL
  SELECT k.series_id, s.t, k.x, k.p + 4.0, CASE WHEN s.y IS NULL THEN k.x ELSE k.x + (k.p + 4.0) / (k.p + 4.0 + 4000.0) * (s.y - k.x) END, CASE WHEN s.y IS NULL THEN k.p + 4.0 ELSE (k.p + 4.0) * 4000.0 / (k.p + 4.0 + 4000.0) END
  FROM k JOIN s ON s.series_id = k.series_id AND s.t = k.t + 1),
a AS (SELECT s.series_id, s.t, s.y AS value, xp AS predicted, sqrt(pp + 4000.0) AS predicted_sd, coalesce((s.y - xp) / sqrt(pp + 4000.0), 0.0) AS z FROM k JOIN s ON s.series_id = k.series_id AND s.t = k.t WHERE s.t >= {_TRAIN}),
b AS (SELECT *, abs(z) > {Z01} AS anomaly, CASE WHEN abs(z) > {2 * Z01} THEN 'critical' WHEN abs(z) > {Z01} THEN 'warning' ELSE 'normal' END AS severity FROM a)"""


def _scores(spark, sf_dir) -> DataFrame:
    return models.anomaly_scores(hourly(spark, sf_dir), _TRAIN, q=4.0, r=4000.0, p0=100.0)


@query(_ANOMALY + " SELECT series_id, t, value, round(predicted, 5) AS predicted, round(predicted_sd, 5) AS predicted_sd, round(z, 6) AS z_score, anomaly, severity FROM b")
def anomaly_scores(spark, sf_dir):
    s = _scores(spark, sf_dir).drop("residual", "p_value").withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return s.select("series_id", "t", "value", F.round("predicted", 5).alias("predicted"), F.round("predicted_sd", 5).alias("predicted_sd"), F.round("z_score", 6).alias("z_score"), "anomaly", "severity")


@query(HOURLY + f""",
k(series_id, t, y, m, v, l, b, p11, p12, p22) AS (
  SELECT DISTINCT series_id, CAST(-1 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(150 AS DOUBLE), CAST(0 AS DOUBLE), CAST(400 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) FROM s
  UNION ALL
  SELECT series_id, t, y, lp, a11 + 4000,
    CASE WHEN y IS NULL THEN lp ELSE lp + a11 / (a11 + 4000) * (y - lp) END, CASE WHEN y IS NULL THEN b ELSE b + a12 / (a11 + 4000) * (y - lp) END,
    CASE WHEN y IS NULL THEN a11 ELSE a11 * 4000 / (a11 + 4000) END, CASE WHEN y IS NULL THEN a12 ELSE a12 * 4000 / (a11 + 4000) END, CASE WHEN y IS NULL THEN a22 ELSE a22 - a12 * a12 / (a11 + 4000) END
  FROM (SELECT k.series_id, s.t, s.y, k.l + k.b AS lp, k.b, k.p11 + 2 * k.p12 + k.p22 + 4.0 AS a11, k.p12 + k.p22 AS a12, k.p22 + 0.01 AS a22 FROM k JOIN s ON s.series_id = k.series_id AND s.t = k.t + 1)),
z AS (SELECT *, coalesce((y - m) / sqrt(v), 0.0) AS z FROM k WHERE t >= {_TRAIN})
SELECT series_id, t, round(m, 5) AS predicted, round(sqrt(v), 5) AS predicted_sd, round(z, 6) AS z_score, abs(z) > {Z01} AS anomaly FROM z""")
def anomaly_trend(spark, sf_dir):
    spec = ms.local_linear_trend(4.0, 0.01, 4000.0, 150.0, 0.0, 400.0, 1.0)
    got = models.anomaly_scores(hourly(spark, sf_dir), _TRAIN, spec=spec)
    return rounded(rounded(got.select("series_id", "t", "predicted", "predicted_sd", "z_score", "anomaly"), "predicted", "predicted_sd", to=5), "z_score")


@query(_ANOMALY + " SELECT series_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (anomaly) AS BIGINT) AS anomalies, CAST(count(*) FILTER (severity = 'warning') AS BIGINT) AS warnings, CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS criticals, round(avg(CASE WHEN anomaly THEN 1.0 ELSE 0.0 END), 8) AS anomaly_rate, round(max(abs(z)), 6) AS max_abs_z FROM b GROUP BY 1")
def anomaly_summary(spark, sf_dir):
    got = models.anomaly_summary(_scores(spark, sf_dir))
    return got.select("series_id", "total", "anomalies", "warnings", "criticals", F.round("anomaly_rate", 8).alias("anomaly_rate"), F.round("max_abs_z", 6).alias("max_abs_z"))


@query(_ANOMALY + " SELECT series_id, t, severity FROM b WHERE anomaly")
def anomaly_detect(spark, sf_dir):
    return models.detect(_scores(spark, sf_dir)).select("series_id", "t", "severity")


@query(f"""
WITH RECURSIVE s AS (SELECT event_type AS series_id, ts, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events WHERE event_type IS NOT NULL),
k(series_id, n, ts, y, xp, pp, x, p) AS (
  SELECT series_id, n, ts, y, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), y, CAST(100 AS DOUBLE) FROM s WHERE n = 1
  UNION ALL
  SELECT s.series_id, s.n, s.ts, s.y, k.x, k.p + 1.0, k.x + (k.p + 1.0) / (k.p + 1.0 + 800.0) * (s.y - k.x), (k.p + 1.0) * (1 - (k.p + 1.0) / (k.p + 1.0 + 800.0)) FROM k JOIN s ON s.series_id = k.series_id AND s.n = k.n + 1)
SELECT series_id, ts, y AS value, round(xp, 6) AS predicted, round((y - xp) / sqrt(pp + 800.0), 6) AS z_score, abs((y - xp) / sqrt(pp + 800.0)) > {Z05} AS anomaly FROM k WHERE n > 1""")
def online_scores(spark, sf_dir):
    """The streaming scorer over the events, as a stream that ends with the table; results go to a file sink."""
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    keyed = events.filter("event_type IS NOT NULL").select(F.col("event_type").alias("series_id"), "ts", F.col("value").alias("y"))
    path = scratch.scratch_path(spark, "online")
    scored = online.score_stream(keyed, 1.0, 800.0, 100.0, 0.05)
    scored.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    got = spark.read.schema(online.SCHEMA).parquet(f"{path}/rows")
    return got.select("series_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", F.round("predicted", 6).alias("predicted"), F.round("z_score", 6).alias("z_score"), "anomaly")


# ---- what follows from given draws and noise ----------------------------------------------------------------------


@query("""
WITH v AS (SELECT CAST(label AS VARCHAR) AS series_id, embedding[1]::DOUBLE AS x, abs(embedding[2]::DOUBLE) AS q, abs(embedding[3]::DOUBLE) AS r FROM embeddings),
m AS (SELECT series_id, avg(x) AS m, var_samp(x) AS b, avg(q) AS q, avg(r) AS r FROM v GROUP BY 1)
SELECT series_id, CAST(h AS BIGINT) AS h, round(m, 8) AS mean, round(sqrt(coalesce(b, 0) + h * q + r), 8) AS sd FROM m, (SELECT unnest(generate_series(1, 7)) AS h)""")
def moments_of_given_draws(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("string").alias("series_id"), F.col("embedding").cast("array<double>").alias("v"))
    drawn = e.select("series_id", F.slice("v", 1, 1).alias("x_last"), F.array(F.abs(F.get("v", F.lit(1)))).alias("q"), F.abs(F.get("v", F.lit(2))).alias("obs_var"))
    return rounded(models.scalar_moments(drawn, 7), "mean", "sd", to=8)


_EFFECTS = """
WITH v AS (SELECT CAST(label AS VARCHAR) AS series_id, vec_id AS draw, CAST(unnest(generate_series(1, len(embedding))) AS BIGINT) AS t, unnest(embedding)::DOUBLE AS effect FROM embeddings),
u AS (SELECT series_id, draw, sum(effect) AS total, sum(10.0 + effect / 2) AS base FROM v GROUP BY 1, 2)"""


def _given_effects(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("string").alias("series_id"), F.col("vec_id").alias("draw"), F.posexplode(F.col("embedding").cast("array<double>")).alias("t", "effect"))
    return e.select("series_id", "draw", (F.col("t") + 1).cast("long").alias("t"), "effect", (F.col("effect") / 2 + 10.0).alias("counterfactual"))


def _bounds_sql(x: str) -> str:
    return f"round(avg({x}), 8) AS mean, round(stddev_samp({x}), 8) AS sd, round(quantile_cont({x}, 0.025), 8) AS lower, round(quantile_cont({x}, 0.975), 8) AS upper"


@query(_EFFECTS + f" SELECT series_id, t, {_bounds_sql('effect')} FROM v GROUP BY 1, 2")
def impact_points_of_given_draws(spark, sf_dir):
    return rounded(models.impact_summary(_given_effects(spark, sf_dir))["point"], "mean", "sd", "lower", "upper", to=8)


@query(_EFFECTS + f" SELECT series_id, {_bounds_sql('total')} FROM u GROUP BY 1")
def impact_total_of_given_draws(spark, sf_dir):
    return rounded(models.impact_summary(_given_effects(spark, sf_dir))["cumulative"], "mean", "sd", "lower", "upper", to=8)


@query(_EFFECTS + f" SELECT series_id, {_bounds_sql('total / base')} FROM u GROUP BY 1")
def impact_relative_of_given_draws(spark, sf_dir):
    return rounded(models.impact_summary(_given_effects(spark, sf_dir))["relative"], "mean", "sd", "lower", "upper", to=8)


@query(GAPPY + _filter_sql() + f""",
f AS (SELECT series_id, t, x, p, sin(t + 1.0) AS z FROM k WHERE t >= 0),
b(series_id, t, x) AS (
  SELECT series_id, t, x + sqrt(greatest(p, 0)) * z FROM f WHERE t = (SELECT max(t) FROM s)
  UNION ALL
  SELECT f.series_id, f.t, f.x + f.p / (f.p + {Q}) * (b.x - f.x) + sqrt(greatest(f.p - f.p / (f.p + {Q}) * f.p, 1e-12)) * f.z FROM b JOIN f ON f.series_id = b.series_id AND f.t = b.t - 1)
SELECT series_id, t, round(x, 6) AS x FROM b""")
def simulated_states_of_given_noise(spark, sf_dir):
    return rounded(models.simulate_given(gappy(spark, sf_dir).withColumn("z", F.sin(F.col("t") + 1.0)), "z", Q, R, X0, P0), "x")


# ---- sampling: no SQL, tested on simulated truth ------------------------------------------------------------------


@query()
def gibbs_scalar_chains(spark, sf_dir):
    return models.chains(daily(spark, sf_dir), 2, 100, 50, seed=7).select("series_id", "chain", "draw", "obs_var", "q", "x_last")


@query()
def gibbs_structured(spark, sf_dir):
    spec = ms.compose(ms.local_linear_trend(Q, 1.0, R, X0, 0.0, P0, 10.0), ms.seasonal(7, 100.0, initial_cov=1e4))
    return models.chains(daily(spark, sf_dir), 1, 40, 20, spec=spec, seed=7).select("series_id", "chain", "draw", "obs_var", "q", "x_last")


_D = 8  # level, slope and six seasons, in lists of 8 and of 64 numbers, row by row


def _product(a: str, b: str, flip: bool = False) -> str:
    """The product of two matrices in lists, the second one transposed if flip."""
    other = f"{b}[(i % {_D}) * {_D} + k + 1]" if flip else f"{b}[k * {_D} + (i % {_D}) + 1]"
    return f"list_transform(generate_series(0, {_D * _D - 1}), lambda i: list_sum(list_transform(generate_series(0, {_D - 1}), lambda k: {a}[(i // {_D}) * {_D} + k + 1] * {other})))"


def _applied(a: str, x: str) -> str:
    return f"list_transform(generate_series(0, {_D - 1}), lambda i: list_sum(list_transform(generate_series(0, {_D - 1}), lambda k: {a}[i * {_D} + k + 1] * {x}[k + 1])))"


def _cells(value) -> str:
    return "[" + ", ".join(str(float(value(i // _D, i % _D))) for i in range(_D * _D)) + "]"


_SEEN = f"(p[i * {_D} + 1] + p[i * {_D} + 3])"  # row i of the covariance times the observation row: level and first season
_SF = _cells(lambda i, j: i == j == 0 or (i, j) in ((0, 1), (1, 1)) or (-1 if i == 2 and j >= 2 else i > 2 and j == i - 1))
_SQ = _cells(lambda i, j: (Q, 1.0, 100.0)[i] if i == j and i < 3 else 0)
_SP = _cells(lambda i, j: (P0, 10.0)[i] if i == j and i < 2 else 1e4 if i == j else 0)


@query(DAILY + f""",
m AS (SELECT {_SF} AS f, {_SQ} AS q),
k(series_id, t, x, p) AS (
  SELECT DISTINCT series_id, CAST(-1 AS BIGINT), [{X0}, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[], {_SP}::DOUBLE[] FROM s
  UNION ALL
  SELECT series_id, t, CASE WHEN y IS NULL THEN x ELSE list_transform(generate_series(0, {_D - 1}), lambda i: x[i + 1] + g[i + 1] / v * (y - x[1] - x[3])) END,
         CASE WHEN y IS NULL THEN p ELSE list_transform(generate_series(0, {_D * _D - 1}), lambda i: p[i + 1] - g[i // {_D} + 1] * g[i % {_D} + 1] / v) END
  FROM (SELECT *, g[1] + g[3] + {R} AS v FROM (SELECT *, list_transform(generate_series(0, {_D - 1}), lambda i: {_SEEN}) AS g FROM (
    SELECT series_id, t, y, x, list_transform(generate_series(0, {_D * _D - 1}), lambda i: w[i + 1] + q[i + 1]) AS p FROM (
      SELECT series_id, t, y, x, q, {_product("a", "f", True)} AS w FROM (
        SELECT k.series_id, s.t, s.y, {_applied("m.f", "k.x")} AS x, {_product("m.f", "k.p")} AS a, m.f AS f, m.q AS q FROM k JOIN s ON s.series_id = k.series_id AND s.t = k.t + 1, m)))))),
z(series_id, h, x, p, c, mean, own, total) AS (
  SELECT series_id, CAST(0 AS BIGINT), x, p, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[], 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM k WHERE t = (SELECT max(t) FROM s)
  UNION ALL
  SELECT series_id, h + 1, x, p, list_transform(generate_series(0, {_D - 1}), lambda i: c[i + 1] + g[i + 1]), x[1] + x[3], g[1] + g[3], total + g[1] + g[3] + 2 * (c[1] + c[3])
  FROM (SELECT *, list_transform(generate_series(0, {_D - 1}), lambda i: {_SEEN}) AS g FROM (
    SELECT series_id, h, x, list_transform(generate_series(0, {_D * _D - 1}), lambda i: w[i + 1] + q[i + 1]) AS p, c, total FROM (
      SELECT series_id, h, x, c, total, q, {_product("a", "f", True)} AS w FROM (
        SELECT z.series_id, z.h, {_applied("m.f", "z.x")} AS x, {_product("m.f", "z.p")} AS a, {_applied("m.f", "z.c")} AS c, z.total, m.f AS f, m.q AS q FROM z, m WHERE z.h < 14)))))
SELECT series_id, h, round(mean, 4) AS mean, round(own + {R}, 2) AS variance, round(total + h * {R}, 1) AS cumulative_variance FROM z WHERE h > 0""")
def seasonal_forecast(spark, sf_dir):
    spec = ms.compose(ms.local_linear_trend(Q, 1.0, R, X0, 0.0, P0, 10.0), ms.seasonal(7, 100.0, initial_cov=1e4))
    got = models.forecast_fixed(daily(spark, sf_dir), spec, 14)
    return got.select("series_id", "h", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"), F.round("cumulative_variance", 1).alias("cumulative_variance"))


@query()
def forecaster_predict(spark, sf_dir):
    return draws.summary_outward(models.forecast_draws(daily(spark, sf_dir), 7, 200, seed=7))


@query()
def demand_forecast(spark, sf_dir):
    return workflows.demand_forecast(daily(spark, sf_dir), 7, seasonality=7, samples=40, seed=7)


@query()
def forecast_decompose(spark, sf_dir):
    spec = ms.compose(ms.local_linear_trend(Q, 1.0, R, X0, 0.0, P0, 10.0), ms.seasonal(7, 100.0, initial_cov=1e4))
    return models.decompose(daily(spark, sf_dir), spec, 40, seed=7)


@query()
def posterior_moments(spark, sf_dir):
    return models.scalar_moments(models.chains(daily(spark, sf_dir), 1, 100, 50, seed=7), 7)


@query()
def ar_predict(spark, sf_dir):
    return draws.summary_interpolated(models.ar_draws(daily(spark, sf_dir), 7, 2, 200, seed=7))


@query()
def impact_bayes(spark, sf_dir):
    return workflows.effects(workflows.analyze(daily(spark, sf_dir), PRE, POST, samples=200, seed=7))


@query(DAILY + _filter_sql() + f""",
e AS (SELECT series_id, x, p FROM k WHERE t = {PRE[1] - 1}),
g AS (SELECT e.series_id, sum(s.y - e.x) AS total, sum(e.x) AS base, sqrt({_N * _N}.0 * any_value(p) + {Q} * {_N} * {_N + 1} * {2 * _N + 1} / 6.0 + {_N} * {R}) AS sd FROM s JOIN e ON e.series_id = s.series_id WHERE s.t BETWEEN {POST[0] - 1} AND {POST[1] - 1} GROUP BY 1)
SELECT series_id, printf('Cumulative effect: %.2f (SD %.2f), interval %.2f to %.2f; relative %.1f%%; significant: %s', total, sd, total - {Z05} * sd, total + {Z05} * sd, 100 * total / base, CASE WHEN total - {Z05} * sd > 0 OR total + {Z05} * sd < 0 THEN 'yes' ELSE 'no' END) AS report FROM g""")
def impact_report(spark, sf_dir):
    return workflows.report(workflows.effects(workflows.analyze(daily(spark, sf_dir), PRE, POST, mode="operational", model_spec=ms.local_level(Q, R, X0, P0))))


@query(DAILY + f""",
k(series_id, t, l, b, p11, p12, p22) AS (
  SELECT DISTINCT series_id, CAST(-1 AS BIGINT), CAST({X0} AS DOUBLE), CAST(0 AS DOUBLE), CAST({P0} AS DOUBLE), CAST(0 AS DOUBLE), CAST(10 AS DOUBLE) FROM s
  UNION ALL
  SELECT series_id, t, lp + a11 / (a11 + {R}) * (y - lp), b + a12 / (a11 + {R}) * (y - lp), a11 * {R} / (a11 + {R}), a12 * {R} / (a11 + {R}), a22 - a12 * a12 / (a11 + {R})
  FROM (SELECT k.series_id, s.t, s.y, k.l + k.b AS lp, k.b, k.p11 + 2 * k.p12 + k.p22 + {Q} AS a11, k.p12 + k.p22 AS a12, k.p22 + 1.0 AS a22 FROM k JOIN s ON s.series_id = k.series_id AND s.t = k.t + 1 WHERE s.t < {PRE[1]})),
f(series_id, h, l, b, p11, p12, p22, c1, c2, total) AS (
  SELECT series_id, CAST(0 AS BIGINT), l, b, p11, p12, p22, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM k WHERE t = {PRE[1] - 1}
  UNION ALL
  SELECT series_id, h + 1, l, b, p11, p12, p22, d1 + p11, d2 + p12, total + p11 + 2 * d1
  FROM (SELECT series_id, h, l + b AS l, b, p11 + 2 * p12 + p22 + {Q} AS p11, p12 + p22 AS p12, p22 + 1.0 AS p22, c1 + c2 AS d1, c2 AS d2, total FROM f WHERE h < {_N})),
o AS (SELECT f.series_id, CAST({PRE[1] - 1} + h AS BIGINT) AS t, y, l, sqrt(p11 + {R}) AS sd FROM f JOIN s ON s.series_id = f.series_id AND s.t = {PRE[1] - 1} + h WHERE h > 0),
u AS (SELECT o.series_id, sum(y - l) AS effect, sum(l) AS base FROM o GROUP BY 1),
v AS (SELECT series_id, sqrt(total + {_N} * {R}) AS sd FROM f WHERE h = {_N})
SELECT o.series_id, o.t, round(l, 4) AS baseline, round(y - l, 4) AS effect, round(o.sd, 4) AS sd, round(y - l - {Z05} * o.sd, 4) AS lower, round(y - l + {Z05} * o.sd, 4) AS upper, round(u.effect, 3) AS cumulative, round(v.sd, 3) AS cumulative_sd, round(u.effect / base, 7) AS relative
FROM o JOIN u ON u.series_id = o.series_id JOIN v ON v.series_id = o.series_id""")
def impact_smoothed(spark, sf_dir):
    """The masked steps are the last ones, so smoothing through them is the exact forecast, with its covariances."""
    got = models.structured_impact(daily(spark, sf_dir), PRE, POST, ms.local_linear_trend(Q, 1.0, R, X0, 0.0, P0, 10.0), baseline="smooth")
    return rounded(rounded(rounded(got, "baseline", "effect", "sd", "lower", "upper", to=4), "cumulative", "cumulative_sd", to=3), "relative", to=7)


@query()
def spike_slab_inclusion(spark, sf_dir):
    import numpy as np

    t = np.arange(30)
    x = np.column_stack([np.sin(2 * np.pi * t / 7), np.cos(2 * np.pi * t / 7), (t >= 21).astype(float), t % 2])
    spec = ms.compose(ms.local_level(Q, R, X0, P0), ms.regression(x, "spike_and_slab"))
    return models.inclusion(models.chains(daily(spark, sf_dir), 1, 60, 30, spec=spec, seed=7))


@query()
def ssvs_controls(spark, sf_dir):
    d = daily(spark, sf_dir)
    controls = d.filter("series_id <> 'click'").select(F.col("series_id").alias("control_id"), "t", "y")
    return models.search_controls(d.filter("series_id = 'click'"), controls, 200, 100)


@query()
def rolling_baseline(spark, sf_dir):
    spec = ms.compose(ms.local_linear_trend(Q, 1.0, R, X0, 0.0, P0, 10.0), ms.seasonal(7, 100.0, initial_cov=1e4))
    return models.rolling_baseline(daily(spark, sf_dir), spec, 7, samples=40, burn_in=20, seed=7)


def _spots(spark, sf_dir) -> DataFrame:
    own = spark.createDataFrame([("a", 0, 4), ("b", 3, 6), ("c", 7, 9)], "spot_id string, ws long, we long")
    return daily(spark, sf_dir).select("series_id").distinct().crossJoin(F.broadcast(own))


@query(DAILY + _filter_sql() + f""",
k0 AS (SELECT series_id, x, p FROM k WHERE t = {PRE[1] - 1}),
cf AS (SELECT s.series_id, CAST(s.t - {POST[0] - 1} AS BIGINT) AS t, s.y, k0.x AS cf_mean, k0.p + (s.t - {POST[0] - 1} + 1) * {Q} + {R} AS cf_var FROM s JOIN k0 ON k0.series_id = s.series_id WHERE s.t BETWEEN {POST[0] - 1} AND {POST[1] - 1}),
w AS (SELECT series_id, spot_id, CAST(ws AS BIGINT) AS ws, CAST(we AS BIGINT) AS we FROM (SELECT DISTINCT series_id FROM s), (VALUES ('a', 0, 4), ('b', 3, 6), ('c', 7, 9)) AS v(spot_id, ws, we))""" + _GROUPS + _attributed_sql(0.0))
def pipeline_operational(spark, sf_dir):
    got = workflows.run_pipeline(daily(spark, sf_dir), PRE, POST, _spots(spark, sf_dir), ms.local_level(Q, R, X0, P0))[0]
    return rounded(got, "lift", "lift_sd", "lift_lower", "lift_upper", to=4).withColumn("p_positive", F.round("p_positive", 6))


@query()
def pipeline_bayesian(spark, sf_dir):
    return workflows.run_pipeline(daily(spark, sf_dir), PRE, POST, _spots(spark, sf_dir), mode="bayesian", samples=100, seed=7)[0]


@query()
def marketing_multi(spark, sf_dir):
    campaigns = [
        {"name": "x", "start_index": 22, "end_index": 26, "baseline_start": 1, "baseline_end": 21},
        {"name": "y", "start_index": 25, "end_index": 28, "baseline_start": 1, "baseline_end": 21},
        {"name": "z", "start_index": 29, "end_index": 30, "baseline_start": 1, "baseline_end": 28},
    ]
    return workflows.campaigns_lift(daily(spark, sf_dir), campaigns, samples=100, seed=7)


@query()
def policy_multi_metric(spark, sf_dir):
    return workflows.policy_effect(daily(spark, sf_dir), 1, 20, 30, lag=2, samples=100, seed=7)


@query()
def simulated_states(spark, sf_dir):
    return models.simulate_states(gappy(spark, sf_dir), 20, Q, R, X0, P0, 7)


@query()
def scenario_series(spark, sf_dir):
    return synthetic.scenario_series(spark)
