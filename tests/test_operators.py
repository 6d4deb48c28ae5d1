"""Operators on small frames: hand-made results, nulls, ties, empty input, error contracts."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidelens.functions import columns as c
from tidelens.kernels import spec as ms
from tidelens.operators import attribution, checks, draws, models
from tidelens.plans import workflows
from tidelens.sources import synthetic
from tidelens.streaming import online

DRAWS = "series_id string, draw long, h long, value double"


def frame(spark, rows, h=None):
    return spark.createDataFrame([("s", d, i + 1, float(v)) for d, row in enumerate(rows) for i, v in enumerate(row)], DRAWS)


def test_draw_summaries(spark):
    d = frame(spark, [[1, 2], [3, 4], [5, 6]])
    got = {r["h"]: r for r in draws.summary_nearest(d, 0.2).collect()}
    assert [(got[h]["mean"], got[h]["median"], got[h]["lower"], got[h]["upper"]) for h in (1, 2)] == [(3, 3, 1, 5), (4, 4, 2, 6)]
    r = draws.risk(frame(spark, [[80], [100], [120]]), 100).first()
    assert (round(r["probability_below"], 6), round(r["expected_shortfall"], 6), r["conditional_shortfall"]) == (0.333333, 6.666667, 20)


def test_draw_algebra(spark):
    a, b = frame(spark, [[1, 2], [3, 4]]), frame(spark, [[10, 20], [30, 40]])
    got = sorted((r["draw"], r["h"], r["value"]) for r in draws.combine(a, b, lambda x, y: x * y).collect())
    assert [v for *_, v in got] == [10, 40, 90, 160]
    w = spark.createDataFrame([(1, 1.0), (2, 2.0)], "h long, weight double")
    assert sorted(r["value"] for r in draws.weighted_sum(b, w).collect()) == [50, 110]
    with pytest.raises(Exception, match="finite"):
        draws.checked(frame(spark, [[float("nan")]])).collect()


def test_makegood(spark):
    w = spark.createDataFrame([(1, 1.0), (2, 1.0)], "h long, weight double")
    r = draws.makegood(frame(spark, [[100, 100], [80, 80], [120, 120]]), w, 200.0).first()
    assert (r["mean"], r["conservative"], round(r["expected_shortfall"], 6), r["conditional_shortfall"]) == (200, 160, 13.333333, 40)


def test_attribution_against_the_union(spark):
    cf = spark.createDataFrame([("s", t, float(y), 100.0 + t, 1.0) for t, y in enumerate([100, 102, 150, 148, 101])], "series_id string, t long, y double, cf_mean double, cf_var double")
    spots = spark.createDataFrame([("s", "a", 2, 4), ("s", "b", 3, 5)], "series_id string, spot_id string, ws long, we long")
    one = attribution.window_lift(cf, spots.filter("spot_id = 'a'"), 0.5).first()
    assert (one["lift"], one["variance"]) == (93.0, 3.0)
    got = attribution.attribute(cf, spots, 0.5)
    both = attribution.union_lift(cf, attribution.overlap_groups(spots), ["group_id"], 0.5).first()
    assert abs(attribution.totals(got).first()["total_lift"] - both["lift"]) < 1e-9
    assert attribution.attribute(cf, spots.limit(0), 0.5).count() == 0


def test_touching_windows_do_not_overlap(spark):
    spots = spark.createDataFrame([("s", "a", 0, 10), ("s", "b", 10, 20), ("s", "c", 19, 30)], "series_id string, spot_id string, ws long, we long")
    assert [r["group_id"] for r in attribution.overlap_groups(spots).orderBy("spot_id").collect()] == [0, 1, 1]


def test_bad_windows_raise(spark):
    spots = spark.createDataFrame([("s", "a", 5, 5)], "series_id string, spot_id string, ws long, we long")
    with pytest.raises(Exception, match="bad window"):
        workflows.validate_spots(spots, 10).collect()


def test_missing_values_and_empty_series(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, float("nan")), ("a", 2, 100.0), ("b", 0, None)], "series_id string, t long, y double")
    assert {r["series_id"]: r["first_obs"] for r in models.first_observed(df).collect()} == {"a": 100.0, "b": 0.0}
    fold = {r["series_id"]: (r["n"], round(r["x"], 9)) for r in models.filter_terminal(df, 1.0, 1.0, 1.0, 0.0).collect()}
    path = {r["series_id"]: r["x_filt"] for r in models.filter_path(df).filter("t = 2").collect()}
    assert fold["a"][1] == round(path["a"], 9) and fold["b"] == (1, 0.0)
    assert models.filter_path(df.limit(0)).count() == 0 and models.anomaly_scores(df.limit(0), 1).count() == 0


def test_operational_lanes_agree(spark):
    df = spark.createDataFrame([("a", t, float(50 + (t % 3) + (5 if t >= 20 else 0))) for t in range(30)], "series_id string, t long, y double")
    spec = ms.local_level(0.5, 1.0, 50.0, 1.0)
    got = workflows.analyze(df, (1, 20), (21, 30), mode="operational", model_spec=spec)
    closed = models.local_level_impact(df, (1, 20), (21, 30), 0.5, 1.0, 1.0)["cumulative"].first()
    assert abs(got["cumulative"].first()["mean"] - closed["effect"]) < 1e-9 and abs(got["cumulative"].first()["sd"] - closed["sd"]) < 1e-9
    assert "significant" in workflows.report(workflows.effects(got)).first()["report"]
    for bad in ({"nonsense": 1}, {"mode": "other"}, {"alpha": 2}):
        with pytest.raises(ValueError):
            workflows.analyze(df, (1, 20), (21, 30), **bad)
    with pytest.raises(ValueError):
        workflows.analyze_at(df, 1, 30)


def test_bayesian_impact_covers_a_known_step(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    y = 50 + rng.normal(0, 1, 50)
    y[40:] += 10
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(y)], "series_id string, t long, y double")
    r = workflows.effects(workflows.analyze_at(df, 41, 50, samples=200, seed=1)).first()
    assert r["cumulative_lower"] < 100 < r["cumulative_upper"] and r["significant"]


def test_verdicts_and_quantiles(spark):
    m = spark.createDataFrame([("a", 0.1, 0.9, 1.7, False, 0.01, 0.3), ("b", 0.15, 1.0, 0.5, True, 0.01, None)], "series_id string, mape double, pct double, statistic double, placebo_significant boolean, placebo_pct double, max_pct_change double")
    got = {r["series_id"]: tuple(r)[1:] for r in checks.assess(m).collect()}
    assert got == {"a": ("pass", "pass", "pass", "pass", "fail"), "b": ("warn", "warn", "fail", "fail", "skip")}
    v = spark.range(11).select(F.col("id").cast("double").alias("v"))
    held = v.agg(c.ordered(F.col("v")).alias("a"), c.linear_quantile(F.col("v"), 0.25).alias("q"))
    r = held.select(c.lower_outward(F.col("a"), 0.3).alias("a"), c.upper_outward(F.col("a"), 0.3).alias("b"), c.nearest_rank(F.col("a"), 0.25).alias("c"), "q").first()
    assert tuple(r) == (1, 9, 3, 2.5)


def test_all_checks_together(spark):
    rows = [("a", t, 100.0 + t % 3, 101.0, 1.0) for t in range(20)]
    pairs = spark.createDataFrame(rows, "series_id string, t long, actual double, baseline double, variance double")
    r = checks.evaluate(pairs, 1.0, pairs.filter("t < 12")).first()
    assert r["n_errors"] == 12 and r["prediction_error_verdict"] == "pass" and r["coverage_verdict"] == "warn" and r["placebo_verdict"] == "skip"
    low = spark.createDataFrame([("a", 10.0, 9.0, 12.0)], "series_id string, lift_base double, lift_low double, lift_high double")
    assert checks.evaluate(pairs, 1.0, stable=checks.stability(low)).first()["effect_stability_verdict"] == "warn"


def test_draws_as_lists(spark):
    assert sorted((r["draw"], list(r["values"])) for r in draws.to_lists(frame(spark, [[1, 2], [3, 4]])).collect()) == [(0, [1, 2]), (1, [3, 4])]


def test_effect_guards(spark):
    r = spark.range(1).select(c.relative_effect(F.lit(5.0), F.lit(0.0)).alias("a"), c.relative_effect(F.lit(5.0), F.lit(10.0)).alias("b"), c.dot(F.array(F.lit(0.5), F.lit(-0.2)), F.array(F.lit(10.0), F.lit(3.0))).alias("c")).first()
    assert (r["a"], r["b"], round(r["c"], 9)) == (0.0, 0.5, 4.4)


def test_dates_that_are_missing_raise(spark):
    import datetime as dt

    dates = spark.createDataFrame([(dt.date(2024, 1, 1 + i),) for i in range(5)], "date date")
    cols = "name string, start_date date, end_date date, baseline_start_date date, baseline_end_date date"
    ok = spark.createDataFrame([("c", dt.date(2024, 1, 4), dt.date(2024, 1, 5), dt.date(2024, 1, 1), dt.date(2024, 1, 3))], cols)
    r = workflows.campaign_indices(dates, ok).first()
    assert (r["start_index"], r["end_index"], r["baseline_start_index"], r["baseline_end_index"]) == (4, 5, 1, 3)
    with pytest.raises(Exception, match="no such date"):
        workflows.campaign_indices(dates, ok.withColumn("end_date", F.lit("2030-01-01").cast("date"))).collect()


def test_synthetic_truth_sums_to_the_contribution():
    from tidelens.kernels.series import scenarios

    g = synthetic.generate(scenarios()["a"])
    assert abs(sum(g["attribution"].values()) - g["contribution"].sum()) < 1e-6 * g["contribution"].sum()
    assert g["controls"].shape == (3, 14 * 1440)


def test_stream_of_two_batches_keeps_the_state(spark, tmp_path):
    import datetime as dt

    from tidelens.kernels.series import step_detector

    rows = [("a", dt.datetime(2024, 1, 1, i), float(v)) for i, v in enumerate([10, 11, 9, 30, 10])]
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "series_id string, ts timestamp, y double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = online.score_stream(spark.readStream.schema("series_id string, ts timestamp, y double").parquet(str(tmp_path / "in")), 1.0, 4.0, 1.0, 0.05)
        q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = [(r["value"], round(r["predicted"], 9), r["anomaly"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()]
    x, p, want = 10.0, 1.0, []
    for _, _, y in rows[1:]:
        m, sd, x, p = step_detector(x, p, y, 1, 1, 1.0, 4.0)
        want.append((y, round(m, 9), abs(y - m) / sd > 1.959964))
    assert got == want and [a for *_, a in got] == [False, False, True, True]


def test_stream_drops_late_rows(spark, tmp_path):
    schema = "series_id string, ts timestamp, y double"
    for k, rows in enumerate([[("a", "2024-01-05 00:00:00", 1.0)], [("a", "2024-01-06 00:00:00", 2.0)], [("a", "2024-01-01 02:00:00", 50.0), ("a", "2024-01-06 01:00:00", 3.0)]]):
        spark.createDataFrame(rows, "series_id string, ts string, y double").selectExpr("series_id", "CAST(ts AS timestamp) AS ts", "y").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = online.score_stream(stream, idle_ms=10**9)
    got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(online.SCHEMA).parquet(f"{tmp_path}/out").orderBy("ts").collect()
    assert [r["value"] for r in rows] == [2.0, 3.0]


def test_normal_probabilities(spark):
    import math

    zs = [-40.0, -8.5, -3.0, -1.0, -1e-9, 0.0, 0.3, 2.9999, 4.25, 6.0, 30.0]
    rows = spark.createDataFrame([(z,) for z in [*zs, None, float("nan")]], "z double").select("z", c.normal_cdf(F.col("z")).alias("p"), c.p_positive(F.col("z"), F.lit(0.0)).alias("s")).collect()
    for r in rows[: len(zs)]:
        want = 0.5 * math.erfc(-r["z"] / math.sqrt(2))
        assert abs(r["p"] - want) <= 1e-14 + 1e-12 * want
        assert r["s"] == (1.0 if r["z"] > 0 else 0.0 if r["z"] < 0 else 0.5)
    assert rows[-2]["p"] is None and math.isnan(rows[-1]["p"])


def test_long_adstock_path(spark):
    values = [float(i % 7) for i in range(1000)]
    got = spark.createDataFrame([(values,), ([],)], "v array<double>").select(c.adstock_path(F.col("v"), 0.5).alias("a")).collect()
    run, want = 0.0, []
    for v in values:
        run = v + 0.5 * run
        want.append(run)
    assert [round(x, 9) for x in got[0]["a"]] == [round(x, 9) for x in want] and got[1]["a"] == []


def test_attribution_rejects_repeated_ids(spark):
    cf = spark.createDataFrame([("s", t, 1.0, 0.0, 1.0) for t in range(5)], "series_id string, t long, y double, cf_mean double, cf_var double")
    spots = spark.createDataFrame([("s", "a", 0, 2), ("s", "a", 3, 5)], "series_id string, spot_id string, ws long, we long")
    with pytest.raises(Exception, match="unique"):
        attribution.attribute(cf, spots).collect()


def test_a_kept_fit_predicts_any_horizon(spark):
    fit = spark.createDataFrame([("s", 0, d, 4.0, [1.0], [10.0]) for d in range(400)], "series_id string, chain int, draw long, obs_var double, q array<double>, x_last array<double>")
    short, long = (sorted(map(tuple, models.predict_draws(fit, n, seed=3).collect())) for n in (2, 6))
    assert [r for r in long if r[3] <= 2] == short and len(long) == 2400
    last = [r[4] for r in long if r[3] == 6]
    mean = sum(last) / 400
    assert abs(mean - 10) < 0.6 and abs(sum((v - mean) ** 2 for v in last) / 399 - 10) < 2.5
    spec = ms.local_linear_trend(0.0, 0.0, 0.0)
    flat = spark.createDataFrame([("s", 0, 0, 0.0, [0.0, 0.0], [10.0, 2.0])], "series_id string, chain int, draw long, obs_var double, q array<double>, x_last array<double>")
    assert [r["value"] for r in models.predict_draws(flat, 3, spec).orderBy("h").collect()] == [12.0, 14.0, 16.0]


def test_a_universe_must_not_be_negative(spark):
    a = frame(spark, [[1, 2]])
    with pytest.raises(ValueError, match="negative"):
        draws.audience(a, a, -1.0)
    with pytest.raises(Exception, match="negative"):
        draws.audience(a, a, spark.createDataFrame([(1, -1.0), (2, 1.0)], "h long, value double")).collect()
    assert sorted(r["value"] for r in draws.audience(a, a, a).collect()) == [1.0, 8.0]


def test_scratch_folders_can_be_cleared(spark):
    from tidelens.sources import scratch

    scratch.clear(spark)
    kept = scratch.written(spark.range(3), "x")
    path = kept.inputFiles()[0]
    assert kept.count() == 3 and scratch.clear(spark) == 1 and scratch.clear(spark) == 0
    assert not Path(path.removeprefix("file:").replace("///", "/")).exists()
