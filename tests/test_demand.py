import datetime as dt
import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vanflow.config import DEMAND
from vanflow.operators import classify, evaluate, features, forecasters, mlmodels, panel
from vanflow.plans import train as plan_train

CFG = replace(DEMAND, meta_cols=(), causal_cols=())
RAW = "RouteCode string, ItemCode string, TrxDate date, TotalQuantity double"


def series(item, values, start="2024-01-01"):
    day = dt.date.fromisoformat(start)
    return [("r", item, str(day + dt.timedelta(days=i)), float(v)) for i, v in enumerate(values) if v is not None]


def test_dense_panel_covers_each_pairs_own_calendar(rows):
    df = rows(series("A", [1, None, None, 2]) + series("B", [5]), RAW)
    out = panel.build_panel(df, CFG).orderBy("ItemCode", "TrxDate").collect()
    assert [(r.ItemCode, r.TotalQuantity, r.activity_flag) for r in out] == [
        ("A", 1.0, 1), ("A", 0.0, 0), ("A", 0.0, 0), ("A", 2.0, 1), ("B", 5.0, 1)]


@pytest.mark.parametrize("gran,dates,n", [
    ("W", ("2024-01-03", "2024-01-30"), 5), ("M", ("2024-01-31", "2024-05-01"), 5),
    ("Q", ("2024-01-31", "2025-01-01"), 5), ("Y", ("2020-02-29", "2024-02-29"), 5)])
def test_coarser_periods_are_dense_too(rows, gran, dates, n):
    df = rows([("r", "A", d, 1.0) for d in dates], RAW)
    assert panel.build_panel(df, replace(CFG, granularity=gran)).count() == n


def test_zero_only_pair_is_intermittent_with_infinite_interval(rows):
    row = classify.classify_dataset(rows(series("A", [0, 0, 0]), RAW), CFG).first()
    assert row["adi"] == float("inf") and row["cv2"] is None and row["class"] == "intermittent"
    stats = classify.pair_explainability(rows(series("A", [0, 0, 0]), RAW), CFG).first()
    assert stats["adi"] is None and stats["avg_gap_between_demand"] is None and stats["nonzero_mean"] == 0.0


@pytest.mark.parametrize("values,label", [
    ([5, 5, 5, 5], "smooth"), ([5, 0, 0, 5], "intermittent"), ([1, 20, 1, 1], "erratic"), ([1, 0, 0, 20], "lumpy")])
def test_the_four_classes(rows, values, label):
    assert classify.classify_dataset(rows(series("A", values), RAW), CFG).first()["class"] == label


def test_inactive_pairs_drop_out(rows):
    df = rows(series("A", [1, 0, 0, 0, 0, 0]) + series("B", [1, 0, 0, 1, 0, 0]), RAW)
    kept = panel.drop_inactive_pairs(df, replace(CFG, max_inactivity_periods=2))
    assert {r.ItemCode for r in kept.collect()} == {"B"}


def test_outliers_are_clipped_for_regular_pairs_only(rows):
    values = [10, 11, 9, 10, 12, 10, 9, 11, 10, 500]
    train = rows(series("A", values) + series("B", [0, 0, 0, 0, 0, 0, 0, 0, 9, 500]), RAW)
    classes = classify.classify_dataset(train, CFG).withColumn(
        "class", F.when(F.col("ItemCode") == "A", "smooth").otherwise("lumpy"))
    out = panel.treat_outliers(train, panel.outlier_bounds(train, CFG), classes, CFG)
    top = {r.ItemCode: r.m for r in out.groupBy("ItemCode").agg(F.max("TotalQuantity").alias("m")).collect()}
    q1, q3 = np.percentile(values, [25, 75])
    assert top == {"A": q3 + 3 * (q3 - q1), "B": 500.0}


def test_rolling_and_gap_features_match_pandas(rows):
    rng = random.Random(3)
    values = [rng.choice([0, 0, 3, 8]) for _ in range(40)]
    df = rows(series("A", values), RAW)
    out = features.rolling_features(df, CFG, (7,), ("mean", "std", "median", "sum", "nonzero_ratio"))
    out = features.intermittent_features(out, CFG).orderBy("TrxDate").toPandas()
    shifted = pd.Series(values, dtype=float).shift(1)
    roll = shifted.rolling(7, min_periods=1)
    for name, want in (("mean", roll.mean()), ("std", roll.std()), ("median", roll.median()), ("sum", roll.sum())):
        np.testing.assert_allclose(out[f"roll_{name}_7"].astype(float), want)
    np.testing.assert_allclose(
        out["roll_nonzero_ratio_7"].astype(float), roll.apply(lambda x: (x > 0).sum() / len(x), raw=True))
    np.testing.assert_allclose(
        out["inter_demand_interval"].astype(float),
        shifted.expanding().apply(lambda x: len(x) / max((x > 0).sum(), 1), raw=True))


def test_croston_by_hand(rows):
    level = forecasters.stat_levels(rows(series("A", [0, 3, 0, 0, 5]), RAW), CFG).first()
    z, p = 0.4 * 5 + 0.6 * 3, 0.4 * 3 + 0.6 * 2
    assert level["croston"] == pytest.approx(z / p)
    assert level["croston_sba"] == pytest.approx(0.8 * z / p)
    assert level["naive"] == 5.0 and level["moving_average"] == pytest.approx(8 / 5)


def test_short_histories_smooth_to_their_mean_and_unseen_pairs_to_zero(rows):
    levels = forecasters.stat_levels(rows(series("A", [2, 4, 6]), RAW), CFG)
    assert levels.first()["ets"] == pytest.approx(4.0)
    ahead = rows(series("A", [0]) + series("Z", [0]), RAW)
    out = forecasters.flat_forecast(levels, ahead, CFG, ["ets"])
    assert {r.ItemCode: r.prediction for r in out.collect()} == {"A": 4.0, "Z": 0.0}


def test_seasonal_smoothing_follows_the_cycle(rows):
    values = [10, 0, 0, 0, 0, 0, 20] * 8
    out = forecasters.seasonal_smoothing(rows(series("A", values), RAW), CFG, 7, trend=False, season=7)
    pred = [r.prediction for r in out.orderBy("step").collect()]
    np.testing.assert_allclose(pred, values[:7], atol=1.0)


def test_a_batch_is_smoothed_like_each_series_alone():
    draw = np.random.default_rng(3)
    series = [draw.gamma(2.0, 5.0, n) * (draw.random(n) < 0.6) for n in (14, 15, 29, 60)]
    for trend, season in ((True, 7), (False, 7), (True, 0), (False, 0)):
        together = forecasters._smoothed_forecasts(series, trend, season, 9)
        alone = np.vstack([forecasters._smoothed_forecasts([y], trend, season, 9) for y in series])
        np.testing.assert_allclose(together, alone)


def test_ensemble_weights_sum_to_one_and_skip_unusable_metrics(spark):
    metrics = spark.createDataFrame(
        [("smooth", "a", 2.0), ("smooth", "b", 4.0), ("smooth", "c", float("inf")), ("smooth", "d", None)],
        "class string, model string, rmse double")
    got = {r.model: r.weight for r in forecasters.inverse_metric_weights(metrics, "rmse").collect()}
    assert got == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}


def test_crossed_bounds_are_put_in_order(spark):
    df = spark.createDataFrame([(9.0, 3.0, 5.0), (-2.0, 4.0, 1.0)], "q_10 double, q_90 double, prediction double")
    out = [(r.q_10, r.q_90) for r in evaluate.merge_intervals(df).collect()]
    assert out == [(3.0, 9.0), (0.0, 4.0)]


def test_metrics_without_sales_are_null(rows):
    df = rows(series("A", [0, 0]), RAW).withColumn("prediction", F.lit(0.0))
    row = evaluate.compute_metrics(df, CFG).first()
    assert row.mape is None and row.wape is None and row.rmse == 0.0


def test_first_model_wins_a_tie(rows):
    base = rows(series("A", [4, 4]), RAW).withColumn("class", F.lit("smooth"))
    both = base.select("*", F.explode(F.array(F.lit("moving_average"), F.lit("naive"))).alias("model"))
    best = evaluate.best_model_per_pair(both.withColumn("prediction", F.lit(3.0)), CFG)
    assert best.first().best_model == "naive"


def test_learned_models_beat_the_mean_and_never_go_negative(rows):
    rng = np.random.default_rng(1)
    data = []
    for i in range(300):
        x = float(rng.integers(0, 10))
        data.append(("r", f"i{i % 3}", str(dt.date(2024, 1, 1) + dt.timedelta(days=i // 3)), max(0.0, 3 * x - 8), x))
    df = rows(data, RAW + ", x double").withColumn("hole", F.when(F.col("x") > 5, F.col("x")))
    light = mlmodels.MLSettings({n: {"rounds": 5, "depth": 4, "step": 0.5}
                                 for n in ("random_forest", "gradient_boosting", "leafwise_trees", "depthwise_trees")})
    spread = df.agg(F.stddev_pop("TotalQuantity")).first()[0]
    for name in mlmodels.ML_MODELS:
        fitted = mlmodels.fit_model(name, df, CFG, ["x", "hole"], light)
        out = mlmodels.predict(fitted, df, CFG, keep=["TotalQuantity"])
        row = out.agg(F.sqrt(F.avg(F.pow(F.col("TotalQuantity") - F.col("prediction"), 2))).alias("rmse"),
                      F.min("prediction").alias("low"), F.count("p_demand").alias("n")).first()
        assert row.rmse < spread and row.low >= 0 and row.n == 300, name


def test_two_stage_with_few_positives_uses_the_mean(rows):
    df = rows(series("A", [0, 0, 0, 4]), RAW).withColumn("x", F.lit(1.0))
    fitted = mlmodels.fit_model("two_stage", df, CFG, ["x"])
    assert fitted.model is None and fitted.constant == 1.0


def test_training_covers_unnamed_classes_and_survives_storage(rows, spark, tmp_path):
    rng = random.Random(4)
    data = []
    for i in range(4):
        data += series(f"S{i}", [10 + rng.random() for _ in range(500)])
        data += series(f"L{i}", [rng.choice((0, 0, 0, 1, 30)) for _ in range(500)])
    cfg = replace(CFG, tuning_trials=2, models={"smooth": ("moving_average", "linear", "depthwise_trees", "ensemble")})
    small = mlmodels.MLSettings({"depthwise_trees": {"rounds": 5, "depth": 2}})
    raw = rows(data, RAW)
    done = plan_train.train(raw, cfg, settings=small, tune=("depthwise_trees",))
    pairs = {(r.ItemCode, r["class"]) for r in done.classes.collect()}
    assert {c for _, c in pairs} > {"smooth"}
    used = {(r["class"], r.model) for r in done.val.select("class", "model").distinct().collect()}
    for cls in {c for _, c in pairs} - {"smooth"}:
        assert {m for c, m in used if c == cls} == set(cfg.fallback_models)
    assert {m for c, m in used if c == "smooth"} == {"moving_average", "linear", "depthwise_trees", "ensemble"}

    plan_train.save_trained(done, str(tmp_path / "run"))
    again = plan_train.load_trained(spark, str(tmp_path / "run"))
    columns = ["ItemCode", "TrxDate", "model_used", "prediction", "q_10", "q_90"]
    ahead, reread = (
        sorted(map(tuple, plan_train.infer(raw, t, cfg).select(*columns).collect())) for t in (done, again)
    )
    assert ahead == reread and {r[0] for r in ahead} == {i for i, _ in pairs}


def test_boosting_stops_when_held_rows_gain_nothing(rows):
    data = [("r", "A", "2024-01-01", float(i % 2), float(i % 2)) for i in range(80)]
    df = rows(data, RAW + ", x double")
    settings = mlmodels.MLSettings({"gradient_boosting": {"rounds": 200, "depth": 2, "step": 0.5, "patience": 5}})
    fitted = mlmodels.fit_model("gradient_boosting", df, CFG, ["x"], settings, df)
    assert fitted.rounds == len(fitted.model.roots) < 200


def test_one_usable_model_makes_no_ensemble(rows):
    scores = rows([("a", "m1", 1.0), ("a", "m2", 3.0), ("b", "m1", 2.0), ("b", "m2", None)], "class string, model string, rmse double")
    out = forecasters.inverse_metric_weights(scores, "rmse", least=2).orderBy("model").collect()
    assert [(r["class"], r.model, round(r.weight, 6)) for r in out] == [("a", "m1", 0.75), ("a", "m2", 0.25)]
