"""Error metrics, temporal folds, model selection and forecast assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanflow.config import DemandConfig
from vanflow.functions.numeric import percentiles_by_key, py_round
from vanflow.functions.periods import shift_periods

METRICS = ("mae", "rmse", "mape", "smape", "bias", "wape")


def metric_columns(y: str, p: str, names: Sequence[str] = METRICS, eps: float = 1e-9) -> list[Column]:
    """Metrics as aggregates; percentages are null where no row qualifies."""
    a, f = F.col(y), F.col(p)
    err = F.abs(a - f)
    sold = a > eps
    built = {
        "mae": F.avg(err),
        "rmse": F.sqrt(F.avg((a - f) * (a - f))),
        "mape": F.avg(F.when(F.abs(a) > eps, F.abs((a - f) / a))) * 100.0,
        "smape": F.avg(err / ((F.abs(a) + F.abs(f)) / 2.0 + eps)) * 100.0,
        "bias": F.avg(f - a),
        "wape": F.sum(F.when(sold, err)) / F.sum(F.when(sold, a)) * 100.0,
    }
    return [built[n].alias(n) for n in names]


def compute_metrics(
    predictions: DataFrame, cfg: DemandConfig, by: Sequence[str] = (),
    names: Sequence[str] = METRICS,
) -> DataFrame:
    return predictions.groupBy(*by).agg(*metric_columns(cfg.target_col, "prediction", names))


def accuracy(y: Column, p: Column) -> Column:
    """max(0, 100 - WAPE) over rows with positive actuals; null without any."""
    sold = y > 0
    wape = F.sum(F.when(sold, F.abs(y - p))) / F.sum(F.when(sold, y)) * 100
    return F.when(wape.isNotNull(), F.greatest(F.lit(0.0), 100 - wape))


def temporal_folds(df: DataFrame, cfg: DemandConfig) -> DataFrame:
    """Cut-off dates of the folds: the last n dates, each validated on its own.

    Fewer than n + 2 dates give no folds; a fold needs two earlier dates.
    """
    dates = df.select(F.col(cfg.date_col).alias("cutoff")).distinct()
    total = dates.agg(F.count(F.lit(1))).scalar()
    last = dates.orderBy(F.desc("cutoff")).limit(cfg.cv_splits)
    order = Window.orderBy("cutoff")  # at most n rows
    return (
        last.filter(total >= cfg.cv_splits + 2)
        .withColumn("fold", F.row_number().over(order))
        .filter(total - cfg.cv_splits + F.col("fold") - 1 >= 2)
        .select("fold", "cutoff")
    )


def fold_sizes(df: DataFrame, cfg: DemandConfig) -> DataFrame:
    """Training and validation rows of each fold, from per-date counts."""
    per_date = df.groupBy(F.col(cfg.date_col).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    folds = temporal_folds(df, cfg)
    return (
        per_date.join(F.broadcast(folds), F.col("_d") <= F.col("cutoff"))
        .groupBy("fold", "cutoff")
        .agg(
            F.sum(F.when(F.col("_d") < F.col("cutoff"), F.col("_n")).otherwise(0)).alias("train_rows"),
            F.sum(F.when(F.col("_d") == F.col("cutoff"), F.col("_n")).otherwise(0)).alias("val_rows"),
        )
    )


def _rank_score(metric: str) -> Column:
    usable = F.col(metric).isNotNull() & ~F.isnan(metric)
    return F.when(usable, F.col(metric)).otherwise(F.lit(float("inf")))


def model_order(cfg: DemandConfig) -> Column:
    """Position of the model in its class's list; earlier models win ties."""
    branches = None
    for cls, names in cfg.models.items():
        for i, name in enumerate(names):
            cond = (F.col("class") == cls) & (F.col("model") == name)
            branches = F.when(cond, i) if branches is None else branches.when(cond, i)
    return branches.otherwise(99)


def best_model_per_pair(predictions: DataFrame, cfg: DemandConfig) -> DataFrame:
    """Winner of the selection metric for every pair."""
    scores = compute_metrics(
        predictions, cfg, [*cfg.group_keys, "class", "model"], [cfg.selection_metric]
    )
    ranked = F.struct(
        _rank_score(cfg.selection_metric).alias("score"), model_order(cfg).alias("order"), "model"
    )
    return (
        scores.groupBy(*cfg.group_keys, "class").agg(F.min(ranked).alias("_best"))
        .select(
            *cfg.group_keys, "class",
            F.col("_best.model").alias("best_model"), F.col("_best.score").alias("score"),
        )
    )


def stitch_best(predictions: DataFrame, best: DataFrame, cfg: DemandConfig) -> DataFrame:
    """Rows of each pair's best model."""
    keys = list(cfg.group_keys)
    lookup = best.select(*keys, "best_model")
    return predictions.join(lookup, keys).filter(F.col("model") == F.col("best_model")).drop("model")


def best_model_per_class(metrics: DataFrame, cfg: DemandConfig) -> DataFrame:
    ranked = F.struct(
        _rank_score(cfg.selection_metric).alias("score"), model_order(cfg).alias("order"), "model"
    )
    return (
        metrics.groupBy("class").agg(F.min(ranked).alias("_best"))
        .select("class", F.col("_best.model").alias("best_model"), F.col("_best.score").alias("score"))
    )


def prediction_band(p: Column) -> Column:
    """Residuals are pooled by the order of magnitude of the prediction."""
    return F.floor(F.log2(F.lit(1.0) + F.greatest(p, F.lit(0.0)))).cast("int")


def residual_quantiles(predictions: DataFrame, cfg: DemandConfig) -> DataFrame:
    """Residual quantiles per class and prediction band, on a grid of 0.01 units."""
    residuals = predictions.select(
        "class",
        prediction_band(F.col("prediction")).alias("band"),
        py_round(F.col(cfg.target_col) - F.col("prediction"), 2).alias("residual"),
    )
    low, high = cfg.interval_quantiles
    return percentiles_by_key(
        residuals, ["class", "band"], "residual", {"low_offset": low, "high_offset": high}
    )


def add_intervals(predictions: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Offsets added to the prediction; an unknown band keeps the prediction itself."""
    with_band = predictions.withColumn("band", prediction_band(F.col("prediction")))
    joined = with_band.join(quantiles, ["class", "band"], "left")
    p = F.col("prediction")
    return joined.withColumns(
        {
            "q_10": p + F.coalesce("low_offset", F.lit(0.0)),
            "q_90": p + F.coalesce("high_offset", F.lit(0.0)),
        }
    ).drop("band", "low_offset", "high_offset")


def join_bounds(predictions: DataFrame, bounds: DataFrame, cfg: DemandConfig) -> DataFrame:
    """Bounds of quantile models by row; a row without them has its prediction for both."""
    keys = [*cfg.group_keys, cfg.date_col]
    own = bounds.select(*keys, "q_10", "q_90")
    p = F.col("prediction")
    return predictions.join(own, keys, "left").withColumns({c: F.coalesce(c, p) for c in ("q_10", "q_90")})


def merge_intervals(df: DataFrame) -> DataFrame:
    """Order the bounds around the prediction and floor them at zero."""
    low, high, p = F.greatest("q_10", F.lit(0.0)), F.greatest("q_90", F.lit(0.0)), F.col("prediction")
    return df.withColumns({"q_10": F.least(low, high, p), "q_90": F.greatest(low, high, p)})


def join_explainability(predictions: DataFrame, stats: DataFrame, cfg: DemandConfig) -> DataFrame:
    clash = [c for c in stats.columns if c in predictions.columns and c not in cfg.group_keys]
    for c in clash:
        stats = stats.withColumnRenamed(c, f"{c}_expl")
    return predictions.join(stats, list(cfg.group_keys), "left")


def future_skeleton(panel: DataFrame, cfg: DemandConfig) -> DataFrame:
    """Horizon rows after each pair's last period, carrying its last known attributes."""
    carried = [c for c in (*cfg.meta_cols, *[c for c, _ in cfg.causal_cols]) if c in panel.columns]
    last = panel.groupBy(*cfg.group_keys).agg(
        F.max(cfg.date_col).alias("_last"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(cfg.date_col))).alias(c) for c in carried],
    )
    steps = F.explode(F.sequence(F.lit(1), F.lit(cfg.forecast_horizon))).alias("_step")
    return last.select("*", steps).select(
        *cfg.group_keys,
        shift_periods(F.col("_last"), F.col("_step"), cfg.granularity).alias(cfg.date_col),
        F.lit(0.0).alias(cfg.target_col),
        F.lit(0).alias("activity_flag"),
        *carried,
    )


def demand_probability(df: DataFrame) -> DataFrame:
    """Models without their own probability are certain where they predict demand."""
    p = F.col("prediction")
    if "p_demand" not in df.columns:
        return df.withColumns({"p_demand": (p > 0).cast("double"), "qty_if_demand": p})
    return df.withColumns(
        {
            "p_demand": F.coalesce("p_demand", (p > 0).cast("double")),
            "qty_if_demand": F.coalesce("qty_if_demand", p),
        }
    )


def future_route_summary(
    forecast: DataFrame, cfg: DemandConfig, date: str | None = None
) -> DataFrame:
    if date is not None:
        forecast = forecast.filter(F.col(cfg.date_col) == F.lit(date).cast("date"))
    route, item = cfg.group_keys[0], cfg.group_keys[1]
    return forecast.groupBy(F.col(route).alias("route_code")).agg(
        F.countDistinct(item).alias("skus"),
        py_round(F.sum("prediction"), 1).alias("predicted_qty"),
    )


def forecast_kpis(
    test: DataFrame, classes: DataFrame, future: DataFrame, cfg: DemandConfig
) -> DataFrame:
    y, p = F.col(cfg.target_col), F.col("prediction")
    scored = test.agg(
        py_round(F.coalesce(accuracy(y, p), F.lit(0.0)), 2).alias("accuracy_pct"),
        F.count(F.lit(1)).alias("test_predictions_count"),
    )
    count = F.count(F.lit(1))
    return scored.select(
        "*",
        classes.agg(count).scalar().alias("total_pairs"),
        future.agg(count).scalar().alias("future_forecast_count"),
        future.agg(F.max(cfg.date_col)).scalar().alias("last_forecast_date"),
    )


def training_overview(
    test: DataFrame, metrics: DataFrame, cfg: DemandConfig, feature_count: int
) -> DataFrame:
    """Winner, score and number of competitors per class next to the test window's extent."""
    winners = best_model_per_class(metrics, cfg)
    competed = metrics.groupBy("class").agg(F.count(F.lit(1)).alias("models_competed"))
    route, item = cfg.group_keys[0], cfg.group_keys[1]
    span = test.agg(
        F.min(cfg.date_col).alias("a"), F.max(cfg.date_col).alias("b"),
        F.countDistinct(route).alias("r"), F.countDistinct(item).alias("i"),
    )
    whole = {
        "test_date_start": "a", "test_date_end": "b", "test_routes": "r", "test_items": "i",
    }
    return winners.join(competed, "class").select(
        "class", "best_model", py_round("score", 1).alias("score"), "models_competed",
        *[span.select(c).scalar().alias(name) for name, c in whole.items()],
        F.lit(feature_count).alias("feature_count"),
    )
