"""Training sweep and inference over demand classes."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanflow.config import DemandConfig
from vanflow.operators import classify, evaluate, features, forecasters, mlmodels, panel, trees
from vanflow.session import cut_lineage

FITS_AT_ONCE = 4


@dataclass(frozen=True)
class Trained:
    """Everything inference and the dashboards need from a training run."""

    features: DataFrame
    feature_columns: list[str]
    classes: DataFrame
    explainability: DataFrame
    val: DataFrame
    test: DataFrame
    metrics: DataFrame
    weights: DataFrame
    best: DataFrame
    test_best: DataFrame
    models: dict[tuple[str, str], mlmodels.Fitted] = field(default_factory=dict)
    bounds: dict[tuple[str, str], mlmodels.Fitted] = field(default_factory=dict)


def prepare_features(
    raw: DataFrame, cfg: DemandConfig, calendar: DataFrame | None = None,
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Panel to features: (features with split, classes, explainability, treated panel)."""
    built = panel.drop_inactive_pairs(
        panel.build_panel(raw, cfg), cfg, panel.latest_period(raw, cfg)
    )
    whole = materialise(panel.clip_negative_to_zero(built, cfg.target_col))
    train = panel.train_window(whole, cfg)
    classes = materialise(classify.classify_dataset(train, cfg))
    treated = materialise(
        panel.treat_outliers(whole, panel.outlier_bounds(train, cfg), classes, cfg)
    )
    stats = classify.pair_explainability(panel.train_window(treated, cfg), cfg)
    feats = features.build_features(
        treated, classes, cfg, panel.train_window(treated, cfg), calendar
    )
    latest = panel.latest_period(treated, cfg)
    return materialise(panel.time_based_split(feats, cfg, latest)), classes, stats, treated


def _with_class(predictions: DataFrame, cls: str, model: str) -> DataFrame:
    return predictions.withColumns({"class": F.lit(cls), "model": F.lit(model)})


def _stat_predictions(
    fit: DataFrame, rows: DataFrame, classes: DataFrame, cfg: DemandConfig, always: Sequence[str] = ()
) -> DataFrame:
    """All statistical models for all classes in one job, then each class's own ones and those named in `always`.

    A class that the configuration does not name gets the fallback models.
    """
    keys = list(cfg.group_keys)
    levels = forecasters.stat_levels(fit, cfg)
    flat = forecasters.flat_forecast(levels, rows.select(*keys, cfg.date_col, cfg.target_col), cfg)
    enabled = F.col("model").isin(*always) if always else F.lit(False)
    unnamed = ~F.coalesce(F.col("class").isin(*cfg.models), F.lit(False))
    enabled = enabled | (unnamed & F.col("model").isin(*cfg.fallback_models))
    for cls, models in cfg.models.items():
        own = [m for m in models if m in forecasters.STAT_MODELS]
        if own:
            enabled = enabled | ((F.col("class") == cls) & F.col("model").isin(own))
    tagged = flat.join(classes.select(*keys, "class"), keys).filter(enabled)
    return evaluate.demand_probability(tagged)


def train(
    raw: DataFrame, cfg: DemandConfig, calendar: DataFrame | None = None,
    settings: mlmodels.MLSettings = mlmodels.MLSettings(), tune: Sequence[str] = (),
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> Trained:
    """Fit every enabled model per class, score validation and test, select per pair.

    Selection uses validation scores, and so do the ensemble weights. Bounds come
    from two quantile models per class, fitted on all rows before the test. Searches
    and tree models of all classes are fitted side by side, one a task; linear
    models and gates are distributed jobs over all rows of the class.
    """
    feats, classes, stats, treated = prepare_features(raw, cfg, calendar, materialise)
    columns = features.feature_columns(feats, cfg)
    part = lambda name: feats.filter(F.col("split") == name)
    fit_all = feats.filter("split <> 'test'")
    val_parts = [_stat_predictions(part("train"), part("val"), classes, cfg)]
    test_parts = [_stat_predictions(fit_all, part("test"), classes, cfg)]
    order = val_parts[0].columns
    models: dict[tuple[str, str], mlmodels.Fitted] = {}
    # A class without training rows keeps its statistical models.
    present = {r["class"] for r in part("train").select("class").distinct().collect()}

    wanted = [(c, m) for c in cfg.models if c in present for m in cfg.models[c] if m in mlmodels.ML_MODELS]
    regressor = settings.of("two_stage")["regressor"]
    # The positive rows of a class are a group of their own, for the two-stage model's regressor.
    sold = F.col(cfg.target_col) > 0
    grouped = feats.withColumn("group", F.explode(F.when(sold, F.array("class", F.concat("class", F.lit("+")))).otherwise(F.array("class"))))
    bins = trees.binning(part("train"), columns)
    searched = [(c, m) for c, m in wanted if m in tune]
    chosen = {(c, m): settings for c, m in wanted}
    if searched:
        found, _ = mlmodels.random_search(searched, grouped.filter("split <> 'test'"), cfg, bins, settings)
        chosen |= found
    fits = {(c, m): chosen[c, m] for c, m in wanted if m in mlmodels.TREES}
    fits |= {(f"{c}+", regressor): chosen.get((c, regressor), settings) for c, m in wanted if m == "two_stage"}
    asked = {(c, mlmodels.quantile_name(q)): settings
             for c in present for q in cfg.interval_quantiles}
    fits |= asked
    held = grouped.filter("split <> 'test'").withColumn("held", F.col("split") == "val")
    first = mlmodels.fit_trees(mlmodels.tree_rows(held, cfg, bins), bins, fits, cfg)
    rounds = mlmodels.rounds_kept(first)
    full = mlmodels.fit_trees(mlmodels.tree_rows(held.withColumn("held", F.lit(False)), cfg, bins), bins, fits, cfg, rounds)
    bounds = {pair: full.pop(pair) for pair in asked if pair in full}

    def fit_rest(cls: str, name: str) -> tuple[mlmodels.Fitted, mlmodels.Fitted]:
        own = lambda df: df.filter(F.col("class") == cls)
        if name == "linear":
            return tuple(mlmodels.fit_linear(own(df), cfg, columns, settings) for df in (part("train"), fit_all))
        return tuple(
            mlmodels.two_stage(mlmodels.fit_gate(own(df), cfg, columns), fitted.get((f"{cls}+", regressor)), columns, cfg)
            for df, fitted in ((part("train"), first), (fit_all, full))
        )

    in_session = inheritable_thread_target(feats.sparkSession)
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        # Jobs of small classes leave cores idle, so fits run side by side on one session.
        rest = {pair: pool.submit(in_session(fit_rest), *pair) for pair in wanted if pair[1] not in mlmodels.TREES}
    for cls, name in wanted:
        pair = (cls, name)
        before, models[pair] = rest[pair].result() if pair in rest else (first[pair], full[pair])
        for fitted, split, parts in ((before, "val", val_parts), (models[pair], "test", test_parts)):
            scored = mlmodels.predict(fitted, part(split).filter(F.col("class") == cls), cfg, keep=[cfg.target_col])
            parts.append(_with_class(scored, cls, name).select(*order))
    val = materialise(mlmodels.union_all(val_parts))
    test = materialise(mlmodels.union_all(test_parts))
    weights = materialise(
        forecasters.inverse_metric_weights(
            evaluate.compute_metrics(val, cfg, ["class", "model"]), cfg.selection_metric, least=2
        ).filter(F.col("class").isin([c for c, m in cfg.models.items() if "ensemble" in m]))
    )
    val, test = _add_ensemble(val, weights, cfg), _add_ensemble(test, weights, cfg)
    metrics = materialise(evaluate.compute_metrics(test, cfg, ["class", "model"]))
    best = materialise(evaluate.best_model_per_pair(val, cfg))
    stitched = evaluate.stitch_best(test, best, cfg)
    learned = mlmodels.predict_bounds(bounds, part("test"), cfg)
    with_bounds = evaluate.merge_intervals(evaluate.join_bounds(stitched, learned, cfg))
    published = evaluate.join_explainability(with_bounds, stats, cfg)
    return Trained(feats, columns, classes, stats, val, test, metrics, weights, best, published, models, bounds)


def _add_ensemble(predictions: DataFrame, weights: DataFrame, cfg: DemandConfig) -> DataFrame:
    """Append the weighted mean of each class's models as a further model."""
    keys = [*cfg.group_keys, cfg.date_col]
    blended = forecasters.weighted_ensemble(predictions, weights, cfg)
    actual = predictions.select(*keys, cfg.target_col).distinct()
    rows = evaluate.demand_probability(blended.join(actual, keys))
    return predictions.unionByName(rows.select(*predictions.columns))


def infer(
    raw: DataFrame, trained: Trained, cfg: DemandConfig, calendar: DataFrame | None = None,
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Future forecast of every classified pair with its best model.

    Features run over history plus the future skeleton (targets 0 there). Pairs
    without a selected model use the moving average.
    """
    keys = list(cfg.group_keys)
    history = panel.build_panel(raw, cfg).join(trained.classes.select(*keys), keys, "left_semi")
    history = materialise(history)
    future = evaluate.future_skeleton(history, cfg)
    full = history.unionByName(future)
    built = features.build_features(full, trained.classes, cfg, history, calendar)
    last = history.groupBy(*keys).agg(F.max(cfg.date_col).alias("_last"))
    ahead = materialise(
        built.join(last, keys).filter(F.col(cfg.date_col) > F.col("_last")).drop("_last")
    )
    for missing in [c for c in trained.feature_columns if c not in ahead.columns]:
        ahead = ahead.withColumn(missing, F.lit(0.0))
    parts = [_stat_predictions(history, ahead, trained.classes, cfg, always=["moving_average"])]
    order = parts[0].columns
    for (cls, name), fitted in trained.models.items():
        rows = ahead.filter(F.col("class") == cls)
        scored = mlmodels.predict(fitted, rows, cfg, keep=[cfg.target_col])
        parts.append(_with_class(scored, cls, name).select(*order))
    long = _add_ensemble(materialise(mlmodels.union_all(parts)), trained.weights, cfg)
    lookup = trained.classes.select(*keys).join(
        trained.best.select(*keys, "best_model"), keys, "left"
    ).withColumn("best_model", F.coalesce("best_model", F.lit("moving_average")))
    forecast = evaluate.stitch_best(long, lookup, cfg).drop(cfg.target_col)
    learned = mlmodels.predict_bounds(trained.bounds, ahead, cfg)
    bounded = evaluate.merge_intervals(evaluate.join_bounds(forecast, learned, cfg))
    named = bounded.withColumnRenamed("best_model", "model_used")
    return evaluate.join_explainability(named, trained.explainability, cfg)



_FRAMES = ("features", "classes", "explainability", "val", "test", "metrics", "weights", "best", "test_best")
_INDEX = (
    "class string, model string, fitted string, features array<string>, trees binary, has_model boolean, has_gate boolean, "
    "constant double, threshold double, rounds int"
)


def save_trained(trained: Trained, path: str) -> None:
    """Write a training run to a folder: its frames, fitted pipelines and an index of both that holds the trees."""
    spark = trained.features.sparkSession
    for name in _FRAMES:
        getattr(trained, name).write.mode("overwrite").parquet(f"{path}/{name}")
    rows = []
    for (cls, name), fitted in (trained.models | trained.bounds).items():
        grown = pickle.dumps((fitted.model, fitted.bins)) if isinstance(fitted.model, trees.Trees) else None
        pipeline = None if grown else fitted.model
        for part, stored in (("model", pipeline), ("gate", fitted.gate)):
            if stored is not None:
                stored.write().overwrite().save(f"{path}/fitted/{cls}/{name}/{part}")
        rows.append((cls, name, fitted.name, list(fitted.features), grown, pipeline is not None, fitted.gate is not None,
                     fitted.constant, fitted.threshold, fitted.rounds))
    spark.createDataFrame(rows, _INDEX).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    columns = spark.createDataFrame([(trained.feature_columns,)], "names array<string>")
    columns.coalesce(1).write.mode("overwrite").parquet(f"{path}/feature_columns")


def load_trained(spark: SparkSession, path: str) -> Trained:
    """Read back what `save_trained` wrote, so that inference runs as a job of its own."""
    models, bounds = {}, {}
    for r in spark.read.parquet(f"{path}/index").collect():
        at = f"{path}/fitted/{r['class']}/{r['model']}"
        model, bins = pickle.loads(r["trees"]) if r["trees"] else (None, None)
        if r["has_model"]:
            model = PipelineModel.load(f"{at}/model")
        kept = bounds if r["fitted"].startswith(mlmodels.QUANTILE) else models
        kept[(r["class"], r["model"])] = mlmodels.Fitted(
            r["fitted"], tuple(r["features"]), model, r["constant"],
            PipelineModel.load(f"{at}/gate") if r["has_gate"] else None, r["threshold"], bins, r["rounds"],
        )
    frames = {name: spark.read.parquet(f"{path}/{name}") for name in _FRAMES}
    names = spark.read.parquet(f"{path}/feature_columns").first()["names"]
    return Trained(**frames, feature_columns=names, models=models, bounds=bounds)
