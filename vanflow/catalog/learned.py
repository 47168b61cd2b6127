"""Spark ML forecasters, training and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from vanflow.catalog import demand as dm
from vanflow.catalog.helpers import rounded, shared
from vanflow.operators import features, mlmodels, trees
from vanflow.plans import train as tr
from vanflow.session import new_folder

CFG = dm.MONTHLY
FULL = mlmodels.MLSettings()
TUNED = tuple(mlmodels.SEARCH)
_TRAINED: dict = {}
_PREPARED: dict = {}


def _key(s, d):
    return (s.sparkContext.applicationId, d)


def calendar(s, d):
    return shared("calendar", s, d, lambda: features.holiday_names(dm.holiday_calendar(s, d)))


def sales(s, d):
    return shared("monthly-sales", s, d, lambda: dm.monthly_sales(s, d))


def prepared(s, d):
    if _key(s, d) not in _PREPARED:
        _PREPARED[_key(s, d)] = tr.prepare_features(sales(s, d), CFG, calendar(s, d))
    return _PREPARED[_key(s, d)]


def trained(s, d):
    if _key(s, d) not in _TRAINED:
        _TRAINED[_key(s, d)] = tr.train(sales(s, d), CFG, calendar(s, d), FULL, tune=TUNED)
    return _TRAINED[_key(s, d)]


def fit_and_score(name):
    """Fit on the training rows of all classes, predict the validation rows."""

    def run(s, d):
        feats = prepared(s, d)[0]
        columns = features.feature_columns(feats, CFG)
        held = feats.filter("split = 'val'")
        fitted = mlmodels.fit_model(name, feats.filter("split = 'train'"), CFG, columns, FULL, held)
        return mlmodels.predict(fitted, held, CFG, keep=[CFG.target_col])

    return run


def _quantile_models(s, d):
    """Quantile models of every class, rounds chosen on the validation rows, fitted on all rows before the test; bounds of the test rows."""
    feats = prepared(s, d)[0]
    columns = features.feature_columns(feats, CFG)
    before = feats.filter("split <> 'test'").withColumns({"group": F.col("class"), "held": F.col("split") == "val"})
    bins = trees.binning(before, columns)
    names = [r["class"] for r in before.select("class").distinct().collect()]
    wanted = {(c, mlmodels.quantile_name(q)): FULL for c in names for q in CFG.interval_quantiles}
    first = mlmodels.fit_trees(mlmodels.tree_rows(before, CFG, bins), bins, wanted, CFG)
    rows = mlmodels.tree_rows(before.withColumn("held", F.lit(False)), CFG, bins)
    bounds = mlmodels.fit_trees(rows, bins, wanted, CFG, mlmodels.rounds_kept(first))
    return mlmodels.predict_bounds(bounds, feats.filter("split = 'test'"), CFG, keep=["class", CFG.target_col])


def _quantile_coverage(s, d):
    """Rows of each class, and their shares below the lower bound, inside and above the upper one."""
    y = F.col(CFG.target_col)
    return rounded(_quantile_models(s, d).groupBy("class").agg(
        F.count("*").alias("rows"), F.avg((y < F.col("q_10")).cast("double")).alias("below"),
        F.avg(y.between(F.col("q_10"), F.col("q_90")).cast("double")).alias("inside"),
        F.avg((y > F.col("q_90")).cast("double")).alias("above"),
    ))


def _search(s, d):
    """All trials over the whole search space of every tunable model, all classes together."""
    feats = prepared(s, d)[0].filter("split <> 'test'").withColumn("group", F.lit("all"))
    bins = trees.binning(feats, features.feature_columns(feats.drop("group"), CFG))
    _, results = mlmodels.random_search([("all", name) for name in TUNED], feats, CFG, bins, FULL)
    rows = [(r["model"], r["trial"], float(r["score"]), r["rounds"], str(sorted(r["params"].items()))) for r in results]
    return s.createDataFrame(rows, "model string, trial int, score double, rounds int, params string")


def _inference(s, d):
    """Inference from the stored training run, as a job of its own would do it."""
    path = new_folder(s, "trained")
    tr.save_trained(trained(s, d), path)
    return tr.infer(sales(s, d), tr.load_trained(s, path), CFG, calendar(s, d))


QUERIES = {
    "E7_linear": fit_and_score("linear"),
    "E8_random_forest": fit_and_score("random_forest"),
    "E9_gradient_boosting": fit_and_score("gradient_boosting"),
    "E10_leafwise_trees": fit_and_score("leafwise_trees"),
    "E11_depthwise_trees": fit_and_score("depthwise_trees"),
    "E12_quantile_models": lambda s, d: rounded(_quantile_models(s, d)),
    "E12_quantile_coverage": _quantile_coverage,
    "E13_two_stage": fit_and_score("two_stage"),
    "F6_parameter_search": _search,
    "F7_training_sweep": lambda s, d: rounded(trained(s, d).metrics),
    "F7_published_test_predictions": lambda s, d: rounded(trained(s, d).test_best),
    "F8_class_ensembles": lambda s, d: rounded(trained(s, d).test.filter(F.col("model") == "ensemble")),
    "F15_inference": lambda s, d: rounded(_inference(s, d)),
}

ORACLES: dict[str, str] = {}
