"""Learned queries run to the end with the whole search, and their trees are right."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vanflow.catalog import learned
from vanflow.operators import mlmodels, trees

SF = "/root/testdata/sf0.001"
TUNABLE = {"random_forest", "leafwise_trees", "depthwise_trees"}


def signal(n=1500, wide=6, seed=1):
    """Coded features with holes; the target depends on two of them and on what is missing."""
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, wide))
    values[rng.random(values.shape) < 0.15] = np.nan
    filled = np.nan_to_num(values)
    y = 3 * filled[:, 0] + 2 * (filled[:, 1] > 0) * filled[:, 2] + 4 * np.isnan(values[:, 3]) + rng.normal(size=n) * 0.3
    cuts = tuple(tuple(np.nanquantile(values[:, i], np.arange(1, trees.BINS - 1) / (trees.BINS - 1))) for i in range(wide))
    bins = trees.Binning(tuple(f"x{i}" for i in range(wide)), cuts)
    return bins, bins.codes(values), y


def test_first_split_equals_exhaustive_search():
    bins, codes, y = signal(300)
    for keep in (True, False):
        p = trees.TreeParams(rounds=1, depth=1, min_leaf=7, keep_missing=keep)
        model, _, _ = trees.fit(codes, y, p, bins.zero)
        seen = trees.visible(codes, keep, bins.zero)
        best = np.inf
        for f in range(codes.shape[1]):
            for cut in range(trees.MISSING):
                for left in ((seen[:, f] <= cut), (seen[:, f] <= cut) | (seen[:, f] == trees.MISSING)):
                    if min(left.sum(), (~left).sum()) >= 7:
                        best = min(best, sum(((y[s] - y[s].mean()) ** 2).sum() for s in (left, ~left)))
        assert ((y - model.predict(seen)) ** 2).sum() == pytest.approx(best, rel=1e-4)


def test_growth_orders_agree_without_limits():
    bins, codes, y = signal(400)
    level = trees.TreeParams(rounds=3, step=0.5, depth=4, min_leaf=5, l2=1.0, keep_missing=True)
    leaf = trees.TreeParams(rounds=3, step=0.5, depth=4, min_leaf=5, l2=1.0, keep_missing=True, leaves=99)
    a, b = (trees.fit(codes, y, p, bins.zero)[0].predict(codes) for p in (level, leaf))
    assert np.allclose(a, b, atol=1e-3)


def test_boosting_trains_every_round_or_keeps_the_best_prefix():
    bins, codes, y = signal()
    train, held = slice(0, 1000), (codes[1000:], y[1000:])
    whole = trees.TreeParams(rounds=400, step=0.05, leaves=31, min_leaf=10, features=0.9, rows=0.9, keep_missing=True)
    model, rounds, error = trees.fit(codes[train], y[train], whole, bins.zero, held)
    level = trees.TreeParams(rounds=400, step=0.05, depth=6, features=0.9, rows=0.9, l2=1.0, keep_missing=True, patience=50)
    other, kept, level_error = trees.fit(codes[train], y[train], level, bins.zero, held)
    assert rounds == len(model.roots) == 400 and error < 0.35 * y[1000:].std()
    assert 10 < kept == len(other.roots) and error < 1.1 * level_error
    assert trees._error(held[1] - other.predict(held[0]), None) == pytest.approx(level_error)


def test_quantile_models_cover_held_rows():
    bins, codes, y = signal(6000)
    low, high = (
        trees.fit(codes[:4000], y[:4000], trees.TreeParams(rounds=150, step=0.05, leaves=15, min_leaf=40, keep_missing=True, loss=q), bins.zero)[0]
        for q in (0.1, 0.9)
    )
    inside = (low.predict(codes[4000:]) <= y[4000:]) & (y[4000:] <= high.predict(codes[4000:]))
    assert abs(inside.mean() - 0.8) < 0.05


def test_noise_and_constants_keep_the_mean():
    bins, codes, _ = signal(400)
    p = trees.TreeParams(rounds=100, step=0.1, depth=3, patience=5)
    model, rounds, _ = trees.fit(codes, np.full(400, 2.5), p, bins.zero, (codes, np.full(400, 2.5)))
    assert rounds == 0 and (model.predict(codes) == 2.5).all()


def test_parameter_search_runs_every_trial(spark):
    rows = learned.QUERIES["F6_parameter_search"](spark, SF).collect()
    assert {r.model for r in rows} == TUNABLE and len(rows) == 45
    assert all(r.rounds > 0 and np.isfinite(r.score) for r in rows)


def test_sweep_ensembles_and_inference_run_to_the_end(spark):
    run = learned.trained(spark, SF)
    used = {(r["class"], r["model"]) for r in learned.QUERIES["F7_training_sweep"](spark, SF).collect()}
    for cls in {c for c, _ in used}:
        assert {m for c, m in used if c == cls} >= set(learned.CFG.models[cls]) - {"ensemble"}
    tuned = {k: f for k, f in run.models.items() if isinstance(f.model, trees.Trees)}
    assert tuned
    assert all(f.rounds == len(f.model.roots) > 0 for f in tuned.values())
    keys = ["RouteCode", "ItemCode", "TrxDate"]
    for frame in (run.test, run.val):
        assert frame.filter("prediction < 0 OR prediction IS NULL").isEmpty()
        assert frame.groupBy(*keys, "model").count().filter("count > 1").isEmpty()
    blended = run.test.filter("model != 'ensemble'").join(run.weights, ["class", "model"])
    want = blended.groupBy(*keys).agg((F.sum(F.col("prediction") * F.col("weight")) / F.sum("weight")).alias("want"))
    pairs = learned.QUERIES["F8_class_ensembles"](spark, SF).join(want, keys)
    assert pairs.filter(F.abs(F.col("prediction") - F.col("want")) > 1e-4).isEmpty()
    ahead = learned.QUERIES["F15_inference"](spark, SF)
    assert ahead.filter("prediction < 0").isEmpty() and ahead.groupBy(*keys).count().filter("count > 1").isEmpty()
    assert ahead.select("RouteCode", "ItemCode").distinct().count() == run.classes.count()
    assert {c for c, _ in run.bounds} == {c for c, _ in run.models} and len(run.bounds) == 2 * len({c for c, _ in run.bounds})
    for frame in (run.test_best, ahead):
        assert frame.count() > 0 and frame.filter("NOT (0 <= q_10 AND q_10 <= prediction AND prediction <= q_90)").isEmpty()
    assert not ahead.filter("q_10 < q_90").isEmpty()


def test_quantile_bounds_cover_the_test_rows(spark):
    shares = learned.QUERIES["E12_quantile_coverage"](spark, "/root/testdata/sf0.01").collect()
    total = sum(r.rows for r in shares)
    assert total > 500 and abs(sum(r.inside * r.rows for r in shares) / total - 0.8) < 0.03


def test_fits_and_trials_see_every_labelled_row(spark, monkeypatch):
    """No labelled row of a class is left out of a fit or a trial, however many there are."""
    made = spark.range(120_000).selectExpr(
        "'r' AS RouteCode", "CAST(id AS string) AS ItemCode", "DATE'2001-01-01' + CAST(id % 12 AS int) AS TrxDate",
        "IF(id % 6 = 5, NULL, CAST(id % 7 AS double)) AS TotalQuantity", "CAST(id % 7 AS double) AS x", "'c' AS group", "false AS held")
    bins = trees.Binning(("x",), ((0.5, 1.5, 2.5),))
    assert mlmodels.tree_rows(made, learned.CFG, bins).count() == 100_000
    seen = []
    monkeypatch.setattr(trees, "run_jobs", lambda data, jobs, b: seen.append(data.count()) or {})
    mlmodels.random_search([("c", "random_forest")], made, learned.CFG, bins, trials=1)
    assert seen == [100_000]


def test_histograms_of_many_rows_equal_those_of_few(monkeypatch):
    bins, codes, y = signal(700)
    for p in (trees.TreeParams(rounds=4, forest=True, depth=6), trees.TreeParams(rounds=4, step=0.3, leaves=9, rows=0.8, features=0.7)):
        a, _, _ = trees.fit(codes, y, p, bins.zero)
        monkeypatch.setattr(trees, "WIDE", 10)
        b, _, _ = trees.fit(codes, y, p, bins.zero)
        monkeypatch.undo()
        assert (a.predict(codes) == b.predict(codes)).all()
