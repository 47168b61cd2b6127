"""Feature-based forecasters: linear and logistic on Spark ML, forests and boosted trees on `trees`."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanflow.config import DemandConfig
from vanflow.operators import trees as tr
from vanflow.operators.evaluate import temporal_folds
from vanflow.session import cut_lineage

ML_MODELS = (
    "linear", "random_forest", "gradient_boosting", "leafwise_trees", "depthwise_trees", "two_stage",
)
# search space per tunable model: (low, high, log scale)
SEARCH = {
    "random_forest": {
        "rounds": (100, 500, False), "depth": (4, 20, False), "min_leaf": (1, 10, False),
    },
    "leafwise_trees": {
        "rounds": (100, 600, False), "step": (0.01, 0.2, True), "leaves": (15, 127, False),
        "min_leaf": (5, 40, False), "features": (0.6, 1.0, False), "rows": (0.6, 1.0, False),
    },
    "depthwise_trees": {
        "rounds": (100, 600, False), "step": (0.01, 0.2, True), "depth": (3, 10, False),
        "rows": (0.6, 1.0, False), "features": (0.6, 1.0, False),
    },
}
# defaults per model; `patience` 0 trains every round
DEFAULTS = {
    "linear": {"alpha": 1.0},
    "random_forest": {"rounds": 200, "depth": 30, "min_leaf": 2},
    "gradient_boosting": {"rounds": 200, "depth": 3, "step": 0.05, "patience": 50},
    "leafwise_trees": {"rounds": 400, "leaves": 31, "step": 0.05, "min_leaf": 10, "features": 0.9, "rows": 0.9},
    "depthwise_trees": {"rounds": 400, "depth": 6, "step": 0.05, "rows": 0.9, "features": 0.9, "l2": 1.0, "patience": 50},
    "quantile_trees": {"rounds": 200, "leaves": 31, "step": 0.05, "min_leaf": 20, "patience": 50},
    "two_stage": {"regressor": "leafwise_trees"},
}
BOOSTED = ("gradient_boosting", "leafwise_trees", "depthwise_trees")
TREES = ("random_forest", *BOOSTED)
QUANTILE = "quantile_trees"
KEEP_MISSING = ("leafwise_trees", "depthwise_trees", "quantile_trees")
SEARCH_PATIENCE = 20  # rounds after which a trial's fold ends if they brought nothing
FOREST_PART = 25  # trees of a forest that one task grows


@dataclass(frozen=True)
class MLSettings:
    """Overrides of model parameters, by model name."""

    params: dict[str, dict] = field(default_factory=dict)

    def of(self, name: str) -> dict:
        return {**DEFAULTS[name], **self.params.get(name, {})}

    def override(self, name: str, **params) -> MLSettings:
        return replace(self, params={**self.params, name: {**self.params.get(name, {}), **params}})


@dataclass(frozen=True)
class Fitted:
    """A fitted model with what it needs to score rows; `rounds` counts its trees."""

    name: str
    features: tuple[str, ...]
    model: PipelineModel | tr.Trees | None
    constant: float = 0.0
    gate: PipelineModel | None = None
    threshold: float = 0.5
    bins: tr.Binning | None = None
    rounds: int = 0


def _prepared(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Numeric inputs, nulls as 0."""
    values = {f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}
    return df.withColumns(values), list(values)


def quantile_name(quantile: float) -> str:
    return f"{QUANTILE}/{quantile}"


def tree_params(name: str, settings: MLSettings, cfg: DemandConfig, **more) -> tr.TreeParams:
    """Parameters by model name; one of `quantile_name` carries its loss."""
    name, _, quantile = name.partition("/")
    if quantile:
        more = {"loss": float(quantile), **more}
    given = {k: type(getattr(tr.TreeParams(), k))(v) for k, v in settings.of(name).items() if k != "loss"}
    return tr.TreeParams(**{**given, "forest": name == "random_forest", "keep_missing": name in KEEP_MISSING, "seed": cfg.seed, **more})


def tree_rows(data: DataFrame, cfg: DemandConfig, bins: tr.Binning) -> DataFrame:
    """All labelled rows for `trees.run_jobs`; `data` has group and held. Written once, as several jobs read them."""
    y = F.col(cfg.target_col).cast("double")
    labelled = data.filter(y.isNotNull())
    day = F.unix_date(F.col(cfg.date_col).cast("date"))
    return cut_lineage(labelled.select("group", y.alias("y"), "held", day.alias("day"), tr.coded(bins).alias("codes")))


def fit_trees(
    rows: DataFrame, bins: tr.Binning, wanted: dict[tuple[str, str], MLSettings], cfg: DemandConfig, rounds: dict | None = None,
) -> dict[tuple[str, str], Fitted]:
    """Fit (group, model) pairs side by side; `rounds` fixes numbers of rounds found before."""
    jobs, parts = [], {}
    for (group, name), settings in wanted.items():
        more = {"rounds": rounds[group, name], "patience": 0} if rounds and (group, name) in rounds else {}
        p = tree_params(name, settings, cfg, **more)
        own = [replace(p, rounds=min(FOREST_PART, p.rounds - low), patience=0, seed=p.seed + low)
               for low in range(0, p.rounds, FOREST_PART)] if p.forest else [p]
        parts[group, name] = [f"{group}/{name}/{i}" for i in range(len(own))]
        jobs += [tr.Job(job, group, q) for job, q in zip(parts[group, name], own)]
    done = tr.run_jobs(rows, jobs, bins)
    out = {}
    for (group, name), names in parts.items():
        if all(n in done for n in names):
            found = [done[n] for n in names]
            model = tr.merged([t for t, _, _ in found]) if len(found) > 1 else found[0][0]
            out[group, name] = Fitted(name, bins.features, model, bins=bins, rounds=sum(r for _, r, _ in found))
    return out


def rounds_kept(first: dict[tuple[str, str], Fitted]) -> dict[tuple[str, str], int]:
    """Rounds of boosted models for a fit on more rows: as many as were best on the held rows."""
    return {pair: max(1, f.rounds) for pair, f in first.items() if pair[1] in BOOSTED or pair[1].startswith(QUANTILE)}


def _pipeline(inputs: list[str], estimator) -> Pipeline:
    stages = [VectorAssembler(inputCols=inputs, outputCol="features")]
    stages.append(StandardScaler(inputCol="features", outputCol="scaled", withMean=True))
    return Pipeline(stages=[*stages, estimator])


def fit_linear(train: DataFrame, cfg: DemandConfig, features: Sequence[str], settings: MLSettings) -> Fitted:
    y = F.col(cfg.target_col).cast("double")
    data, inputs = _prepared(train.filter(y.isNotNull()).withColumn("label", y), features)
    # one half of the mean squared error plus reg/2 |w|^2: alpha is spread over the rows
    estimator = LinearRegression(
        featuresCol="scaled", labelCol="label", predictionCol="raw", elasticNetParam=0.0,
        regParam=settings.of("linear")["alpha"] / max(data.count(), 1), standardization=False,
    )
    return Fitted("linear", tuple(features), _pipeline(inputs, estimator).fit(data))


def fit_regressor(
    name: str, train: DataFrame, cfg: DemandConfig, features: Sequence[str],
    settings: MLSettings, held: DataFrame | None = None, bins: tr.Binning | None = None,
) -> Fitted:
    """Fit one regressor; boosting with patience stops by the error on the `held` rows where some are given."""
    if name == "linear":
        return fit_linear(train, cfg, features, settings)
    bins = bins or tr.binning(train, features)
    data = train.withColumns({"group": F.lit("all"), "held": F.lit(False)})
    if held is not None:
        data = data.unionByName(held.withColumns({"group": F.lit("all"), "held": F.lit(True)}))
    found = fit_trees(tree_rows(data, cfg, bins), bins, {("all", name): settings}, cfg)
    return found.get(("all", name), Fitted(name, tuple(features), None))


def fit_gate(
    train: DataFrame, cfg: DemandConfig, features: Sequence[str]
) -> tuple[PipelineModel | None, int, float]:
    """Balanced classifier of demand (none where all rows agree), positive rows and mean."""
    y = F.col(cfg.target_col).cast("double")
    data = train.filter(y.isNotNull())
    n, positives, mean = data.agg(F.count(F.lit(1)), F.count(F.when(y > 0, 1)), F.avg(y)).first()
    gate = None
    if 0 < positives < n:
        weight = F.when(y > 0, n / (2.0 * positives)).otherwise(n / (2.0 * (n - positives)))
        rows, inputs = _prepared(data.withColumns({"label": (y > 0).cast("double"), "balance": weight}), features)
        classifier = LogisticRegression(
            featuresCol="scaled", labelCol="label", weightCol="balance", maxIter=100,
            probabilityCol="probability", predictionCol="class_raw", rawPredictionCol="margin",
        )
        gate = _pipeline(inputs, classifier).fit(rows)
    return gate, positives, float(mean or 0.0)


def two_stage(gated: tuple[PipelineModel | None, int, float], inner: Fitted | None, features: Sequence[str], cfg: DemandConfig) -> Fitted:
    """Gate and regressor of the positive rows; fewer than five give their mean."""
    gate, positives, mean = gated
    if positives < 5 or inner is None:
        return Fitted("two_stage", tuple(features), None, mean, gate, cfg.two_stage_threshold)
    return replace(inner, name=f"two_stage/{inner.name}", constant=mean, gate=gate, threshold=cfg.two_stage_threshold)


def fit_two_stage(
    train: DataFrame, cfg: DemandConfig, features: Sequence[str], settings: MLSettings, held: DataFrame | None = None,
) -> Fitted:
    """Balanced classifier of demand, regressor on the positive rows."""
    gated, inner = fit_gate(train, cfg, features), None
    sold = F.col(cfg.target_col) > 0
    if gated[1] >= 5:
        inner = fit_regressor(settings.of("two_stage")["regressor"], train.filter(sold), cfg, features, settings,
                              held=None if held is None else held.filter(sold))
    return two_stage(gated, inner, features, cfg)


def fit_model(
    name: str, train: DataFrame, cfg: DemandConfig, features: Sequence[str],
    settings: MLSettings = MLSettings(), held: DataFrame | None = None,
) -> Fitted:
    if name == "two_stage":
        return fit_two_stage(train, cfg, features, settings, held)
    return fit_regressor(name, train, cfg, features, settings, held=held)


def predict(fitted: Fitted, rows: DataFrame, cfg: DemandConfig, keep: Sequence[str] = ()) -> DataFrame:
    """Non-negative predictions; two-stage models add p_demand and qty_if_demand."""
    out = rows
    scratch: list[str] = []
    if fitted.gate is not None:
        out, inputs = _prepared(out, fitted.features)
        out = fitted.gate.transform(out).withColumn("p_demand", vector_to_array("probability")[1])
        out = out.drop(*inputs, "features", "scaled", "margin", "probability", "class_raw")
    if fitted.model is None:
        out = out.withColumn("raw", F.lit(fitted.constant))
    elif isinstance(fitted.model, tr.Trees):
        out = out.withColumn("raw", tr.predicted(fitted.model, fitted.bins))
    else:
        out, inputs = _prepared(out, fitted.features)
        out = fitted.model.transform(out)
        scratch = [*inputs, "features", "scaled"]
    quantity = F.greatest(F.col("raw"), F.lit(0.0))
    out = out.drop(*scratch)
    columns = [*cfg.group_keys, cfg.date_col, *keep]
    if fitted.name.startswith("two_stage"):
        p = F.col("p_demand") if fitted.gate is not None else F.lit(1.0)
        return out.select(
            *columns, F.when(p >= fitted.threshold, quantity).otherwise(0.0).alias("prediction"),
            p.alias("p_demand"), quantity.alias("qty_if_demand"),
        )
    return out.select(
        *columns, quantity.alias("prediction"), (quantity > 0).cast("double").alias("p_demand"),
        quantity.alias("qty_if_demand"),
    )


def predict_bounds(
    bounds: dict[tuple[str, str], Fitted], rows: DataFrame, cfg: DemandConfig, keep: Sequence[str] = (),
) -> DataFrame:
    """`q_10` and `q_90` of the rows of every class that has both quantile models, floored at zero.

    `rows` has class; rows of other classes do not come back.
    """
    names = {column: quantile_name(q) for column, q in zip(("q_10", "q_90"), cfg.interval_quantiles)}
    columns = [*cfg.group_keys, cfg.date_col, *keep]
    parts = []
    for cls in sorted({c for c, _ in bounds}):
        if all((cls, name) in bounds for name in names.values()):
            models = {column: bounds[cls, name] for column, name in names.items()}
            scored = {c: F.greatest(tr.predicted(m.model, m.bins), F.lit(0.0)).alias(c) for c, m in models.items()}
            parts.append(rows.filter(F.col("class") == cls).select(*columns, *scored.values()))
    if parts:
        return union_all(parts)
    none = {column: F.lit(None).cast("double").alias(column) for column in names}
    return rows.filter(F.lit(False)).select(*columns, *none.values())


def _draw(space: dict, rng: random.Random) -> dict:
    out = {}
    for name, (low, high, log) in space.items():
        if log:
            out[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
        elif isinstance(low, int):
            out[name] = rng.randint(low, high)
        else:
            out[name] = rng.uniform(low, high)
    return out


def random_search(
    names: Sequence[tuple[str, str]], data: DataFrame, cfg: DemandConfig, bins: tr.Binning,
    settings: MLSettings = MLSettings(), trials: int | None = None,
) -> tuple[dict[tuple[str, str], MLSettings], list[dict]]:
    """Seeded random search on expanding temporal folds for (group, model) pairs; best parameters by pair.

    Every trial is a task of its own that fits all folds on all labelled rows
    of its group; boosting and forests end a fold with patience, so the best
    trial of a boosted model also names its rounds.
    """
    groups = sorted({g for g, _ in names})
    cutoffs = {}
    for group in groups:
        days = temporal_folds(data.filter(F.col("group") == group), cfg).select("fold", F.unix_date(F.col("cutoff").cast("date")).alias("day"))
        cutoffs[group] = tuple(r["day"] for r in days.orderBy("fold").collect())
    drawn, jobs = {}, []
    for group, name in names:
        rng = random.Random(cfg.seed)
        for trial in range(trials if trials is not None else cfg.tuning_trials):
            params = _draw(SEARCH[name], rng)
            job = f"{group}/{name}/{trial}"
            drawn[job] = (group, name, trial, params)
            p = tree_params(name, settings.override(name, **params), cfg, patience=SEARCH_PATIENCE)
            if cutoffs[group]:
                jobs.append(tr.Job(job, group, p, cutoffs[group]))
    done = tr.run_jobs(tree_rows(data.withColumn("held", F.lit(False)), cfg, bins), jobs, bins)
    results, chosen = [], {}
    for job, (group, name, trial, params) in drawn.items():
        _, rounds, error = done.get(job, (None, 0, float("inf")))
        score = error if math.isfinite(error) else float("inf")
        results.append({"group": group, "model": name, "trial": trial, "score": score, "rounds": rounds, "params": params})
    for pair in names:
        best = min((r for r in results if (r["group"], r["model"]) == pair), key=lambda r: r["score"], default=None)
        found = best["params"] if best and math.isfinite(best["score"]) else {}
        if found and pair[1] in BOOSTED:
            found = {**found, "rounds": max(1, best["rounds"])}
        chosen[pair] = settings.override(pair[1], **found)
    return chosen, results


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
