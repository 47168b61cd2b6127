"""Statistical forecasters over per-pair histories, and the ensemble."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanflow.config import DemandConfig

STAT_MODELS = ("naive", "moving_average", "croston", "croston_sba", "ets")


def pair_history(train: DataFrame, cfg: DemandConfig) -> DataFrame:
    """One dated-ordered array of demand per pair, as long as the pair's calendar."""
    points = F.array_sort(
        F.collect_list(F.struct(cfg.date_col, F.col(cfg.target_col).cast("double").alias("y")))
    )
    return (
        train.groupBy(*cfg.group_keys).agg(points.alias("_points"))
        .select(*cfg.group_keys, F.transform("_points", lambda p: p.y).alias("history"))
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, y: acc + y)


def naive(h: Column) -> Column:
    return F.element_at(h, -1)


def moving_average(h: Column, window: int) -> Column:
    n = F.least(F.size(h), F.lit(window))
    return _total(F.slice(h, F.size(h) - n + 1, n)) / n


def croston(h: Column, alpha: float, sba: bool = False) -> Column:
    """Smoothed demand size over smoothed interval; the interval count starts at one."""
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("z"), none.alias("p"), F.lit(1.0).alias("q"))

    def step(s: Column, y: Column) -> Column:
        a, rest = F.lit(alpha), F.lit(1 - alpha)
        size = F.when(s.z.isNull(), y).otherwise(a * y + rest * s.z)
        gap = F.when(s.z.isNull(), s.q).otherwise(a * s.q + rest * s.p)
        return F.struct(
            F.when(y > 0, size).otherwise(s.z).alias("z"),
            F.when(y > 0, gap).otherwise(s.p).alias("p"),
            F.when(y > 0, F.lit(1.0)).otherwise(s.q + 1.0).alias("q"),
        )

    factor = F.lit(1 - alpha / 2 if sba else 1.0)
    finish = lambda s: F.when(s.z.isNull() | (s.p == 0), 0.0).otherwise(factor * s.z / s.p)
    return F.aggregate(h, start, step, finish)


def exponential_smoothing(h: Column, alphas: Sequence[float]) -> Column:
    """Level of the smoothing constant with the smallest one-step squared error.

    Histories below four points fall back to their mean.
    """
    rest = F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0)))

    def fit(a: Column) -> Column:
        start = F.struct(F.element_at(h, 1).alias("level"), F.lit(0.0).alias("sse"))

        def step(s: Column, y: Column) -> Column:
            error = y - s.level
            return F.struct((s.level + a * error).alias("level"), (s.sse + error * error).alias("sse"))

        return F.aggregate(
            rest, start, step,
            lambda s: F.struct(s.sse.alias("sse"), a.alias("alpha"), s.level.alias("level")),
        )

    fits = F.transform(F.array(*[F.lit(float(a)) for a in alphas]), fit)
    return F.when(F.size(h) < 4, _total(h) / F.size(h)).otherwise(F.array_min(fits)["level"])


def _level_columns(cfg: DemandConfig) -> dict[str, Column]:
    h = F.col("history")
    return {
        "naive": naive(h),
        "moving_average": moving_average(h, cfg.moving_average_window),
        "croston": croston(h, cfg.croston_alpha),
        "croston_sba": croston(h, cfg.croston_alpha, sba=True),
        "ets": exponential_smoothing(h, cfg.ets_alphas),
    }


def stat_levels(
    train: DataFrame, cfg: DemandConfig, models: Sequence[str] = STAT_MODELS
) -> DataFrame:
    """One row per pair with a level column per model; the history is built once."""
    levels = _level_columns(cfg)
    return pair_history(train, cfg).select(
        *cfg.group_keys, *[levels[m].alias(m) for m in models]
    )


def flat_forecast(
    levels: DataFrame, horizon: DataFrame, cfg: DemandConfig, models: Sequence[str] = STAT_MODELS
) -> DataFrame:
    """Each model's level on every horizon row, in long form; unseen pairs get 0."""
    per_model = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.greatest(F.coalesce(F.col(m), F.lit(0.0)), F.lit(0.0)).alias("prediction"),
            )
            for m in models
        ]
    )
    joined = horizon.join(levels, list(cfg.group_keys), "left")
    return joined.select(*horizon.columns, F.inline(per_model))


def _smoothed_forecasts(series: list[np.ndarray], trend: bool, season: int, steps: int) -> np.ndarray:
    """Additive Holt-Winters on a coarse parameter grid: one recursion over time for all series and grid points.

    Arrays are (series, grid point); a series that has ended keeps its state.
    """
    options = itertools.product((0.1, 0.3, 0.5, 0.8), (0.1, 0.3) if trend else (0.0,), (0.1, 0.3) if season else (0.0,))
    a, b, g = np.array(list(options)).T
    n = np.array([len(y) for y in series])
    values = np.zeros((len(series), n.max()))
    for i, y in enumerate(series):
        values[i, : n[i]] = y
    shape = len(series), len(a)
    first = values[:, :season].mean(axis=1) if season else values[:, 0]
    level = np.repeat(first[:, None], len(a), axis=1)
    slope, sse = np.zeros(shape), np.zeros(shape)
    cycle = np.repeat((values[:, :season] - first[:, None]).T[:, :, None], len(a), axis=2) if season else np.zeros((1, *shape))
    period = season or 1
    for t in range(period, values.shape[1]):
        live = (t < n)[:, None]
        y, wave = values[:, t, None], cycle[t % period]
        error = y - (level + slope + wave)
        sse += np.where(live, error * error, 0.0)
        new = a * (y - wave) + (1 - a) * (level + slope)
        if trend:
            slope = np.where(live, b * (new - level) + (1 - b) * slope, slope)
        if season:
            cycle[t % period] = np.where(live, g * (y - new) + (1 - g) * wave, wave)
        level = np.where(live, new, level)
    each, best = np.arange(len(series)), sse.argmin(axis=1)
    ahead = np.arange(1, steps + 1)
    wave = cycle[(n[:, None] + ahead - 1) % period, each[:, None], best[:, None]]
    return np.clip(level[each, best][:, None] + slope[each, best][:, None] * ahead + wave, 0.0, None)


def seasonal_smoothing(
    train: DataFrame, cfg: DemandConfig, steps: int, trend: bool = True, season: int = 7
) -> DataFrame:
    """Trend and seasonal smoothing per pair: (keys, step, prediction).

    Pairs with fewer than two seasons are smoothed without one, with fewer than
    four points they get their mean. Pairs are independent and each holds at
    most its calendar's length, so batches of ready-made histories are mapped
    without another shuffle, all pairs of a batch in one recursion.
    """
    keys = list(cfg.group_keys)
    histories = pair_history(train, cfg)

    def forecast(batches):
        for pdf in batches:
            series = [np.asarray(y, dtype=float) for y in pdf["history"]]
            n = np.array([len(y) for y in series], dtype=int)
            cyclic = (n >= 4) & (n >= 2 * season) if season else np.zeros(len(n), bool)
            out = np.array([[y.mean() if len(y) else 0.0] * steps for y in series]).reshape(len(series), steps)
            for chosen, period in ((cyclic, season), ((n >= 4) & ~cyclic, 0)):
                at = np.flatnonzero(chosen)
                if len(at):
                    out[at] = _smoothed_forecasts([series[i] for i in at], trend, period, steps)
            wide = pdf[keys].loc[pdf.index.repeat(steps)].reset_index(drop=True)
            wide["step"] = np.tile(np.arange(1, steps + 1), len(series))
            wide["prediction"] = out.ravel()
            yield wide

    fields = ", ".join(f"{k} string" for k in keys)
    return histories.mapInPandas(forecast, f"{fields}, step int, prediction double")


def inverse_metric_weights(
    metrics: DataFrame, metric: str, by: Sequence[str] = ("class",), eps: float = 1e-9, least: int = 1
) -> DataFrame:
    """1 / metric per model, normalised within each group; unusable metrics and groups of under `least` models are dropped."""
    finite = metrics.filter(F.col(metric).isNotNull() & (F.abs(F.col(metric)) < float("inf")))
    inverse = F.lit(1.0) / (F.col(metric) + F.lit(eps))
    total = F.sum(inverse).over(Window.partitionBy(*by))
    usable = F.count(F.lit(1)).over(Window.partitionBy(*by))
    weighed = finite.select(*by, "model", (inverse / total).alias("weight"), usable.alias("_usable"))
    return weighed.filter(F.col("_usable") >= least).drop("_usable")


def weighted_ensemble(
    predictions: DataFrame, weights: DataFrame, cfg: DemandConfig, by: Sequence[str] = ("class",)
) -> DataFrame:
    """Weighted mean of the component predictions per pair and date."""
    keys = [*by, *cfg.group_keys, cfg.date_col]
    joined = predictions.join(weights, [*by, "model"])
    return joined.groupBy(*keys).agg(
        (F.sum(F.col("weight") * F.col("prediction")) / F.sum("weight")).alias("prediction")
    ).withColumn("model", F.lit("ensemble"))
