"""Demand classes and per-pair explainability statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanflow.config import DemandConfig


def adi_cv2(target_col: str) -> tuple[Column, Column]:
    """Average demand interval and squared variation of the non-zero demand, as aggregates."""
    positive = F.when(F.col(target_col) > 0, F.col(target_col))
    n, nonzero = F.count(F.lit(1)), F.count(positive)
    adi = F.when(nonzero > 0, n / nonzero).otherwise(F.lit(float("inf")))
    cv2 = F.pow(F.stddev_pop(positive) / F.avg(positive), F.lit(2.0))
    return adi, cv2


def classify_pair(adi: Column, cv2: Column, cfg: DemandConfig) -> Column:
    rare, varied = adi >= cfg.adi_threshold, cv2 >= cfg.cv2_threshold
    return (
        F.when(adi.isNull() | cv2.isNull(), "intermittent")
        .when(rare & varied, "lumpy")
        .when(rare, "intermittent")
        .when(varied, "erratic")
        .otherwise("smooth")
    )


def pair_intervals(panel: DataFrame, cfg: DemandConfig) -> DataFrame:
    adi, cv2 = adi_cv2(cfg.target_col)
    return panel.groupBy(*cfg.group_keys).agg(adi.alias("adi"), cv2.alias("cv2"))


def classify_dataset(panel: DataFrame, cfg: DemandConfig) -> DataFrame:
    """Class per pair; pass the train window so the test horizon stays unseen."""
    return pair_intervals(panel, cfg).withColumn(
        "class", classify_pair(F.col("adi"), F.col("cv2"), cfg)
    )


def _avg_gap() -> Column:
    """Mean distance between positive periods; null below two of them."""
    idx = F.when(F.col("_y") > 0, F.col("_idx"))
    n = F.count(idx)
    return F.when(n >= 2, (F.max(idx) - F.min(idx)) / (n - 1))


def _indexed(panel: DataFrame, cfg: DemandConfig) -> DataFrame:
    w = Window.partitionBy(*cfg.group_keys).orderBy(cfg.date_col)
    return panel.withColumn("_idx", F.row_number().over(w)).withColumn(
        "_y", F.col(cfg.target_col).cast("double")
    )


def avg_gap_between_demand(panel: DataFrame, cfg: DemandConfig) -> DataFrame:
    return _indexed(panel, cfg).groupBy(*cfg.group_keys).agg(
        _avg_gap().alias("avg_gap_between_demand")
    )


def pair_explainability(panel: DataFrame, cfg: DemandConfig) -> DataFrame:
    """Fifteen statistics per pair in one aggregation."""
    y = F.col("_y")
    positive = F.when(y > 0, y)
    adi, cv2 = adi_cv2("_y")
    n, zero = F.count(F.lit(1)), F.lit(0.0)
    stats = _indexed(panel, cfg).groupBy(*cfg.group_keys).agg(
        n.alias("n_periods"),
        F.count(positive).alias("n_nonzero_periods"),
        (F.count(positive) / n).alias("nonzero_ratio"),
        F.avg(y).alias("mean_qty"),
        F.percentile(y, 0.5).alias("median_qty"),
        F.min(y).alias("min_qty"),
        F.max(y).alias("max_qty"),
        F.stddev_pop(y).alias("std_qty"),
        F.sum(y).alias("sum_qty"),
        F.coalesce(F.avg(positive), zero).alias("nonzero_mean"),
        F.coalesce(F.stddev_pop(positive), zero).alias("nonzero_std"),
        adi.alias("adi"),
        cv2.alias("cv2"),
        _avg_gap().alias("avg_gap_between_demand"),
    )
    finite = F.when(F.col("adi") < float("inf"), F.col("adi"))
    return stats.withColumn("class", classify_pair(F.col("adi"), F.col("cv2"), cfg)).withColumn(
        "adi", finite
    )


def class_summary(classes: DataFrame) -> DataFrame:
    return classes.groupBy("class").agg(F.count(F.lit(1)).alias("pairs"))
