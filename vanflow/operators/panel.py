"""Demand panel: one row per pair and period, from first to last sale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanflow.config import DemandConfig
from vanflow.functions.numeric import one_row_value
from vanflow.functions.periods import period_sequence, period_start, shift_periods

_CAUSAL = {
    "sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min,
    "median": lambda c: F.percentile(c, 0.5), "nunique": F.countDistinct,
}


def aggregate_to_period(df: DataFrame, cfg: DemandConfig, with_meta: bool = True) -> DataFrame:
    """Sum the target per pair and period; causal columns by their own aggregate.

    Descriptive columns carry the pair's earliest value, found from per-period
    minima so that the raw rows are read and shuffled once.
    """
    keys, date = list(cfg.group_keys), cfg.date_col
    present = set(df.columns)
    causal = [(c, agg) for c, agg in cfg.causal_cols if c in present]
    meta = [c for c in cfg.meta_cols if c in present] if with_meta else []
    df = df.dropna(subset=[*keys, date])
    firsts = [
        F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(date).alias("_d"), F.col(c).alias("_v"))))
        .alias(f"_first_{c}")
        for c in meta
    ]
    out = df.groupBy(*keys, period_start(F.col(date), cfg.granularity).alias("_period")).agg(
        F.sum(cfg.target_col).alias(cfg.target_col),
        *[_CAUSAL[agg](c).alias(c) for c, agg in causal],
        *firsts,
    )
    pair = Window.partitionBy(*keys)
    for c in meta:
        out = out.withColumn(c, F.min(f"_first_{c}").over(pair)["_v"])
    return out.withColumnRenamed("_period", date).select(
        *keys, date, cfg.target_col, *[c for c, _ in causal], *meta
    )


def fill_missing_periods(df: DataFrame, cfg: DemandConfig, fill_value: float = 0.0) -> DataFrame:
    """Add the periods between a pair's first and last one.

    Each row is exploded up to its successor, so the gaps appear in place
    without a calendar table, a join or a second shuffle. Filled rows take the
    fill value, a zero activity flag and null causal columns.
    """
    keys, date = list(cfg.group_keys), cfg.date_col
    causal = [c for c, _ in cfg.causal_cols if c in df.columns]
    w = Window.partitionBy(*keys).orderBy(date)
    last_covered = shift_periods(F.lead(date).over(w), -1, cfg.granularity)
    # coalesce keeps the pair's last row as a one-element sequence
    dates = period_sequence(F.col(date), F.coalesce(F.col("_until"), F.col(date)), cfg.granularity)
    rows = df.withColumn("_until", last_covered).withColumn("_filled", F.explode(dates))
    real = F.col("_filled") == F.col(date)
    kept = [c for c in df.columns if c not in {*keys, date, cfg.target_col, *causal}]
    return rows.select(
        *keys,
        F.col("_filled").alias(date),
        F.when(real, F.coalesce(cfg.target_col, F.lit(fill_value)))
        .otherwise(F.lit(fill_value)).alias(cfg.target_col),
        *[F.when(real, F.col(c)).alias(c) for c in causal],
        F.when(real & F.col(cfg.target_col).isNotNull(), 1).otherwise(0).alias("activity_flag"),
        *kept,
    )


def build_panel(df: DataFrame, cfg: DemandConfig, fill_missing: bool = True) -> DataFrame:
    agg = aggregate_to_period(df, cfg)
    if not fill_missing:
        return agg.withColumn("activity_flag", F.lit(1))
    return fill_missing_periods(agg, cfg)


def latest_period(df: DataFrame, cfg: DemandConfig) -> Column:
    """Newest period of a frame, as a scalar subquery."""
    return one_row_value(df, F.max(period_start(F.col(cfg.date_col), cfg.granularity)))


def drop_inactive_pairs(
    panel: DataFrame, cfg: DemandConfig, latest: Column | None = None
) -> DataFrame:
    """Keep pairs with a positive period within the allowed inactivity of the newest one."""
    latest = latest_period(panel, cfg) if latest is None else latest
    pair = Window.partitionBy(*cfg.group_keys)
    last_sale = F.max(F.when(F.col(cfg.target_col) > 0, F.col(cfg.date_col))).over(pair)
    cutoff = shift_periods(latest, -cfg.max_inactivity_periods, cfg.granularity)
    return (
        panel.withColumn("_last_sale", last_sale)
        .filter(F.col("_last_sale") >= cutoff)
        .drop("_last_sale")
    )


def clip_negative_to_zero(panel: DataFrame, target_col: str) -> DataFrame:
    return panel.withColumn(
        target_col, F.greatest(F.coalesce(F.col(target_col), F.lit(0.0)), F.lit(0.0))
    )


def outlier_bounds(train: DataFrame, cfg: DemandConfig) -> DataFrame:
    """Per-pair [max(q1 - m IQR, 0), q3 + m IQR] with interpolated quartiles."""
    q = F.percentile(cfg.target_col, [0.25, 0.75])
    iqr = F.col("_q")[1] - F.col("_q")[0]
    return (
        train.groupBy(*cfg.group_keys).agg(q.alias("_q"))
        .select(
            *cfg.group_keys,
            F.greatest(F.col("_q")[0] - cfg.iqr_multiplier * iqr, F.lit(0.0)).alias("lower_bound"),
            (F.col("_q")[1] + cfg.iqr_multiplier * iqr).alias("upper_bound"),
        )
    )


def treat_outliers(
    panel: DataFrame, bounds: DataFrame, classes: DataFrame, cfg: DemandConfig
) -> DataFrame:
    """Clip to the pair's bounds; intermittent, lumpy and unseen pairs stay as they are."""
    keys = list(cfg.group_keys)
    limits = bounds.join(
        classes.select(*keys, "class"), keys, "left"
    ).filter(~F.coalesce(F.col("class"), F.lit("")).isin("intermittent", "lumpy")).drop("class")
    y = F.col(cfg.target_col)
    clipped = F.least(F.greatest(y, F.col("lower_bound")), F.col("upper_bound"))
    return (
        panel.join(limits, keys, "left")
        .withColumn(
            cfg.target_col, F.when(F.col("upper_bound").isNull(), y).otherwise(clipped)
        )
        .drop("lower_bound", "upper_bound")
    )


def split_starts(latest: Column, cfg: DemandConfig) -> tuple[Column, Column]:
    """First test period and first validation period."""
    test_start = shift_periods(latest, -(cfg.test_horizon - 1), cfg.granularity)
    val_start = shift_periods(test_start, -cfg.validation_horizon, cfg.granularity)
    return test_start, val_start


def train_window(panel: DataFrame, cfg: DemandConfig, latest: Column | None = None) -> DataFrame:
    """Everything before the test horizon (validation periods included)."""
    latest = latest_period(panel, cfg) if latest is None else latest
    return panel.filter(F.col(cfg.date_col) < split_starts(latest, cfg)[0])


def time_based_split(
    panel: DataFrame, cfg: DemandConfig, latest: Column | None = None
) -> DataFrame:
    """Label rows train, val or test by period."""
    latest = latest_period(panel, cfg) if latest is None else latest
    test_start, val_start = split_starts(latest, cfg)
    d = F.col(cfg.date_col)
    return panel.withColumn(
        "split", F.when(d >= test_start, "test").when(d >= val_start, "val").otherwise("train")
    )
