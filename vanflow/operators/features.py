"""Features of the demand panel, all computed over one (pair, date) ordering."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vanflow.config import DemandConfig
from vanflow.functions.numeric import one_row_value
from vanflow.functions.periods import period_start
from vanflow.functions.text import slug, slug_text

TEMPORAL = (
    "day_of_week", "day_of_week_sin", "day_of_week_cos", "day_of_month", "week_of_year",
    "month", "month_sin", "month_cos", "is_weekend", "days_since_start",
    "quarter", "quarter_sin", "quarter_cos", "year",
)


def _pair(cfg: DemandConfig):
    return Window.partitionBy(*cfg.group_keys)


def _ordered(cfg: DemandConfig):
    return _pair(cfg).orderBy(cfg.date_col)


def _circle(c: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * c / F.lit(period)
    return F.sin(angle), F.cos(angle)


def temporal_features(
    df: DataFrame, cfg: DemandConfig, components: Sequence[str] = TEMPORAL
) -> DataFrame:
    d = F.col(cfg.date_col)
    dow, month, quarter = F.weekday(d), F.month(d), F.quarter(d)
    built = {
        "day_of_week": dow,
        "day_of_week_sin": _circle(dow, 7.0)[0],
        "day_of_week_cos": _circle(dow, 7.0)[1],
        "day_of_month": F.dayofmonth(d),
        "week_of_year": F.weekofyear(d),
        "month": month,
        "month_sin": _circle(month, 12.0)[0],
        "month_cos": _circle(month, 12.0)[1],
        "is_weekend": dow.isin(*cfg.weekend_days).cast("int"),
        "days_since_start": F.datediff(d, F.min(d).over(_pair(cfg))),
        "quarter": quarter,
        "quarter_sin": _circle(quarter, 4.0)[0],
        "quarter_cos": _circle(quarter, 4.0)[1],
        "year": F.year(d),
    }
    return df.withColumns({name: built[name] for name in components})


def lag_features(df: DataFrame, cfg: DemandConfig, lags: Sequence[int]) -> DataFrame:
    w = _ordered(cfg)
    return df.withColumns({f"lag_{n}": F.lag(cfg.target_col, n).over(w) for n in lags})


def rolling_features(
    df: DataFrame, cfg: DemandConfig, windows: Sequence[int], stats: Sequence[str],
    only: dict[str, Column] | None = None,
) -> DataFrame:
    """Statistics of the w periods before each row.

    The first row of a pair has none. In the non-zero ratio the missing period
    before a pair's start counts towards the length, as long as it is in reach.
    ``only`` restricts a statistic to rows where its condition holds.
    """
    y = F.col(cfg.target_col)
    rn = F.row_number().over(_ordered(cfg))
    cols: dict[str, Column] = {}
    for w in windows:
        frame = _ordered(cfg).rowsBetween(-w, -1)
        positives = F.count(F.when(y > 0, 1)).over(frame)
        built = {
            "mean": F.avg(y).over(frame),
            "std": F.stddev_samp(y).over(frame),
            "min": F.min(y).over(frame),
            "max": F.max(y).over(frame),
            "sum": F.sum(y).over(frame),
            "nonzero_ratio": F.when(rn > 1, positives / F.least(rn, F.lit(w))),
        }
        if "median" in stats:
            guarded = y if only is None else F.when(only["median"], y)
            built["median"] = F.percentile(guarded, 0.5).over(frame)
        for stat in stats:
            value = built[stat] if only is None else F.when(only[stat], built[stat])
            cols[f"roll_{stat}_{w}"] = value
    return df.withColumns(cols)


def intermittent_features(df: DataFrame, cfg: DemandConfig) -> DataFrame:
    """Mean of past positives, past demand interval and periods since the last positive."""
    y = F.col(cfg.target_col)
    w = _ordered(cfg)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rn = F.row_number().over(w)
    numbered = df.withColumn("_rn", rn)
    positives = F.count(F.when(y > 0, 1)).over(before)
    last_positive = F.max(F.when(y > 0, F.col("_rn"))).over(before)
    later = F.col("_rn") > 1
    return numbered.withColumns(
        {
            "nonzero_mean_to_date": F.when(
                later, F.coalesce(F.avg(F.when(y > 0, y)).over(before), F.lit(0.0))
            ),
            "inter_demand_interval": F.when(
                later,
                F.when(positives > 0, F.col("_rn") / positives).otherwise(
                    F.col("_rn").cast("double")
                ),
            ),
            "last_nonzero_gap": F.when(
                later, F.col("_rn") - 1 - F.coalesce(last_positive, F.lit(0))
            ),
        }
    ).drop("_rn")


def history_length(df: DataFrame, cfg: DemandConfig) -> DataFrame:
    return df.withColumn("pair_history_len", F.count(cfg.target_col).over(_pair(cfg)))


def holiday_names(calendar: DataFrame, date_col: str = "date", name_col: str = "name") -> DataFrame:
    """Calendar rows with combined names split and normalised."""
    return (
        calendar.select(
            F.to_date(date_col).alias("date"),
            F.explode(F.split(F.coalesce(name_col, F.lit("")), ";")).alias("_part"),
        )
        .filter(F.trim("_part") != "")
        .select("date", slug(F.trim("_part")).alias("name"))
        .filter(F.col("name") != "")
        .distinct()
    )


def holiday_flags(
    df: DataFrame, calendar: DataFrame, cfg: DemandConfig, names: Sequence[str] | None = None
) -> DataFrame:
    """One 0/1 column per holiday name plus the number of holidays in the period.

    ``calendar`` holds normalised (date, name) rows. The names become columns,
    so they are read from the calendar unless given.
    """
    if names is None:
        names = sorted(r["name"] for r in calendar.select("name").distinct().collect())
    per_period = (
        calendar.groupBy(period_start(F.col("date"), cfg.granularity).alias("_match"))
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_holidays_in_period"),
            *[
                F.max((F.col("name") == n).cast("int")).alias(f"hol_{n}")
                for n in names
            ],
        )
    )
    flagged = df.join(
        per_period, period_start(F.col(cfg.date_col), cfg.granularity) == F.col("_match"), "left"
    ).drop("_match")
    new = ["n_holidays_in_period", *[f"hol_{n}" for n in names]]
    return flagged.fillna(0, subset=new)


def event_flags(df: DataFrame, cfg: DemandConfig) -> DataFrame:
    """0/1 columns for configured (name, start, end) events, aligned to periods."""
    d = period_start(F.col(cfg.date_col), cfg.granularity)
    bound = lambda s: period_start(F.lit(s).cast("date"), cfg.granularity)
    return df.withColumns(
        {
            f"evt_{slug_text(name)}": d.between(bound(start), bound(end)).cast("int")
            for name, start, end in cfg.custom_events
        }
    )


def target_encoding(source: DataFrame, cfg: DemandConfig) -> DataFrame:
    """Smoothed pair means; the overall mean rides along for unseen pairs."""
    s = F.lit(cfg.target_encoding_smoothing)
    overall = one_row_value(source, F.avg(cfg.target_col))
    n, mean = F.count(cfg.target_col), F.avg(cfg.target_col)
    pairs = source.groupBy(*cfg.group_keys).agg(n.alias("_n"), mean.alias("_mean"))
    return pairs.select(
        *cfg.group_keys,
        ((F.col("_n") * F.col("_mean") + s * overall) / (F.col("_n") + s)).alias("te_pair_mean"),
    )


def apply_target_encoding(df: DataFrame, source: DataFrame, cfg: DemandConfig) -> DataFrame:
    overall = one_row_value(source, F.avg(cfg.target_col))
    joined = df.join(target_encoding(source, cfg), list(cfg.group_keys), "left")
    return joined.withColumn("te_pair_mean", F.coalesce("te_pair_mean", overall))


def class_features(df: DataFrame, classes: DataFrame, cfg: DemandConfig) -> DataFrame:
    """All class-conditional features in one pass over the panel.

    Every feature any class uses is built once over the shared window and
    nulled for the classes that do not use it; pairs without a class drop out.
    """
    keys = list(cfg.group_keys)
    df = df.join(classes.select(*keys, "class"), keys)
    in_classes = lambda names: F.col("class").isin(*names) if names else F.lit(False)
    df = history_length(df, cfg)
    df = temporal_features(df, cfg, TEMPORAL[:10])

    all_lags = sorted({n for lags in cfg.lags.values() for n in lags})
    users = {n: [c for c, lags in cfg.lags.items() if n in lags] for n in all_lags}
    df = lag_features(df, cfg, all_lags)
    df = df.withColumns(
        {f"lag_{n}": F.when(in_classes(users[n]), F.col(f"lag_{n}")) for n in all_lags}
    )

    stats = sorted({s for group in cfg.rolling_stats.values() for s in group})
    only = {
        s: in_classes([c for c, group in cfg.rolling_stats.items() if s in group]) for s in stats
    }
    df = rolling_features(df, cfg, cfg.rolling_windows, stats, only)

    df = intermittent_features(df, cfg)
    sparse = in_classes(["intermittent", "lumpy"])
    extras = ("nonzero_mean_to_date", "inter_demand_interval", "last_nonzero_gap")
    return df.withColumns({c: F.when(sparse, F.col(c)) for c in extras})


def build_features(
    panel: DataFrame,
    classes: DataFrame,
    cfg: DemandConfig,
    encoding_source: DataFrame,
    calendar: DataFrame | None = None,
) -> DataFrame:
    out = class_features(panel, classes, cfg)
    if calendar is not None:
        out = holiday_flags(out, calendar, cfg)
    else:
        out = out.withColumn("n_holidays_in_period", F.lit(0))
    out = event_flags(out, cfg)
    return apply_target_encoding(out, encoding_source, cfg)


def feature_columns(df: DataFrame, cfg: DemandConfig) -> list[str]:
    """Numeric and boolean columns that are neither key, date, target nor label."""
    excluded = {*cfg.group_keys, cfg.date_col, cfg.target_col, "class", "split", *cfg.meta_cols}
    usable = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema.fields
            if f.name not in excluded and isinstance(f.dataType, usable)]
