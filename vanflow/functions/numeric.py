"""Rounding, clamping, quantiles and grouped helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_round(c: Column | str, digits: int = 0) -> Column:
    """Half-even rounding on the binary value (scale, rint, unscale)."""
    if digits == 0:
        return F.rint(col(c))
    scale = float(10**digits)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale)


def sql_round(c: Column | str, digits: int = 0) -> Column:
    """Half-away-from-zero rounding of non-negative values."""
    scale = float(10**digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clamp(c: Column | str, bounds: tuple[float, float]) -> Column:
    low, high = bounds
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), col(c)))


def ratio(num: Column, den: Column, default: Column | float | None = None) -> Column:
    """num / den where den > 0, otherwise the default (null unless given)."""
    other = default if isinstance(default, Column) else F.lit(default)
    return F.when(den > 0, num / den).otherwise(other)


def percentiles_by_key(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    named: dict[str, float],
) -> DataFrame:
    """Exact interpolated percentiles per key.

    Rows are first counted per (key, value), so a key holding a large share of
    all rows is reduced on the map side and only distinct values travel on.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    aggs = [F.percentile(value, float(p), F.col("_n")).alias(name) for name, p in named.items()]
    return counts.groupBy(*keys).agg(*aggs)


def first_ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str = "_rank"
) -> DataFrame:
    """The first k rows per key; Spark cuts to k per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def one_row_value(df: DataFrame, agg: Column) -> Column:
    """A whole-table aggregate used as a scalar subquery."""
    return df.agg(agg).scalar()


def hot_split(key: Column | str, splits: int) -> Column:
    """Deterministic sub-key that spreads one hot key over several tasks."""
    return F.pmod(F.xxhash64(col(key)), F.lit(splits)).cast("int")
