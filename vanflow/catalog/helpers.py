"""Shared pieces of the catalogue: output rounding and memoised inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanflow.functions.numeric import py_round
from vanflow.session import cut_lineage

_MEMO: dict[tuple, DataFrame] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, so that summation order does not show."""
    return df.select(
        *[py_round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def shared(
    name: str, spark: SparkSession, sf: str, build: Callable[[], DataFrame], store: Callable[[DataFrame], DataFrame] = cut_lineage
) -> DataFrame:
    """An input several registered queries read, materialised once per session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MEMO:
        _MEMO[key] = store(build())
    return _MEMO[key]


def forget() -> None:
    _MEMO.clear()
