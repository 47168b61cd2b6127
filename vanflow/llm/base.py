"""Shared pieces of the corpus operators: table reads and Arrow-batch mapping."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vanflow.session import ship_package


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_rows(df: DataFrame, work: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], ddl: str) -> DataFrame:
    """Run `work` over each task's rows: an iterator of {column: values} in, the same out.

    The rows of one Arrow batch are in memory at a time; a dictionary of empty
    lists is skipped.
    """
    ship_package(df.sparkSession)
    struct = T.StructType.fromDDL(ddl)
    schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns() -> Iterator[dict[str, list]]:
            for batch in batches:
                if batch.num_rows:
                    yield {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}

        for out in work(columns()):
            if len(out[schema.names[0]]):
                yield pa.RecordBatch.from_pydict({n: out[n] for n in schema.names}, schema=schema)
        out = None
        release()

    return df.mapInArrow(run, struct)


def release() -> None:
    """Give a finished task's memory back: workers outlive their tasks, and the next ones share the executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns an operator reads, under fixed names."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def crc_class(column: str, modulus: int) -> Column:
    """crc32 of an identifier written as text, modulo `modulus`; a null identifier counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
