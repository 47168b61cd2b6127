"""Stores whose slices are replaced without a moment in which they are missing.

A write goes to a folder of its own (`data/slice_version=<n>-<id>`); a numbered
manifest then names the folder of every slice. Readers take the newest manifest
that carries Spark's success marker, so a write that dies anywhere before that
marker leaves the former slices readable. Folders that the newest two manifests
do not name are deleted after the switch; readers of the one before still find
theirs. One writer at a time: a second one that aims at the same number fails.

The list of slices is held by the driver, as Spark does for any folder of
partitions; rows never are.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "slice_version"
FOLDER = "slice_folder"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def _manifest(path: str, number: int) -> str:
    return f"{path}/manifest/{number:012d}"


def manifests(spark: SparkSession, path: str) -> tuple[list[int], int]:
    """Numbers of the complete manifests, ascending, and the next free number."""
    fs, where = _fs(spark, f"{path}/manifest")
    found = sorted(int(s.getPath().getName()) for s in fs.listStatus(where)) if fs.exists(where) else []
    done = [n for n in found if _exists(spark, f"{_manifest(path, n)}/_SUCCESS")]
    return done, found[-1] + 1 if found else 1


def _same(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns], F.lit(True))


def _written(spark: SparkSession, target: str, schema: T.StructType, by: Sequence[str]) -> DataFrame:
    """The slices of a new version and their folders."""
    if not by:
        return spark.range(1).select(F.lit(target).alias(FOLDER))
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    plain = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    return spark.read.schema(schema).parquet(target).select(*by, plain.alias(FOLDER)).distinct()


def _switch(manifest: DataFrame, path: str, number: int) -> None:
    """Publish a manifest: its success marker, written last, is the switch."""
    manifest.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(_manifest(path, number))


def replace(df: DataFrame, path: str, by: Sequence[str] = (), whole: bool = False, in_place: bool = False) -> None:
    """Replace the slices that the frame touches, or the whole store.

    Slices are the distinct values of the `by` columns; null and empty text are
    one slice, as in any partitioned folder. A frame without rows touches nothing (with `whole` it
    empties the store). Without `by` the store is a single slice. Rows that lie by slice already, as those
    read from a store do, need not be dealt again: they are written `in_place`.
    """
    spark = df.sparkSession
    done, number = manifests(spark, path)
    target = f"{path}/data/{VERSION}={number:012d}-{uuid.uuid4().hex}"
    if by:
        dealt = df if in_place else df.hint("rebalance", *[F.col(c) for c in by])
        dealt.write.partitionBy(*by).parquet(target)
    else:
        df.write.parquet(target)
    fresh = _written(spark, target, df.schema, by)
    if done and by and not whole:
        held = spark.read.parquet(_manifest(path, done[-1]))
        fresh = held.join(fresh, _same(held, fresh, by), "left_anti").unionByName(fresh)
    _switch(fresh, path, number)
    _clean(spark, path)


def _clean(spark: SparkSession, path: str) -> None:
    """Delete the folders and manifests that the newest two complete manifests do not need."""
    done, _ = manifests(spark, path)
    kept = [spark.read.parquet(_manifest(path, n)).select(FOLDER) for n in done[-2:]]
    named = reduce(DataFrame.union, kept)
    for number in done[:-2]:
        old = spark.read.parquet(_manifest(path, number)).select(FOLDER)
        for row in old.join(named, FOLDER, "left_anti").distinct().toLocalIterator():
            _delete(spark, row[FOLDER])
        _delete(spark, _manifest(path, number))


def read(
    spark: SparkSession, path: str, schema: T.StructType | None = None, where: Column | None = None
) -> DataFrame:
    """The store by its newest manifest; `where` on slice columns leaves other folders unlisted.

    Slice columns keep the types they were written with. A store without rows
    needs a schema to be read.
    """
    done, _ = manifests(spark, path)
    held = spark.read.parquet(_manifest(path, done[-1])) if done else None
    folders = []
    if held is not None:
        chosen = held if where is None else held.filter(where)
        folders = sorted(r[FOLDER] for r in chosen.select(FOLDER).distinct().toLocalIterator())
    if not folders:
        if schema is None:
            raise FileNotFoundError(f"no slices at {path}")
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", f"{path}/data")
    if schema is None:
        types = {f.name: f.dataType for f in held.schema.fields}
        found = reader.parquet(*folders).schema.fields
        schema = T.StructType([T.StructField(f.name, types.get(f.name, f.dataType)) for f in found if f.name != VERSION])
    return reader.schema(schema).parquet(*folders).select(*schema.names)
