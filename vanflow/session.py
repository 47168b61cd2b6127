"""Session settings and lineage control."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app_name: str = "vanflow", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; partition counts are left to adaptive execution."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    `spark.checkpoint.dir` where the cluster names one, else the context's
    checkpoint folder, else a folder under the session's warehouse.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_vanflow"


def new_folder(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a frame to the shared folder once and read it back.

    Cuts lineage like a checkpoint, but later readers prune columns and push
    filters down. Files survive the loss of any executor.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(os.path.realpath(tempfile.mkdtemp())) / "vanflow.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame that several branches read, reliably and once."""
    return materialise(df)


@contextmanager
def rows_in_place(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Joins run inside leave rows where they lie if both sides are dealt to `tasks` by some of the join's keys.

    Only for frames dealt by a fine key, such as the customer: by a coarse one few tasks would hold all rows.
    """
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.shuffle.partitions": str(tasks)}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialised table for broadcast if it really is small.

    Its rows are counted up to the limit; a larger table is returned as it is
    and joins by shuffle.
    """
    fits = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if fits else df
