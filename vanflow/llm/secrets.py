"""Secret scan with an incremental blob ledger.

Every historical version of a file is content-addressed. The ledger, a table
partitioned by rule version, holds the findings of every (blob, rule version)
pair that was scanned; a run scans only pairs the ledger lacks, appends them
and joins findings back to all paths that hold the blob.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vanflow.llm.base import map_rows, type_of
from vanflow.session import new_folder

# Rule version, kinds in their order, patterns.
RULE_VERSION = "3"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "jwt", "hosted")
RULES = {
    "assign": re.compile(
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
    ),
    "access": re.compile(r"AKIA[A-Z0-9]{16,}"),
    "hex": re.compile(r"[0-9a-f]{24,}"),
    "pem": re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "hosted": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{20,}"),
}


def find(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start and then kind; code points, end exclusive."""
    spans = []
    for rank, (kind, rule) in enumerate(RULES.items()):
        for found in rule.finditer(text):
            if kind != "assign" or len(found.group(2)) >= 6:
                spans.append((found.start(), rank, kind, found.end()))
    return [(start, kind, end) for start, _, kind, end in sorted(spans)]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


FINDINGS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
LEDGER = f"blob string, {FINDINGS}, rule_version string"


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Findings of each (blob, text) row."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            found = [find(text) for text in batch["text"]]
            base = [[s for s in spans if s[1] in BASE_KINDS] for spans in found]
            yield {
                "blob": batch["blob"],
                **{f"n_{kind}": [sum(s[1] == kind for s in spans) for spans in found] for kind in BASE_KINDS},
                "base_sha256": [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base],
                "spans": [joined(spans) for spans in found],
            }

    return map_rows(blobs, work, f"blob string, {FINDINGS}")


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; an empty frame where nothing was scanned yet."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(LEDGER).parquet(path) if exists else spark.createDataFrame([], LEDGER)


def scan_versions(
    versions: DataFrame, path_col: str = "path", text_col: str = "text", ledger: str | None = None, rule_version: str = RULE_VERSION
) -> DataFrame:
    """Findings of every (path, blob) of the versions, scanning only what the ledger lacks.

    A null text is the empty blob. Repeated rows are answered each. Equal
    texts are scanned once, however many paths hold them; only their
    identifiers are grouped, with partial aggregation, and the findings come
    back by a join that adaptive execution splits at a hot blob. An empty table
    leaves the ledger as it is. Further columns are ignored. Runs at once may
    both append a blob; it is read as one row.
    """
    spark = versions.sparkSession
    ledger = ledger or new_folder(spark, "ledger")
    texts = versions.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    seen = ledger_at(spark, ledger).where(F.col("rule_version") == rule_version).select("blob")
    owners = texts.groupBy("blob").agg(F.min("path").alias("owner")).join(seen, "blob", "left_anti")
    unseen = texts.alias("t").join(
        owners.alias("o"), (F.col("t.blob") == F.col("o.blob")) & F.col("t.path").eqNullSafe(F.col("o.owner")), "left_semi"
    )
    found = scan_blobs(unseen.select("blob", "text")).dropDuplicates(["blob"])
    found.withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(ledger)
    known = ledger_at(spark, ledger).where(F.col("rule_version") == rule_version).drop("rule_version").dropDuplicates(["blob"])
    return texts.select("path", "blob").join(known, "blob").select(
        F.col("path").cast(type_of(texts, "path")).alias(path_col), *[c for c in known.columns if c != "blob"], "blob"
    )
