"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by identifier. Their running payload size over the
whole sorted table, not Spark's sampled boundaries, cuts it into shards, so the
files depend on the records alone. A task writes its shards to temporary names,
rolls files by compressed size (one gzip member per record) and renames them;
equal bytes from a repeated task land on equal names. The manifest, written
last through Spark's own commit, names the files that count.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vanflow.llm.base import map_rows, type_of
from vanflow.session import materialise, new_folder

SHARD_BYTES = 32 << 20  # payload bytes a shard holds at least, one record at the least
ROLL_BYTES = 16 << 20  # compressed bytes after which a file is closed
SLICE = 4096  # compressed bytes read at a time
MIN_REVISIT = 100  # payload bytes below which equal payloads are stored each
DATE = "2024-01-01T00:00:00Z"

# The revisit profile and the HTTP status line of archived pages.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _record_id(page, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page}/{digest}/{copy}')}>"


def record(page, url: str | None, payload: bytes, digest: str, copy: int, original, date: str = DATE) -> bytes:
    """One record. `original` is None for a response, else a 1-tuple with the response's identifier."""
    block = HTTP.format(len(payload)).encode() + (b"" if original else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if original else 'response'}",
        f"WARC-Record-ID: {_record_id(page, digest, copy)}",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url if url else f"urn:page:{page}"),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if original:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(original[0], digest, 0)}"]
        if original[0] is not None:
            lines.append(f"X-Refers-To-Page: {original[0]}")
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def records_in(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member, with digests checked; bytes are read once, in slices."""
    view, at = memoryview(archive), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            piece = view[at : at + SLICE]
            if not piece:
                raise ValueError("archive ends within a record")
            parts.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
        whole = b"".join(parts)
        head, _, rest = whole.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
        block = rest[: int(headers["Content-Length"])]
        # A response's bytes are checked by its payload digest, a revisit's by its block digest.
        if headers["WARC-Type"] == "revisit" and headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
        yield headers, block


def _uri(path: str) -> str:
    return re.sub(r"^file:/+", "file:///", path)


class Files:
    """Files of one task: temporary while open, renamed when rolled."""

    def __init__(self, target: str, roll_bytes: int):
        self.system, self.base = fs.FileSystem.from_uri(_uri(target))
        self.roll, self.done, self.stream = roll_bytes, [], None
        context = TaskContext.get()
        self.attempt = f"{context.taskAttemptId()}-{context.attemptNumber()}" if context else "0"

    def add(self, shard: int, member: bytes) -> None:
        if self.stream and (shard != self.shard or self.bytes >= self.roll):
            self.close()
        if not self.stream:
            self.number = self.number + 1 if self.done and self.done[-1]["shard"] == shard else 0
            self.shard, self.bytes, self.records, self.sha = shard, 0, 0, hashlib.sha256()
            self.name = f"part-{shard:08d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.base}/_temporary/{self.attempt}"
            self.system.create_dir(self.temporary, recursive=True)
            self.stream = self.system.open_output_stream(f"{self.temporary}/{self.name}", compression=None)
        self.stream.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> None:
        if not self.stream:
            return
        self.stream.close()
        self.stream = None
        self.system.move(f"{self.temporary}/{self.name}", f"{self.base}/{self.name}")
        self.done.append(
            {"file": self.name, "shard": self.shard, "bytes": self.bytes, "records": self.records, "file_sha256": self.sha.hexdigest()}
        )


def _shards(light: DataFrame, shard_bytes: int) -> DataFrame:
    """Shard of every (page_id, digest) by the running payload size of the sorted table."""
    ordered = light.repartitionByRange("page_id", "digest").withColumn("part", F.spark_partition_id())
    ordered = materialise(ordered, "order")
    sums = ordered.groupBy("part").agg(F.sum("bytes").alias("own"))  # one row per task
    before = sums.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    running = F.sum("bytes").over(Window.partitionBy("part").orderBy("page_id", "digest")) - F.col("bytes")
    return ordered.withColumn("running", running).join(before, "part").select(
        "page_id", "digest", "original", "first_of", ((F.col("running") + F.col("before")) / shard_bytes).cast("long").alias("shard")
    )


def write_archives(
    pages: DataFrame, target: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT,
) -> None:
    """Write every row as a WARC record under `target`, with a manifest.

    Of equal payloads of `min_revisit` bytes or more, the smallest identifier's
    record is the response and the others revisit it; of rows that repeat that
    identifier and payload one is the response. A null body is an empty
    payload; a null URL is named after the page; null identifiers come first in
    order and give way to any other. An empty table writes an empty manifest.
    Further columns are ignored. Digests and identifiers are grouped without
    their bodies.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("body")
    ).withColumn("digest", F.sha2("body", 256))
    light = rows.groupBy("page_id", "digest").agg(
        F.sum(F.octet_length("body").cast("long") + 512).alias("bytes"), F.max(F.octet_length("body")).alias("size")
    )
    light = materialise(light, "pages")
    groups = light.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("original"))
    decided = light.join(groups, "digest", "left").select(
        "page_id", "digest", "bytes", "original",
        F.when(F.col("size") < min_revisit, None).otherwise(F.col("page_id").eqNullSafe(F.col("original"))).alias("first_of"),
    )
    shards = materialise(_shards(decided, shard_bytes), "shards")
    # Bodies cross two shuffles: they travel compressed.
    def squeeze(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            yield {**batch, "body": [zlib.compress(body, 1) for body in batch["body"]]}

    packed = map_rows(rows, squeeze, f"page_id {type_of(rows, 'page_id')}, url string, body binary, digest string")
    placed = packed.alias("r").join(
        shards.alias("s"), (F.col("r.digest") == F.col("s.digest")) & F.col("r.page_id").eqNullSafe(F.col("s.page_id"))
    ).select("r.*", "s.original", "s.first_of", "s.shard")
    dealt = placed.repartition("shard").sortWithinPartitions("shard", "page_id", "digest", "url")

    def write(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        files, before, copy = Files(target, roll_bytes), None, 0
        for batch in batches:
            for page, url, body, digest, original, first, shard in zip(
                batch["page_id"], batch["url"], batch["body"], batch["digest"], batch["original"], batch["first_of"], batch["shard"]
            ):
                copy = copy + 1 if (page, digest) == before else 0
                before = (page, digest)
                alone = first is None or (first and copy == 0)
                member = gzip.compress(record(page, url, zlib.decompress(body), digest, copy, None if alone else (original,)), 6, mtime=0)
                files.add(shard, member)
        files.close()
        yield {n: [d[n] for d in files.done] for n in ("file", "shard", "bytes", "records", "file_sha256")}

    manifest = map_rows(dealt, write, "file string, shard long, bytes long, records long, file_sha256 string")
    manifest.write.parquet(f"{target}/_manifest")


def read_archives(spark, target: str, id_type: str = "long", payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest names, sizes and digests checked.

    Without `payloads` the bodies are checked but not returned.
    """
    manifest = spark.read.parquet(f"{target}/_manifest").select("file", "bytes")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(target)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(manifest, "file")

    def parse(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        whole = int if id_type in ("long", "bigint", "int") else str
        for batch in batches:
            for name, content, size in zip(batch["file"], batch["content"], batch["bytes"]):
                if len(content) != size:
                    raise ValueError(f"{name} differs from its manifest")
                held = 0
                out: dict[str, list] = {n: [] for n in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                for headers, block in records_in(content):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"damaged payload {headers['WARC-Record-ID']}")
                    page, other = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page")
                    out["page_id"].append(None if page is None else whole(page))
                    out["url"].append(headers["WARC-Target-URI"])
                    out["payload"].append(payload if payloads and kind == "response" else None)
                    length = len(payload) if kind == "response" else int(head.rpartition(b"Content-Length: ")[2])
                    out["payload_bytes"].append(length)
                    out["payload_digest"].append(digest)
                    out["record_type"].append(kind)
                    out["refers_to"].append(None if other is None else whole(other))
                    held += len(payload) if payloads else 0
                    if held > 8 << 20 or len(out["page_id"]) >= 2000:
                        yield out
                        out, held = {n: [] for n in out}, 0
                yield out

    return map_rows(
        named, parse,
        f"page_id {id_type}, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}",
    )


def archive_round_trip(pages: DataFrame, target: str | None = None) -> DataFrame:
    """Write the archives and read them back: one row per page, digests and sizes of the full payloads."""
    target = target or new_folder(pages.sparkSession, "warc")
    write_archives(pages, target)
    got = read_archives(pages.sparkSession, target, type_of(pages, "page_id"), payloads=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
