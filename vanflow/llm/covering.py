"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit position i carries a vector m(i) of radius+1 bits. For every non-zero
vector v, mask v keeps the positions where <m(i), v> is odd. Any `radius`
positions leave some v orthogonal to all their vectors, so two fingerprints
that differ in at most `radius` bits agree on everything some mask keeps:
every such pair collides in some table.

Inside a bucket no pairs are made. Two fingerprints within 2s bits meet in a
word that differs from each in at most s bits, so each fingerprint of a bucket
with company names its neighbours inside the mask's free bits, and equal names
link. For an odd radius the second half reaches one bit less.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanflow.llm.base import keyed, map_rows, type_of
from vanflow.llm.graph import components
from vanflow.session import materialise

SEED = 42
BITS = 64
RADIUS = 2
SHINGLE = 3


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the shingles' hashes; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for low in range(0, n, 65_536):
        part = [digest(line[a:b], seed) for a, b in zip(first[low : low + 65_536], last[low : low + 65_536])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > n)))


def masks(radius: int) -> list[int]:
    """One 64-bit mask per non-zero vector of radius+1 bits."""
    span = (1 << (radius + 1)) - 1
    vectors = [1 + i % span for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, span + 1)]


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    source = keyed(docs, id_col, text_col)

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "word": [_signed(simhash(t, shingle)) for t in batch["text"]]}

    return map_rows(source, work, f"doc_id {type_of(source, 'doc_id')}, word long")


def links(words: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges between distinct fingerprints that connect exactly those within `radius` bits.

    Rows grow with the number of fingerprints that share a bucket, never with
    its pairs: sum over s <= radius/2 of C(free bits, s) per row and table.
    """
    if radius < 1:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    tables = masks(radius)
    keys = F.array(*[F.col("word").bitwiseAND(F.lit(_signed(m))) for m in tables])
    rows = words.select("word", F.posexplode(keys).alias("t", "key"))
    company = rows.groupBy("t", "key").agg(F.min("word").alias("least"), F.max("word").alias("most"))
    shared = rows.join(company.where("least != most").select("t", "key"), ["t", "key"])
    reach = (radius + 1) // 2
    changes = []
    for mask in tables:
        free = [i for i in range(BITS) if not mask >> i & 1]
        flips = [sum(1 << i for i in chosen) for s in range(reach + 1) for chosen in combinations(free, s)]
        changes.append(F.array(*[F.lit(_signed(c)) for c in flips]))
    meeting = shared.select("word", F.explode(F.array(*changes)[F.col("t")]).alias("change")).select(
        "word", F.col("word").bitwiseXOR(F.col("change")).alias("name")
    )
    if radius % 2:
        return _odd(meeting, radius)
    middle = meeting.groupBy("name").agg(F.collect_set("word").alias("ws")).where(F.size("ws") > 1)
    return middle.select(F.explode("ws").alias("a"), F.array_min("ws").alias("b")).where("a != b").distinct()


def _odd(meeting: DataFrame, radius: int) -> DataFrame:
    """An odd radius: pairs that meet are measured, as two words may meet at radius + 1 bits."""
    a = meeting.select("name", F.col("word").alias("a")).distinct()
    b = meeting.select("name", F.col("word").alias("b")).distinct()
    near = a.join(b, "name").where("a > b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return near.select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """One row per input row: its fingerprint and the smallest identifier its links reach.

    A null or wordless text has fingerprint zero and is linked like any other;
    fewer words than a shingle make one shingle. Equal fingerprints are one
    node, so copies and ties cost nothing further; repeated rows are answered
    each; null identifiers never name a component (null if it has no other);
    an empty table gives no rows; further columns are ignored.
    """
    printed = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = materialise(printed.groupBy("word").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("word"), radius))
    placed = classes.join(roots, classes.word == roots.node, "left").select(
        "word", "least", F.coalesce("root", "word").alias("root")
    )
    placed = materialise(placed, "placed")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = placed.join(names, "root").select("word", "component_id")
    return printed.join(answer, "word").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("word"), 16, "0")).alias("fingerprint"), "component_id"
    )
