"""Substring deduplication by seed and extend over winnowed anchors.

Seed: the smallest hash of ANCHOR consecutive words in every window of words
is that window's anchor, so equal windows have equal anchors. Extend: the
windows that follow one another with one anchor are extended both ways to the
words they all cover, their context. Documents meet on (anchor, context): the
first document of a context keeps it, all later ones have it covered. Only
anchors that occur in different contexts need a closer look: of each distinct
context one copy is compared window by window. Adjacent covered windows merge
into maximal repeats. Rows grow with the words, never with pairs of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanflow.llm.base import keyed, map_rows, type_of
from vanflow.session import materialise

WINDOW = 50
ANCHOR = 10
_RUN = 41  # windows of one context, at most 63 for a 64-bit mask

# Odd multipliers that mix word hashes.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str | None) -> list[bytes]:
    """Runs without blanks and the controls 9 to 13."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _A) ^ (b + _B)
    x ^= x >> np.uint64(29)
    x *= _B
    return x ^ (x >> np.uint64(32))


def _spans(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words, from runs of powers of two."""
    out, at, power, size = None, 0, hashes, 1
    n = len(hashes) - width + 1
    while size <= width:
        if width & size:
            part = power[at : at + n]
            out = part if out is None else _mix(out, part)
            at += size
        if size * 2 <= width:
            power = _mix(power[:-size], power[size:])
        size *= 2
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values."""
    n, size = len(values) - width + 1, 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])


def word_hashes(words: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
    if len(cache) > 1_000_000:
        cache.clear()
    digest = xxhash.xxh64_intdigest
    for w in set(words).difference(cache):
        cache[w] = digest(w)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def contexts(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (anchor, context hash, first window, windows)."""
    smallest = _least(_spans(hashes, anchor), window - anchor + 1)
    change = np.flatnonzero(smallest[1:] != smallest[:-1]) + 1
    first = np.concatenate([[0], change])
    ends = np.concatenate([change, [len(smallest)]])
    longest = min(_RUN, window)
    if (ends - first).max() > longest:
        pieces = [np.arange(a, b, longest) for a, b in zip(first, ends)]
        first = np.concatenate(pieces)
        ends = np.concatenate([first[1:], [len(smallest)]])
    runs = ends - first
    # A context's first and last window overlap or touch, so together with its length they fix all its words.
    whole = _spans(hashes, window)
    context = _mix(_mix(whole[first], whole[ends - 1]), runs.astype(np.uint64))
    return smallest[first], context, first, runs


def _signed(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """One row per input row: its words, those removed, a digest of the kept words and the removed spans.

    A word goes if a window of `window` consecutive words covers it whose words
    also start in a document with a smaller identifier; windows are judged on
    the input. A null text has no words; texts shorter than a window keep all;
    rows that repeat an identifier do not remove one another; a null identifier
    neither removes nor loses; an empty table gives no rows; further columns
    are ignored.
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor has at least one word and at most a window's")
    source = keyed(docs, id_col, text_col)
    id_type = type_of(source, "doc_id")
    source = source.withColumn("key", F.xxhash64("doc_id", "text"))

    def seed(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("a", "s", "doc_id", "key", "i", "r")}
            for doc, key, text in zip(batch["doc_id"], batch["key"], batch["text"]):
                words = words_of(text)
                if len(words) < window or doc is None:
                    continue
                a, s, first, runs = contexts(word_hashes(words, cache), window, anchor)
                out["a"] += _signed(a)
                out["s"] += _signed(s)
                out["i"] += first.tolist()
                out["r"] += runs.tolist()
                out["doc_id"] += [doc] * len(a)
                out["key"] += [key] * len(a)
                if len(out["a"]) > 200_000:
                    yield out
                    out = {n: [] for n in out}
            yield out

    found = materialise(map_rows(source, seed, f"a long, s long, doc_id {id_type}, key long, i int, r int"), "anchors")
    groups = found.groupBy("a", "s").agg(
        F.min(F.struct("doc_id", "key", "i", "r")).alias("owner"), F.max("doc_id").alias("latest"), F.count("*").alias("n")
    )
    groups = materialise(groups.select("a", "s", "n", "latest", "owner.*"), "contexts")
    contested = groups.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1").select("a")
    close = groups.join(contested, "a").groupBy("key").agg(F.collect_list(F.struct("a", "s", "i", "r")).alias("runs"))

    def extend(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("w", "doc_id", "a", "s", "off")}
            done = set()
            for doc, key, text, runs in zip(batch["doc_id"], batch["key"], batch["text"], batch["runs"]):
                if key in done:
                    continue
                done.add(key)
                whole = _spans(word_hashes(words_of(text), cache), window)
                for run in runs:
                    i, r = run["i"], run["r"]
                    out["w"] += _signed(whole[i : i + r])
                    out["off"] += range(r)
                    out["doc_id"] += [doc] * r
                    out["a"] += [run["a"]] * r
                    out["s"] += [run["s"]] * r
                if len(out["w"]) > 200_000:
                    yield out
                    out = {n: [] for n in out}
            yield out

    fine = map_rows(
        source.join(close, "key").select("doc_id", "key", "text", "runs"), extend, f"w long, doc_id {id_type}, a long, s long, off int"
    )
    fine = materialise(fine, "windows")
    least = fine.groupBy("w").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("w", "least")
    late = fine.join(least, "w").where(F.col("doc_id") > F.col("least"))
    masks = late.groupBy("a", "s").agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("mask"))
    judged = groups.join(masks, ["a", "s"], "left").where("latest > doc_id or mask is not null")
    judged = judged.select("a", "s", F.col("doc_id").alias("first_doc"), F.coalesce("mask", F.lit(0)).cast("long").alias("mask"))
    full = F.expr("shiftleft(1L, r) - 1")
    covered = found.join(judged, ["a", "s"]).select(
        "key", "i", F.when(F.col("doc_id") > F.col("first_doc"), full).otherwise(F.col("mask")).alias("mask")
    )
    covered = covered.where("mask != 0").distinct().groupBy("key").agg(F.collect_list(F.struct("i", "mask")).alias("runs"))

    def cut(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch["doc_id"], "n_words": [], "n_removed": [], "kept_sha256": [], "removed_spans": []}
            for text, runs in zip(batch["text"], batch["runs"]):
                words = words_of(text)
                turns = np.zeros(len(words) + 1, np.int64)
                for run in runs or ():
                    bits = np.flatnonzero((run["mask"] >> np.arange(_RUN)) & 1) + run["i"]
                    np.add.at(turns, bits, 1)
                    np.add.at(turns, bits + window, -1)
                gone = np.cumsum(turns[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = edges.reshape(-1, 2).tolist()
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                out["removed_spans"].append(",".join(f"{a}:{b}" for a, b in spans))
            yield out

    return map_rows(
        source.join(covered, "key", "left").select("doc_id", "text", "runs"), cut,
        f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, removed_spans string",
    ).withColumnRenamed("doc_id", id_col)
