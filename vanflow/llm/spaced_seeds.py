"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is the hash of the words that a fixed mask selects from SPAN consecutive
words, so a substituted word under a gap of some mask does not hide a passage.
Document seeds probe the benchmark's seeds and say where an item may lie; then
the few documents with a hit are read again, the item is laid over each on the
hit's diagonal and the agreeing words are counted. Seeds travel as numbers,
without the words of documents or items. Few benchmark seeds are broadcast; of
many, two bytes a seed are (a Bloom filter in blocks), and the document seeds
that pass it meet them by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanflow.llm.base import keyed, unused
from vanflow.session import materialise, small_side

# Words under a 1 are hashed, those under a 0 ignored.
MASKS = ("11101011", "11011101", "10110111")
SPAN = 8
MIN_OVERLAP = 0.5
MAX_SEED_ROWS = 500_000  # benchmark seeds that are broadcast; beyond, the filter is, and what passes it is joined by shuffle
MAX_HELD_ROWS = 500_000  # documents with a hit whose keys are broadcast
BLOCK_SEEDS = 256  # seeds of a block of the filter, at 16 bits each
WORDS = 64  # numbers of 64 bits in a block


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(hashes: str, position: str) -> Column:
    keys = []
    for number, mask in enumerate(MASKS):
        chosen = [F.get(F.col(hashes), F.col(position) + i) for i, bit in enumerate(mask) if bit == "1"]
        keys.append(F.xxhash64(F.lit(number), *chosen))
    return F.explode(F.array(*keys))


def _seeded(df: DataFrame, hashes: str) -> DataFrame:
    """(all columns but the hashes, at, seed) of every window of SPAN words."""
    kept = [F.col(c) for c in df.columns if c != hashes]
    placed = df.select(*kept, hashes, F.posexplode(hashes).alias("at", "_word")).where(F.col("at") + SPAN <= F.size(hashes))
    return placed.select(*kept, "at", _seeds(hashes, "at").alias("seed"))


def _places() -> list[tuple[Column, Column]]:
    """A seed's bits in its block: the number and the bit in it, from four parts of the seed."""
    parts = [F.shiftrightunsigned("seed", 12 * i).bitwiseAND(F.lit(WORDS * 64 - 1)) for i in range(4)]
    return [(F.shiftright(p, 6).cast("int"), p.bitwiseAND(F.lit(63)).cast("int")) for p in parts]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def passing(rows: DataFrame, seeds: DataFrame, count: int) -> DataFrame:
    """The rows whose `seed` is one of `count` rows of `seeds`, and few others (some 0.3 %)."""
    block = F.pmod(F.col("seed"), F.lit(count // BLOCK_SEEDS | 1))  # odd, so that it says little of the parts' bits
    bits = F.explode(F.array(*[F.struct(at.alias("at"), _bit(bit).alias("bit")) for at, bit in _places()]))
    words = seeds.select(block.alias("_block"), bits.alias("_b")).groupBy("_block", "_b.at").agg(F.bit_or("_b.bit").alias("bits"))
    whole = words.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("_m")).select(
        "_block", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0).cast("long"))).alias("_bits")
    )
    filtered = rows.withColumn("_block", block).join(F.broadcast(materialise(whole, "filter")), "_block")
    for at, bit in _places():
        filtered = filtered.where(F.get("_bits", at).bitwiseAND(_bit(bit)) != 0)
    return filtered.select(*rows.columns)


def _hits(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(doc_id, print, item, shift): where an item may begin in a text."""
    rows = _seeded(texts, "h")
    known = small_side(seeds, MAX_SEED_ROWS)
    if known is seeds:
        rows = passing(rows, seeds, seeds.count())
    return rows.join(known, "seed").select("doc_id", "print", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def contaminated_pairs(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", min_overlap: float = MIN_OVERLAP,
) -> DataFrame:
    """(document, item) pairs of which at least `min_overlap` of the item's words lie in the document in place.

    Agreeing positions are united over all diagonals with a hit, so an
    insertion splits a passage without hiding it; at least SPAN words must
    agree. Case and punctuation are ignored. A null text holds no words; items
    and documents of fewer than SPAN words match nothing; repeated rows of one
    identifier give one pair; a null identifier is a group of its own; empty
    tables give no rows; further columns are ignored.
    """
    texts = keyed(docs, id_col, text_col).withColumn("print", F.xxhash64("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), word_hashes(F.col(item_text)).alias("b"))
    # items of the same words are laid once; their identifiers come back at the end
    items = materialise(items.where(F.size("b") >= SPAN).distinct().withColumn("item", F.xxhash64("b")), "items")
    laid_once = materialise(items.groupBy("item").agg(F.first("b").alias("b")), "item_words")
    seeds = materialise(_seeded(laid_once, "b").select("seed", "item", F.col("at").alias("item_at")).distinct(), "seeds")
    hashed = texts.select("doc_id", "print", word_hashes(F.col("text")).alias("h")).where(F.size("h") >= SPAN)
    hits = materialise(_hits(hashed, seeds), "hits")
    keys = small_side(materialise(hits.select(F.col("doc_id").alias("_id"), F.col("print").alias("_print")).distinct(), "hit_keys"), MAX_HELD_ROWS)
    held = texts.join(keys, texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["print"] == F.col("_print")), "left_semi")
    words = held.dropDuplicates(["doc_id", "print"]).select(
        F.col("doc_id").alias("_id"), F.col("print").alias("_print"), word_hashes(F.col("text")).alias("h"))
    found = hits.join(words, hits["doc_id"].eqNullSafe(F.col("_id")) & (hits["print"] == F.col("_print"))).join(small_side(laid_once), "item")
    agree = F.filter(F.sequence(F.lit(0), F.size("b") - 1), lambda j: F.get(F.col("b"), j) == F.get(F.col("h"), j + F.col("shift")))
    laid = found.select("doc_id", "item", F.size("b").alias("item_words"), agree.alias("agree"))
    pairs = laid.groupBy("doc_id", "item", "item_words").agg(F.array_distinct(F.flatten(F.collect_set("agree"))).alias("agree"))
    named = pairs.join(items.select("item_id", "item"), "item").groupBy("doc_id", "item_id", "item_words")
    pairs = named.agg(F.array_distinct(F.flatten(F.collect_list("agree"))).alias("agree"))
    scored = pairs.select(
        F.col("doc_id"), "item_id", F.size("agree").cast("long").alias("matched_words"), F.col("item_words").cast("long").alias("item_words"),
        F.round(F.size("agree") / F.col("item_words"), 6).alias("overlap"),
    )
    kept = scored.where((F.col("matched_words") >= SPAN) & (F.col("overlap") >= min_overlap))
    return kept.select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_col), "matched_words", "item_words", "overlap")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark passage."""
    pairs, held = contaminated_pairs(docs, benchmark, id_col, **options), unused(docs, "_held")
    found = materialise(pairs.select(F.col(id_col).alias(held)).distinct(), "held")
    return docs.join(small_side(found), docs[id_col].eqNullSafe(F.col(held)), "left_anti")
