"""Spelling variants: groups of words one edit apart, by a relational trie frontier.

The vocabulary's trie is a distributed table of nodes (a node is its prefix)
with an edge to each by parent and letter. A frontier state is a pair of nodes
whose prefixes differ by one edit: (word, position) is the first node, shared
by all words with that prefix, the second is the node reached in the trie.
States without an edit are the nodes themselves; level by level they spawn
states by a replaced letter (two children of one node) or an inserted letter (a
node and its child), and all states move one letter on by joining both nodes
with the edge table. A state of two words makes them neighbours. An inserted
letter must differ from the one before it, so each pair is met once.

A node has at most as many children as the alphabet has letters, so no join key
is hot and no group is paired beyond its alphabet.

Levels would be as many as letters of the longest word. Words of LONG letters
and more meet by hashes of the word with one letter left out instead, and are
compared exactly; a word of LONG letters is in both parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanflow.llm.base import keyed
from vanflow.session import materialise

LONG = 32
MIN_LETTERS = 7
MIN_COUNT = 2
DOMINANCE = 10
DAMAGE_EVERY = 31

# The letters of words and those that are lower-cased.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT,
    damage_every: int | None = DAMAGE_EVERY,
) -> DataFrame:
    """(word, n): lower-cased runs of letters with at least `min_letters` code points and `min_count` occurrences.

    With `damage_every`, a run loses one letter in documents where the crc32 of
    `identifier:run` is a multiple of it (a null identifier counts as empty).
    """
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    # Only a run of that many letters can give a word.
    runs = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{min_letters},}}"), F.lit(0))
    words = keyed(docs, id_col, text_col).select("doc_id", F.explode(runs).alias("word"))
    if damage_every:
        key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
        words = words.withColumn("h", F.crc32(key.cast("binary")))
        at = F.pmod(F.col("h"), F.char_length("word")).cast("int")
        shorter = F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))
        words = words.select(F.when(F.col("h") % damage_every == 0, shorter).otherwise(F.col("word")).alias("word"))
        words = words.where(F.char_length("word") >= min_letters)
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def trie(words: DataFrame, deepest: int) -> DataFrame:
    """(depth, node, parent, letter, is_word) of every prefix of the words, the empty one left out."""
    prefixes = words.select("word", F.explode(F.sequence(F.lit(1), F.least(F.char_length("word"), F.lit(deepest)))).alias("depth"))
    prefixes = prefixes.select(
        "depth", F.substr("word", F.lit(1), F.col("depth")).alias("node"), (F.char_length("word") == F.col("depth")).alias("whole")
    )
    nodes = prefixes.groupBy("depth", "node").agg(F.max("whole").alias("is_word"))
    return nodes.select(
        "depth", "node", F.substr("node", F.lit(1), F.col("depth") - 1).alias("parent"),
        F.substr("node", F.col("depth"), F.lit(1)).alias("letter"), "is_word",
    ).sortWithinPartitions("depth")  # so that a level reads its own pages


def _level(nodes: DataFrame, *depths: int) -> DataFrame:
    return nodes.where(F.col("depth").isin(*depths))


def _spawn(nodes: DataFrame, depth: int) -> DataFrame:
    """States whose shorter node is at `depth` and ends with the edit: a replaced letter, or one inserted after it."""
    level = _level(nodes, depth)
    a, b = level.alias("a"), level.alias("b")
    replaced = a.join(b, F.col("a.parent") == F.col("b.parent")).where("a.letter < b.letter").select(
        F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.is_word").alias("a_word"), F.col("b.is_word").alias("b_word")
    )
    above = level.select(F.col("node").alias("a"), F.col("letter").alias("before"), F.col("is_word").alias("a_word"))
    below = _level(nodes, depth + 1).select("parent", "letter", F.col("node").alias("b"), F.col("is_word").alias("b_word"))
    inserted = above.join(below, F.col("a") == F.col("parent")).where("letter != before").select("a", "b", "a_word", "b_word")
    return replaced.union(inserted)


def _step(states: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """States whose shorter node is one level deeper, at `depth`, along letters that both nodes have."""
    left = _level(nodes, depth).select(F.col("parent").alias("a"), "letter", F.col("node").alias("a_next"), F.col("is_word").alias("a_word"))
    right = _level(nodes, depth, depth + 1).select(F.col("parent").alias("b"), "letter", F.col("node").alias("b_next"), F.col("is_word").alias("b_word"))
    ahead = states.select("a", "b").join(left, "a").join(right, ["b", "letter"])
    return ahead.select(F.col("a_next").alias("a"), F.col("b_next").alias("b"), "a_word", "b_word")


def _first_letters(nodes: DataFrame) -> DataFrame:
    """States of the empty prefix and an inserted first letter."""
    return _level(nodes, 1).select(F.lit("").alias("a"), F.col("node").alias("b"), F.lit(False).alias("a_word"), F.col("is_word").alias("b_word"))


def _long_pairs(words: DataFrame) -> DataFrame:
    """Pairs of long words one edit apart: words that agree when one letter is left out, or one with such a rest of the other."""
    size = F.char_length("word")
    held = words.select("word", F.xxhash64("word").alias("id"), size.alias("size"))
    at = held.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size"))))
    rest = F.xxhash64(F.concat(F.substr("word", F.lit(1), F.col("at") - 1), F.substr("word", F.col("at") + 1)))
    rests = at.select("id", "size", "at", rest.alias("rest"))
    a, b = rests.alias("a"), rests.alias("b")
    replaced = a.join(b, (F.col("a.rest") == F.col("b.rest")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.size") == F.col("b.size")))
    replaced = replaced.where("a.id < b.id").select(F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    inserted = rests.alias("a").join(held.alias("b"), F.col("a.rest") == F.col("b.id")).select(F.col("b.id").alias("x"), F.col("a.id").alias("y"))
    pairs = replaced.union(inserted).distinct()
    named = pairs.join(held.select(F.col("id").alias("x"), F.col("word").alias("a")), "x").join(
        held.select(F.col("id").alias("y"), F.col("word").alias("b")), "y"
    )
    return named.where(F.levenshtein("a", "b", 1) == 1).select("a", "b")


def near_pairs(words: DataFrame, long: int = LONG) -> DataFrame:
    """(a, b), each pair of distinct `word`s once that differ by one inserted, deleted or replaced code point."""
    lengths = words.agg(F.max(F.char_length("word"))).first()[0] or 0
    found = []
    if lengths >= long:
        found.append(_long_pairs(words.where(F.char_length("word") >= long)))
    deepest = min(lengths, long)
    nodes = materialise(trie(words.where(F.char_length("word") <= long), deepest), "trie")
    states = _first_letters(nodes)
    for depth in range(1, deepest + 1):
        states = materialise(_step(states, nodes, depth).union(_spawn(nodes, depth)), "frontier")
        # Two words of `long` letters belong to the other part.
        found.append(states.where(F.col("a_word") & F.col("b_word") & (F.char_length("a") < long)).select("a", "b"))
    empty = words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    return reduce(DataFrame.union, found, empty)


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, by doubling; counts rise along a chain, so it ends."""
    current = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialise(current.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "forms")
        current = step.select("word", "root")
        if step.where("further IS NOT NULL").isEmpty():
            return current


def variants(words: DataFrame, dominance: int = DOMINANCE, long: int = LONG) -> DataFrame:
    """Form and root of every (word, n) row; words must be distinct.

    A word's form is its neighbour with the largest n (ties: first in
    code-point order) if that is at least `dominance` times its own; the root
    follows forms to the last and is the word itself without one. An empty
    table gives no rows; further columns are ignored.
    """
    known = materialise(words.select("word", "n"), "words")
    pairs = near_pairs(known, long)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select(F.col("b"), F.col("a")))
    weighed = both.join(known.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = weighed.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    largest = -F.col("best.m")
    wins = largest >= dominance * F.col("n")
    formed = materialise(
        known.join(best, "word", "left").select(
            "word", F.when(wins, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(wins, largest).alias("form_n"),
        ),
        "formed",
    )
    roots = _roots(formed.where(F.col("form").isNotNull()))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spelling variants of the words of whole texts.

    A null text has no words, a null identifier reads as an empty text,
    repeated rows count each; an empty table gives no rows; further columns are
    ignored.
    """
    return variants(vocabulary(docs, id_col, text_col))
