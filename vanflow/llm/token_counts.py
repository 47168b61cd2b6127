"""Token counts: texts are encoded in batches inside Arrow functions and only lengths come back.

Batches are balanced by bytes, not by rows, and a long text is cut: texts are
split at ASCII blanks, which is safe for this vocabulary (its normaliser works
character by character and composes nothing with a blank, its pre-tokeniser
ends every word there, no special token's name holds one), so the counts of the
parts add up. A part that a batch repeats is encoded once, and so is a word
with and without a final stop or comma; lengths of the words of late are kept.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from vanflow.llm.base import keyed, type_of
from vanflow.session import ship_package

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENS = 2048
BATCH_CHARS = 1 << 20  # characters of text encoded at a time
KNOWN = 200_000  # words whose lengths a task keeps for sure, and twice as many at most

_STOPS = frozenset(".,")


class Counter:
    """Token counts of texts; remembers the lengths of the words it met last."""

    def __init__(self, tokenizer: Tokenizer, batch_chars: int = BATCH_CHARS, known: int = KNOWN):
        self.tokenizer, self.batch_chars, self.most = tokenizer, batch_chars, known
        self.lengths: dict[str, int] = {}
        self.before: dict[str, int] = {}

    def count(self, texts: Iterator[str]) -> list[int]:
        """Tokens of each text."""
        counts, parts, owners, held = [], [], [], 0
        for i, text in enumerate(texts):
            counts.append(0)
            for part in self._cut(text):
                parts.append(part)
                owners.append(i)
                held += len(part)
                if held >= self.batch_chars:
                    self._add(parts, owners, counts)
                    parts, owners, held = [], [], 0
        self._add(parts, owners, counts)
        return counts

    def _cut(self, text: str) -> Iterator[str]:
        """Parts of about the size of a batch, cut at blanks; a longer word stays whole."""
        if "<|" not in text:  # a special token's name counts by its letters' case
            text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        at = 0
        while len(text) - at > self.batch_chars:
            gap = text.find(" ", at + self.batch_chars)
            if gap < 0:
                break
            yield text[at:gap]
            at = gap + 1
        yield text[at:]

    def _add(self, parts: list[str], owners: list[int], counts: list[int]) -> None:
        split = [part.split(" ") for part in parts]
        self._learn(set().union(*split))
        length = self.lengths.__getitem__
        for owner, words in zip(owners, split):
            counts[owner] += sum(map(length, words))

    def _learn(self, words: set[str]) -> None:
        missing = words.difference(self.lengths)
        if len(self.lengths) + len(missing) > self.most:
            self.before, self.lengths, missing = self.lengths, {}, words
        for word in missing.intersection(self.before):
            self.lengths[word] = self.before[word]
        missing = missing.difference(self.lengths)
        # A letter before a final stop or comma ends a word of its own.
        ended = {w for w in missing if w[-1:] in _STOPS and w[-2:-1].isascii() and w[-2:-1].isalpha() and "<|" not in w}
        bodies = list(((missing - ended) | {w[:-1] for w in ended}).difference(self.lengths))
        for low in range(0, len(bodies), 20_000):
            part = bodies[low : low + 20_000]
            self.lengths.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        for word in ended:
            self.lengths[word] = self.lengths[word[:-1]] + 1


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """One row per input row: bytes, tokens and whether they exceed `max_tokens`.

    A null text is empty (no tokens); special tokens named in a text count as
    the library's default has it; null and repeated identifiers are kept, one
    answer a row; an empty table gives no rows; further columns are ignored.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    source = keyed(docs, id_col, text_col)
    ship_package(docs.sparkSession)
    struct = T.StructType.fromDDL(f"doc_id {type_of(source, 'doc_id')}, n_bytes long, n_tokens long, over_limit boolean")
    schema = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        counter = Counter(Tokenizer.from_file(path))
        for batch in batches:
            body = pc.fill_null(batch.column(1), "")
            counts = pa.array(counter.count(body.to_pylist()), pa.int64())
            size = pc.cast(pc.binary_length(body), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, counts, pc.greater(counts, max_tokens)], schema=schema)

    return source.mapInArrow(run, struct).withColumnRenamed("doc_id", id_col)
