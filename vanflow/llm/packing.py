"""Vector bin packing of token sequences.

Every task packs its own rows as they stream by, so nothing is shuffled. A
document longer than a sequence gives whole sequences at once; its rest joins a
bounded pool. Sequences are filled from the pool by the dot-product heuristic:
of the pieces that fit under all limits (tokens, segments, loss-bearing
tokens), take the one whose demand vector has the largest dot product with what
the sequence has left. Where none fits, a piece is cut to fill the sequence.
Only each task's last sequences can stay short.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vanflow.llm.base import keyed, map_rows, type_of

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
MAX_TOKENS = 2048
MAX_SEGMENTS = 256
POOL = 512  # pieces that wait at a time
CACHE = 400_000  # distinct words whose ids a worker keeps for sure, and twice as many at most
GROUP = 2000  # texts encoded at a time

_STOPS = frozenset(".,")
_LOADED: dict[str, tuple[Tokenizer, dict[str, bytes], dict[str, bytes]]] = {}  # words of late and those before


def encode(texts: list[str], path: str) -> list[bytes]:
    """Token ids of each text as little-endian 32-bit words, without special tokens.

    The vocabulary folds case, drops white space and breaks between letters and
    punctuation before it merges, so a text's ids are its words' ids in order,
    and a word's ids those of its body and of one final stop or comma. Every
    distinct body is encoded once per worker. ASCII case is folded ahead,
    except in texts that may hold a special token's name. Words are told apart
    and their ids gathered by whole arrays, not word by word.
    """
    if path not in _LOADED:
        _LOADED[path] = (Tokenizer.from_file(path), {}, {})
    tokenizer, cache, before = _LOADED[path]
    folded = []
    for text in texts:
        if "<|" not in text:
            text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        folded.append(text.replace("\n", " ").replace("\t", " ").replace("\r", " "))
    split = pc.split_pattern(pa.array(folded, pa.large_string()), " ")
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    missing = {word for word in names if word not in cache}
    if len(cache) + len(missing) > CACHE:
        # Words not seen since the last turn are forgotten.
        before, cache, missing = cache, {}, set(names)
        _LOADED[path] = (tokenizer, cache, before)
    for word in missing.intersection(before):
        cache[word] = before[word]
    missing = missing.difference(cache)
    ended = {w for w in missing if w[-1:] in _STOPS and w[-2:-1].isascii() and w[-2:-1].isalpha() and "<|" not in w}
    bodies = list(((missing - ended) | {w[:-1] for w in ended} | _STOPS).difference(cache))
    for i in range(0, len(bodies), 20_000):
        part = bodies[i : i + 20_000]
        for word, encoded in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)):
            cache[word] = array("I", encoded.ids).tobytes()
    for word in ended:
        cache[word] = cache[word[:-1]] + cache[word[-1]]
    # The texts' ids are gathered from those of the distinct words: word by word from `first` on, `size` ids each.
    known = [cache[name] for name in names]
    size = np.fromiter(map(len, known), np.int64, len(known)) // 4
    first = np.cumsum(size) - size
    places = coded.indices.to_numpy()
    taken = size[places]
    ends = np.concatenate(([0], np.cumsum(taken)))
    ids = np.frombuffer(b"".join(known), "<u4")[np.repeat(first[places] - ends[:-1], taken) + np.arange(ends[-1])].tobytes()
    cuts = (4 * ends[split.offsets.to_numpy()]).tolist()
    return [ids[low:high] for low, high in zip(cuts, cuts[1:])]


class Packer:
    """Places pieces of one task; a piece is (key, ids, loss mask or None, start)."""

    def __init__(self, first: int, max_tokens: int, max_segments: int, max_loss: int):
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.sequence, self.out = first, []
        self.items: list[tuple] = []
        self.demand = np.zeros((0, 3))

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, ids, _, start, total in pieces:
            n = len(ids) // 4
            self.out.append((key, start, n, zlib.crc32(ids), total, self.sequence, offset))
            offset += n
        self.sequence += 1

    def _vector(self, item: tuple) -> list[float]:
        n = len(item[1]) // 4
        return [n, 1, n if item[2] is None else int(item[2].sum())]

    def _cut(self, item: tuple, tokens: int, loss: float) -> tuple[tuple | None, tuple]:
        """The longest head of at most `tokens` ids and `loss` loss-bearing ids, and the rest."""
        key, ids, mask, start, total = item
        n = min(tokens, len(ids) // 4)
        if mask is None:
            n = min(n, int(loss))
        else:
            n = min(n, int(np.searchsorted(np.cumsum(mask), loss, side="right")))
        if not n:
            return None, item
        head = None if mask is None else mask[:n]
        tail = None if mask is None else mask[n:]
        return (key, ids[: 4 * n], head, start, total), (key, ids[4 * n :], tail, start + n, total)

    def add(self, key, ids: bytes, mask: np.ndarray | None) -> None:
        item = (key, ids, mask, 0, len(ids) // 4)
        while len(item[1]) // 4 >= self.limits[0]:
            head, item = self._cut(item, int(self.limits[0]), self.limits[2])
            if len(head[1]) // 4 == self.limits[0]:
                self._emit([head])
            else:
                self._wait(head)
        if item[1]:
            self._wait(item)
        while len(self.items) >= POOL:
            self._fill()

    def _wait(self, item: tuple) -> None:
        self.items.append(item)
        self.demand = np.vstack([self.demand, self._vector(item)])

    def _take(self, i: int) -> tuple:
        item = self.items[i]
        last = len(self.items) - 1
        self.items[i], self.demand[i] = self.items[last], self.demand[last]
        self.items.pop()
        self.demand = self.demand[:last]
        return item

    def _fill(self) -> None:
        left, placed = self.limits.copy(), []
        while self.items and left[0] >= 1 and left[1] >= 1:
            fits = (self.demand <= left).all(axis=1)
            if fits.any():
                worth = (self.demand / self.limits) @ (left / self.limits)
                item = self._take(int(np.argmax(np.where(fits, worth, -1.0))))
            else:
                longest = int(np.argmax(self.demand[:, 0]))
                item, rest = self._cut(self.items[longest], int(left[0]), left[2])
                if item is None:
                    break
                self.items[longest], self.demand[longest] = rest, self._vector(rest)
            placed.append(item)
            left -= self._vector(item)
        self._emit(placed)

    def finish(self) -> None:
        while self.items:
            self._fill()

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, tokenizer: str | None = None, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece, with its place in a sequence.

    `loss_col` names an array of [first, last) token ranges that bear loss
    (instruction data); without it every token does. A null text is empty and
    gives the end token alone; a null identifier is kept; repeated rows are
    packed each; an empty table gives no rows; further columns are ignored.
    Sequence numbers are the task's number times 2**32 plus a running number,
    so a repeated task gives the same rows.
    """
    max_loss = max_loss or max_tokens
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    source = keyed(docs, id_col, text_col)
    if loss_col:
        source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(loss_col).alias("loss"))

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << 32, max_tokens, max_segments, max_loss)
        end = np.array([end_id], "<u4").tobytes()

        def rows() -> dict[str, list]:
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            return dict(zip(names, map(list, zip(*taken)))) if (taken := packer.taken()) else {n: [] for n in names}

        for batch in batches:
            texts = [text or "" for text in batch["text"]]
            ranges = batch.get("loss") or [None] * len(texts)
            for low in range(0, len(texts), GROUP):
                for key, ids, spans in zip(batch["doc_id"][low : low + GROUP], encode(texts[low : low + GROUP], path), ranges[low : low + GROUP]):
                    mask = None
                    if loss_col:
                        mask = np.zeros(len(ids) // 4 + 1, bool)
                        for first, last in spans or ():
                            mask[max(first, 0) : max(last, 0)] = True
                    packer.add(key, ids + end, mask)
            yield rows()
        packer.finish()
        yield rows()

    return map_rows(
        source, work,
        f"doc_id {type_of(source, 'doc_id')}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
