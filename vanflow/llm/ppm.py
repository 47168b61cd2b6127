"""Language identification by prediction by partial matching.

Per language, a tree of byte contexts of up to ORDER bytes with symbol counts.
A byte costs -log2 of its probability in the longest known context; where the
context lacks it, an escape (method C) leads to the next shorter context, from
which the symbols already ruled out are excluded, down to equal odds over all
bytes. The statistics are frozen after training, so the cost of a byte is a
function of the bytes before it: costs of all windows of ORDER + 1 bytes that
training saw are tabled once, others are worked out on first sight.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vanflow.llm.base import keyed, map_rows, release, type_of
from vanflow.session import materialise, ship_package, small_side

ORDER = 3
SAMPLE_PER_LANGUAGE = 1500  # labelled documents that train a language's tree, by hash of identifier and text
UNKNOWN = "und"
SEEN = 50_000  # windows that training lacked whose costs a task keeps

# Letters are lower-cased, other ASCII becomes a blank; bytes above 127 stay.
_FOLD = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
_PIECE = 1 << 20


def fold(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD)


def windows(before: bytes, body: bytes) -> np.ndarray:
    """One 32-bit word per byte of `body`: the byte and the ORDER bytes before it."""
    b = np.frombuffer(before + body, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


class ContextTree:
    """Symbol counts of every context of 0 to ORDER bytes of one language."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.nodes: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for gram, count in zip(grams.tolist(), counts.tolist()):
            window = gram.to_bytes(4, "big")
            for order in range(ORDER + 1):
                self.nodes[window[ORDER - order : ORDER]][window[ORDER]] += count
        self.nodes = {context: dict(symbols) for context, symbols in self.nodes.items()}

    def cost(self, gram: int) -> float:
        """Code length in bits of a window's last byte."""
        window = int(gram).to_bytes(4, "big")
        symbol, p, out = window[ORDER], 1.0, set()
        for order in range(ORDER, -1, -1):
            symbols = self.nodes.get(window[ORDER - order : ORDER])
            if not symbols:
                continue
            total = sum(symbols.values()) - sum(symbols[s] for s in out if s in symbols)
            kinds = len(symbols) - sum(s in symbols for s in out)
            if not kinds:
                continue
            if symbol in symbols:
                return float(-np.log2(p * symbols[symbol] / (total + kinds)))
            p *= kinds / (total + kinds)
            out |= symbols.keys()
        return float(-np.log2(p / (256 - len(out))))


@dataclass
class Model:
    """Frozen statistics: the languages' trees and the tabled costs, by open addressing on the window."""

    languages: list[str]
    grams: np.ndarray
    costs: np.ndarray
    trees: list[tuple[np.ndarray, np.ndarray]]

    def ready(self) -> Model:
        bits = max(10, int(len(self.grams) * 4).bit_length())
        self.shift, self.size = np.uint32(32 - bits), 1 << bits
        self.keys = np.zeros(self.size, np.uint32)
        self.slot = np.full(self.size, -1, np.int32)
        where = self._home(self.grams)
        todo = np.arange(len(self.grams))
        while len(todo):
            free = self.slot[where[todo]] < 0
            placed, first = np.unique(where[todo][free], return_index=True)
            chosen = todo[free][first]
            self.slot[placed], self.keys[placed] = chosen, self.grams[chosen]
            todo = np.setdiff1d(todo, chosen, assume_unique=True)
            where[todo] = (where[todo] + 1) % self.size
        self.built = None
        self.seen: dict[int, list[float]] = {}
        return self

    def _home(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint32(2654435761)) >> self.shift).astype(np.int64)

    def look_up(self, grams: np.ndarray) -> np.ndarray:
        """Costs of windows, one column per language."""
        where = self._home(grams)
        row = np.where(self.keys[where] == grams, self.slot[where], -2)
        row[self.slot[where] < 0] = -1
        todo = np.flatnonzero(row == -2)
        while len(todo):
            where[todo] = (where[todo] + 1) % self.size
            spot = where[todo]
            hit = self.slot[spot]
            row[todo] = np.where(hit < 0, -1, np.where(self.keys[spot] == grams[todo], hit, -2))
            todo = todo[row[todo] == -2]
        out = self.costs[row]
        new = np.flatnonzero(row == -1)
        if len(new):
            distinct, back = np.unique(grams[new], return_inverse=True)
            out[new] = np.array([self._work_out(int(g)) for g in distinct], np.float32)[back]
        return out

    def _work_out(self, gram: int) -> list[float]:
        if gram not in self.seen:
            if self.built is None:
                self.built = [ContextTree(*t) for t in self.trees]
            if len(self.seen) > SEEN:
                self.seen.clear()
            self.seen[gram] = [t.cost(gram) for t in self.built]
        return self.seen[gram]

    def bits(self, bodies: list[bytes]) -> np.ndarray:
        """Total code length of each string under each language."""
        total = np.zeros((len(bodies), len(self.languages)))
        chunk, owners, ends, held = [], [], [], 0

        def score() -> None:
            nonlocal chunk, owners, ends, held
            if chunk:
                sums = np.add.reduceat(self.look_up(np.concatenate(chunk)), [0, *ends[:-1]], axis=0, dtype=np.float64)
                np.add.at(total, owners, sums)
            chunk, owners, ends, held = [], [], [], 0

        for i, body in enumerate(bodies):
            for low in range(0, len(body), _PIECE):
                before = body[low - ORDER : low] if low else b" " * ORDER
                chunk.append(windows(before, body[low : low + _PIECE]))
                held += len(chunk[-1])
                owners.append(i)
                ends.append(held)
                if held >= _PIECE:
                    score()
        score()
        return total


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Trees from at most about `per_language` labelled documents of each language, whole texts.

    `labelled` has doc_id, text and lang; every labelled language is learned.
    Sampling is by hash of identifier and text, so it does not depend on
    partitioning and rows without an identifier are sampled too. What reaches the driver
    is the distinct windows of that bounded sample.
    """
    named = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = small_side(materialise(named.groupBy("lang").agg(F.count("*").alias("_rows")), "languages"))
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")), F.lit(1_000_000)) / 1_000_000
    sample = named.join(sizes, "lang").where(chance < F.lit(per_language) / F.col("_rows")).select("lang", "text")

    def count(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for batch in batches:
            by: dict[str, list] = defaultdict(list)
            for lang, text in zip(batch["lang"], batch["text"]):
                if text:
                    by[lang].append(windows(b" " * ORDER, fold(text)))
            for lang, parts in by.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield {"lang": [lang] * len(grams), "gram": grams.astype(np.int64).tolist(), "n": n.tolist()}

    counted = map_rows(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    trees = []
    for lang in languages:
        own = counted[counted["lang"] == lang].sort_values("gram")
        trees.append((own["gram"].to_numpy(np.uint32), own["n"].to_numpy(np.int64)))
    grams = np.unique(np.concatenate([g for g, _ in trees])) if trees else np.zeros(0, np.uint32)
    built = [ContextTree(*t) for t in trees]
    costs = np.array([[t.cost(g) for t in built] for g in grams.tolist()], np.float32).reshape(len(grams), len(trees))
    return Model(languages, grams, costs, trees).ready()


def answers(model: Model, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """(language, score, bits per byte) of each text."""
    lettered = [bool(model.languages and t and any(map(str.isalpha, t))) for t in texts]
    bodies = [fold(t) if ok else b"" for t, ok in zip(texts, lettered)]
    out = []
    for ok, body, row in zip(lettered, bodies, model.bits(bodies)):
        if not ok:
            out.append((UNKNOWN, 0.0, 0.0))
            continue
        i = int(np.argmin(row))
        out.append((model.languages[i], float(1.0 / np.exp2(np.maximum(row[i] - row, -1000.0)).sum()), float(row[i] / len(body))))
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: language, probability of it among the known ones, and bits per byte under it.

    `und` with score 0 where the text is null or holds no letter, or no
    language is known; ties go to the first language by name; repeated rows are
    answered each; an empty table gives no rows; further columns are ignored.
    """
    source = keyed(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.grams, model.costs, model.trees))

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        known = Model(*shared.value).ready()
        for batch in batches:
            names = ("lang_pred", "score", "bits_per_byte")
            yield {"doc_id": batch["doc_id"], **dict(zip(names, map(list, zip(*answers(known, batch["text"])))))}

    return map_rows(source, work, f"doc_id {type_of(source, 'doc_id')}, lang_pred string, score double, bits_per_byte double").withColumnRenamed("doc_id", id_col)


def keep_identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", worst_bits: float = 8.0) -> DataFrame:
    """The rows, all columns, whose language is known.

    Rejected are `und` rows and texts that their best model codes no shorter
    than bytes of equal odds (`worst_bits` per byte). Rows are filtered where
    they are, so repeated rows and null identifiers need no rule.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.grams, model.costs, model.trees))
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value).ready()
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
            keep = [lang != UNKNOWN and rate < worst_bits for lang, _, rate in answers(known, texts)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        known = None
        release()

    return docs.mapInArrow(work, docs.schema)
