"""Language-model scores by Katz backoff over word pairs.

P(w | h) of a pair seen in training is its Good-Turing discounted relative
frequency; an unseen pair backs off to alpha(h) * P(w), where alpha(h) shares
exactly the mass the discounts of h left over; P(w) in turn is the discounted
frequency of w, and what its discounts left goes to the class of unknown words.
For every context the probabilities of all known words, the end and the unknown
class sum to one.

Tokens travel once. Each task packs its word pairs, sorted and counted, by the
hash of the second word, so a bucket knows the counts of its pairs and words;
very frequent words are spread by pair and their counts sent along. Whatever
needs global constants (discounts) leaves the bucket as counts per discount
class: sums per document, and sums per context, which meet by context to give
alpha. A bucket's size is fixed; their number grows with the input.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vanflow.llm.base import map_rows
from vanflow.session import materialise

CLASSES = 5  # counts up to this one are discounted
BUCKET_TOKENS = 2_000_000
CHUNK_TOKENS = 1_000_000
CHUNK_DOCS = 50_000
HOT_WORDS = 65_536  # words at most that are spread over buckets
HOT_COUNT = 1000  # least count of a word that is spread over buckets
KEPT = 1 - 1e-6  # share of the mass that seen events keep after discounting, so that none is ever left without

BEGIN, END = np.uint64(xxhash.xxh64_intdigest(b" begin")), np.uint64(xxhash.xxh64_intdigest(b" end"))
_MIX = np.uint64(0x9E3779B97F4A7C15)


# Packing ------------------------------------------------------------------------------------------------------------


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Small counts are compressed, hashes are not compressible."""
    out = {}
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        out[name] = (a.dtype.str, raw if a.dtype == np.uint64 else zlib.compress(raw, 1))
    return pickle.dumps(out, 5)


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    return {
        n: np.frombuffer(raw if t == "<u8" else zlib.decompress(raw), t) for n, (t, raw) in pickle.loads(blob).items()
    }


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    return ((values * _MIX) >> np.uint64(33)).astype(np.int64) % n


def _starts(*columns: np.ndarray) -> np.ndarray:
    """First positions of runs of equal rows in sorted columns."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


# Tokens -------------------------------------------------------------------------------------------------------------


def tokens(text: str | None, cache: dict[bytes, int]) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(cache) > 300_000:
        cache.clear()
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh64_intdigest(w)
    out = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    return np.append(out, END)


def _chunks(batches: Iterator[dict[str, list]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(tokens, document index, document keys, training flags) of bounded size; a document is never split."""
    cache: dict[bytes, int] = {}
    parts, keys, train, held = [], [], [], 0

    def full():
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes), np.array(keys, np.int64).view(np.uint64), np.array(train, bool)

    for batch in batches:
        for text, key, learn in zip(batch["text"], batch["key"], batch["train"]):
            parts.append(tokens(text, cache))
            keys.append(key)
            train.append(learn)
            held += len(parts[-1])
            if held >= CHUNK_TOKENS or len(parts) >= CHUNK_DOCS:
                yield full()
                parts, keys, train, held = [], [], [], 0
    if parts:
        yield full()


def survey(source: DataFrame, bucket_tokens: int) -> tuple[int, int, dict[int, int]]:
    """(buckets, training documents, exact counts of frequent words), from two light passes.

    Frequent is a word with more than a quarter of a bucket's tokens, but at
    least 1 / HOT_WORDS of all; it has such a share in some task too, so tasks
    name their candidates and a second pass counts those that pass. At most
    HOT_WORDS words are kept.
    """

    def candidates(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for toks, doc, _, train in _chunks(batches):
            words, n = np.unique(toks[train[doc]], return_counts=True)
            top = np.flatnonzero(n * HOT_WORDS >= len(toks))
            out = {"w": words[top].view(np.int64).tolist(), "n": n[top].tolist()}
            yield {"w": [None, *out["w"]], "n": [len(toks), *out["n"]], "docs": [int(train.sum()), *[0] * len(top)]}

    found = map_rows(source, candidates, "w long, n long, docs long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = materialise(found, "frequent")
    whole = found.where("w is null").first()
    if whole is None:
        return 1, 0, {}
    buckets = max(1, -(-whole.n // bucket_tokens))
    least = max(HOT_COUNT, whole.n // min(4 * buckets, HOT_WORDS))
    hot = np.array([r.w for r in found.where(F.col("w").isNotNull() & (F.col("n") >= least)).collect()], np.int64).view(np.uint64)
    if not len(hot):
        return buckets, whole.docs, {}
    hot.sort()

    def exact(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for toks, doc, _, train in _chunks(batches):
            learned = toks[train[doc]]
            at = np.minimum(np.searchsorted(hot, learned), len(hot) - 1)
            n = np.bincount(at[hot[at] == learned], minlength=len(hot))
            yield {"w": hot.view(np.int64).tolist(), "n": n.tolist()}

    counts = map_rows(source, exact, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    return buckets, whole.docs, {int(np.int64(r.w).view(np.uint64)): r.n for r in counts}


# Buckets by word ----------------------------------------------------------------------------------------------------


def _packed_pairs(buckets: int, hot: np.ndarray):
    """Packed pairs per bucket and chunk; documents are named by their number in the chunk, whose keys travel once."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        context = TaskContext.get()
        chunk = (context.partitionId() if context else 0) << 20
        for toks, doc, keys, train in _chunks(batches):
            before = np.concatenate([[BEGIN], toks[:-1]]).astype(np.uint64)
            before[np.flatnonzero(np.diff(doc)) + 1] = BEGIN
            where = _bucket(toks, buckets)
            often = np.isin(toks, hot)
            where[often] = _bucket(toks[often] ^ (before[often] * _MIX), buckets)
            order = np.lexsort((doc, before, toks, where))
            edges = np.searchsorted(where[order], np.arange(buckets + 1))
            name, flags = np.array([chunk], np.int64), np.packbits(train)
            yield {"bucket": [chunk % buckets], "blob": [pack({"chunk": name, "keys": keys})]}
            for b in np.flatnonzero(np.diff(edges)):
                own = order[edges[b] : edges[b + 1]]
                w, h = toks[own], before[own]
                pairs = _starts(w, h)
                firsts = _starts(w[pairs])
                blob = {
                    "w": w[pairs][firsts], "kinds": np.diff(np.append(firsts, len(pairs))).astype(np.uint32), "h": h[pairs],
                    "n": np.diff(np.append(pairs, len(w))).astype(np.uint32), "d": doc[own].astype(np.uint16), "chunk": name, "train": flags,
                }
                yield {"bucket": [int(b)], "blob": [pack(blob)]}
            chunk += 1

    return work


DOC_COUNTS = ("tokens", "known", "seen", *[f"m{r}" for r in range(1, CLASSES + 1)], *[f"u{r}" for r in range(CLASSES + 1)])
CONTEXT_COUNTS = (*[f"n{r}" for r in range(1, CLASSES + 1)], *[f"k{r}" for r in range(1, CLASSES + 1)], "pairs_tail", "words_tail")
KINDS = "kind string, bucket long, blob binary, stats array<long>"


def _by_bucket(kind: str, buckets: int, by: np.ndarray, arrays: dict[str, np.ndarray]) -> Iterator[tuple]:
    where = _bucket(by, buckets)
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        own = order[edges[b] : edges[b + 1]]
        yield kind, int(b), pack({n: a[own] for n, a in arrays.items()}), None


def _by_chunk(kind: str, who: np.ndarray, arrays: dict[str, np.ndarray]) -> Iterator[tuple]:
    """Rows per chunk of documents; within one, documents are numbers."""
    order = np.argsort(who, kind="stable")
    chunks = who[order] >> 16
    first = _starts(chunks) if len(who) else []
    for low, high in zip(first, np.append(first[1:], len(who)).astype(np.int64) if len(who) else []):
        own = order[low:high]
        part = {"d": (who[own] & 0xFFFF).astype(np.uint16), **{n: a[own] for n, a in arrays.items()}}
        yield kind, int(chunks[low]), pack(part), None


def _trained(b: dict[str, np.ndarray]) -> np.ndarray:
    """Occurrences of each pair of a chunk in training documents."""
    learned = np.unpackbits(b["train"])[b["d"]]
    return np.add.reduceat(learned, np.cumsum(b["n"], dtype=np.int64) - b["n"], dtype=np.uint32)


def _merge_bucket(buckets: int, hot_words: np.ndarray, hot_counts: np.ndarray):
    """Counts of a bucket's pairs and words; sums per document and per context."""

    def work(table: pa.Table) -> pa.Table:
        blobs = [unpack(b) for b in table.column("blob").to_pylist()]
        rows = [("keys", int(b["chunk"][0]), pack({"keys": b["keys"]}), None) for b in blobs if "keys" in b]
        blobs = [b for b in blobs if "keys" not in b]
        if not blobs:
            return _table(rows)
        # Entries are pairs of a chunk; only they are held together, tokens are unfolded chunk by chunk.
        edges = np.cumsum([0, *[len(b["h"]) for b in blobs]])
        words = np.concatenate([np.repeat(b["w"], b["kinds"]) for b in blobs])
        contexts = np.concatenate([b["h"] for b in blobs])
        trained = np.concatenate([_trained(b) for b in blobs])
        for b in blobs:
            del b["w"], b["kinds"], b["h"]
        order = np.lexsort((contexts, words))
        w, h, trained = words[order], contexts[order], trained[order]
        del words, contexts
        first = _starts(w, h)
        pair_count = np.add.reduceat(trained, first).astype(np.int64)
        pair_of = np.empty(len(order), np.int32)
        pair_of[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(order))))
        w, h = w[first], h[first]
        del order, first, trained
        own = _starts(w)
        word_count = np.add.reduceat(pair_count, own)
        word = w[own]
        if len(hot_words):
            at = np.minimum(np.searchsorted(hot_words, word), len(hot_words) - 1)
            word_count = np.where(hot_words[at] == word, hot_counts[at], word_count)
        cw_pair = np.repeat(word_count, np.diff(np.append(own, len(w))))

        lost_contexts, lost_docs = [], []
        for low, high in zip(edges[:-1], edges[1:]):
            b = blobs.pop(0)
            chunk = int(b["chunk"][0])
            present, doc = np.unique(b["d"], return_inverse=True)
            pair = np.repeat(pair_of[low:high], b["n"])
            chw, cw, size = pair_count[pair], cw_pair[pair], len(present)
            seen = chw > 0
            log_cw = np.log10(np.maximum(cw, 1))
            total = lambda mask: np.bincount(doc[mask], minlength=size).astype(np.uint32)  # noqa: E731, B023
            doc_sums = {
                "d": present,
                "base": np.bincount(doc, np.log10(cw + 1.0), size),
                "log": np.bincount(doc, np.where(seen, np.log10(np.maximum(chw, 1)), log_cw) - np.where(w[pair] == END, 0, log_cw), size),
                "tokens": total(slice(None)), "known": total(cw > 0), "seen": total(seen),
                **{f"m{r}": total(chw == r) for r in range(1, CLASSES + 1)}, **{f"u{r}": total(~seen & (cw == r)) for r in range(CLASSES + 1)},
            }
            rows.append(("doc", chunk, pack(doc_sums), None))
            lost = np.flatnonzero(~seen)
            missed, holder = h[pair[lost]], b["d"][lost]
            often = np.isin(missed, hot_words)
            if often.any():
                rows.append(("hot", chunk, pack({"d": holder[often], "h": missed[often]}), None))
            lost_contexts.append(missed[~often])
            lost_docs.append((chunk << 16) + holder[~often].astype(np.int64))
        missed, holder = np.concatenate(lost_contexts), np.concatenate(lost_docs)
        del pair_of, lost_contexts, lost_docs
        rows += _by_bucket("unseen", buckets, missed, {"h": missed, "who": holder})

        has = pair_count > 0
        order = np.argsort(h[has], kind="stable")
        context, c2, c1 = h[has][order], pair_count[has][order], cw_pair[has][order]
        if len(context):
            first = _starts(context)
            add = lambda values: np.add.reduceat(values.astype(np.int64), first)
            sums = {
                "h": context[first], **{f"n{r}": add(c2 == r).astype(np.uint32) for r in range(1, CLASSES + 1)},
                **{f"k{r}": add(c1 == r).astype(np.uint32) for r in range(1, CLASSES + 1)},
                "pairs_tail": add(np.where(c2 > CLASSES, c2, 0)), "words_tail": add(np.where(c1 > CLASSES, c1, 0)),
            }
            rows += _by_bucket("context", buckets, sums["h"], sums)
        kept = word_count > 0
        rows += _by_bucket("word", buckets, word[kept], {"w": word[kept], "c": word_count[kept]})

        kinds = [int((pair_count == r).sum()) for r in range(1, CLASSES + 2)] + [int((word_count == r).sum()) for r in range(1, CLASSES + 2)]
        cold = kept if not len(hot_words) else kept & ~np.isin(word, hot_words)
        rows.append(("stats", -1, None, [*kinds, int(cold.sum()), int(word_count[cold].sum())]))
        return _table(rows)

    return work


def _table(rows: list[tuple]) -> pa.Table:
    schema = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))])
    return pa.table({n: [r[i] for r in rows] for i, n in enumerate(schema.names)}, schema=schema)


# Discounts ----------------------------------------------------------------------------------------------------------


def discounts(kinds: list[int]) -> np.ndarray:
    """Factor per count 1 to CLASSES from the numbers of events with each count 1 to CLASSES + 1.

    Good-Turing with Katz's cut at CLASSES; where the numbers of kinds do not
    allow it (few events), a fixed share of one event is taken from each count.
    """
    n = [0, *kinds]
    if all(n[1 : CLASSES + 2]):
        cut = (CLASSES + 1) * n[CLASSES + 1] / n[1]
        d = [((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if cut < 1 else 2 for r in range(1, CLASSES + 1)]
        if all(0 < x < 1 for x in d):
            return np.array(d)
    share = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    share = min(max(share, 0.1), 0.9)
    return np.array([(r - share) / r for r in range(1, CLASSES + 1)])


def backoff_weights(sums: dict[str, np.ndarray], count: np.ndarray, total: int, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """alpha of each context from its sums per discount class; 1 for a context that training lacks."""
    rank = np.arange(1, CLASSES + 1)
    pairs = sum(d2[r - 1] * r * sums[f"n{r}"] for r in rank) + sums["pairs_tail"]
    words = sum(d1[r - 1] * r * sums[f"k{r}"] for r in rank) + sums["words_tail"]
    with np.errstate(divide="ignore", invalid="ignore"):
        alpha = (1 - KEPT * pairs / count) / (1 - KEPT * words / max(total, 1))
    return np.where(count > 0, alpha, 1.0)


def _weights_of_bucket(begin_count: int, total: int, d1: np.ndarray, d2: np.ndarray, hot_words: np.ndarray):
    """Per document, the sum of log10(c(h) * alpha(h)) over its unseen pairs; also that value of very frequent contexts."""

    def work(table: pa.Table) -> pa.Table:
        by: dict[str, list] = {"context": [], "word": [], "unseen": []}
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist()):
            by[kind].append(unpack(blob))
        joined = lambda kind, name, t=np.uint64: np.concatenate([b[name] for b in by[kind]] or [np.zeros(0, t)])
        h = joined("context", "h")
        order = np.argsort(h, kind="stable")
        first = _starts(h[order]) if len(h) else np.zeros(0, np.int64)
        context = h[order][first]
        sums = {n: np.add.reduceat(joined("context", n, np.int64).astype(np.int64)[order], first) if len(h) else np.zeros(0) for n in CONTEXT_COUNTS}
        w, c = joined("word", "w"), joined("word", "c", np.int64)
        w, c = np.append(w, BEGIN), np.append(c, begin_count)
        order = np.argsort(w)
        w, c = w[order], c[order]
        at = np.minimum(np.searchsorted(w, context), len(w) - 1)
        count = np.where(w[at] == context, c[at], 0)
        value = np.log10(np.maximum(count, 1) * backoff_weights(sums, count, total, d1, d2))
        rows = []
        if by["unseen"] and len(context):
            missed, holder = joined("unseen", "h"), joined("unseen", "who", np.int64)
            at = np.minimum(np.searchsorted(context, missed), len(context) - 1)
            gain = np.where(context[at] == missed, value[at], 0.0)
            who, back = np.unique(holder, return_inverse=True)
            rows += _by_chunk("doc", who, {"log": np.bincount(back, gain)})
        often = np.isin(context, hot_words)
        if often.any():
            rows.append(("alpha", 0, pack({"h": context[often], "value": value[often]}), None))
        return _table(rows)

    return work


# Scores -------------------------------------------------------------------------------------------------------------


def katz_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """One row per input row: tokens, known tokens, add-one unigram score and Katz score, as log10 probabilities.

    `train` is a condition on the documents that the counts are learned from.
    A null text is empty and has the end token alone; rows that repeat are
    answered each; a null condition is false; without training documents every
    token is of the unknown class, with probability one; an empty table gives
    no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    source = source.withColumn("key", F.xxhash64("doc_id", "text"))
    feed = source.select("text", "key", "train")
    buckets, begin_count, hot = survey(feed, bucket_tokens)
    spread = sorted([*hot, int(BEGIN)])  # the begin is no word, but a context of every document
    hot_words = np.array(spread, np.uint64)
    hot_counts = np.array([hot.get(w, 0) for w in spread], np.int64)
    packed = map_rows(feed, _packed_pairs(buckets, hot_words), "bucket int, blob binary")
    store = materialise(packed.groupBy("bucket").applyInArrow(_merge_bucket(buckets, hot_words, hot_counts), KINDS), "ngrams")

    stats = [r.stats for r in store.where("kind = 'stats'").select(F.posexplode("stats").alias("i", "stats")).groupBy("i").agg(
        F.sum("stats").alias("stats")).orderBy("i").collect()] or [0] * (2 * CLASSES + 4)
    d2, d1 = discounts(stats[: CLASSES + 1]), discounts(stats[CLASSES + 1 : 2 * CLASSES + 2])
    kinds = stats[-2] + sum(c > 0 for c in hot.values())
    total = stats[-1] + sum(hot.values())
    by_context = store.where(F.col("kind").isin("context", "word", "unseen")).select("kind", "bucket", "blob")
    weights = materialise(
        by_context.groupBy("bucket").applyInArrow(_weights_of_bucket(begin_count, total, d1, d2, hot_words), KINDS), "backoff"
    )
    alphas = [unpack(r.blob) for r in weights.where("kind = 'alpha'").select("blob").collect()]  # one value per very frequent word
    often = {int(h): float(v) for a in alphas for h, v in zip(a["h"], a["value"])}
    mass = 1 - KEPT * (sum(d1[r - 1] * r * stats[CLASSES + r] for r in range(1, CLASSES + 1)) + (
        total - sum(r * stats[CLASSES + r] for r in range(1, CLASSES + 1)))) / max(total, 1) if total else 1.0
    log_d1, log_d2, kept = np.log10(d1 * KEPT), np.log10(d2), np.log10(KEPT)
    log_total, log_base = np.log10(max(total, 1)), np.log10(total + kinds + 1)
    log_begin = np.log10(max(begin_count, 1))

    def finish(table: pa.Table) -> pa.Table:
        """Sums of the documents of a chunk, with all constants in."""
        kinds_, packed_ = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        keys = unpack(packed_[kinds_.index("keys")])["keys"]
        sums = np.zeros((4, len(keys)))
        for kind, blob in zip(kinds_, packed_):
            if kind == "keys":
                continue
            a = unpack(blob)
            base = tokens_ = known = np.zeros(len(a["d"]))
            if kind == "hot":
                score = np.array([often.get(int(h), 0.0) for h in a["h"]])
            elif "tokens" not in a:
                score = a["log"]
            else:
                n = {c: a[c].astype(np.float64) for c in DOC_COUNTS}
                tokens_, known = n["tokens"], n["known"]
                backed = tokens_ - n["seen"] - n["u0"]  # unseen pairs whose word is known
                rare = sum(n[f"u{r}"] for r in range(1, CLASSES + 1))
                score = a["log"] + n["seen"] * kept + n["u0"] * np.log10(mass) + (backed - rare) * kept - backed * log_total
                for r in range(1, CLASSES + 1):
                    score = score + n[f"m{r}"] * log_d2[r - 1] + n[f"u{r}"] * log_d1[r - 1]
                base = a["base"] - tokens_ * log_base
            for row, values in zip(sums, (score, base, tokens_, known)):
                np.add.at(row, a["d"], values)
        return pa.table(dict(zip(("key", "score", "base", "tokens", "known"), [keys.view(np.int64), *sums])))

    kinds_of = ("kind", "bucket", "blob")
    parts = store.where(F.col("kind").isin("doc", "hot", "keys")).select(*kinds_of).union(weights.where("kind = 'doc'").select(*kinds_of))
    sums = parts.groupBy("bucket").applyInArrow(finish, "key long, score double, base double, tokens double, known double")
    # Rows that repeat a key have equal sums; one of them answers for all.
    rows = source.select("doc_id", "key", "train").join(sums.dropDuplicates(["key"]), "key")
    return rows.select(
        F.col("doc_id").alias(id_col), (~F.col("train")).alias("held_out"), F.col("tokens").cast("long").alias("n_tokens"),
        F.col("known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), (F.col("score") - F.lit(float(log_begin))).alias("score"),
    )
