"""Katz scores against a plain version that computes every probability, which must sum to one."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from vanflow.llm import katz
from vanflow.llm.base import crc_class

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), "<end>"]


class Plain:
    def __init__(self, texts):
        self.uni, self.pairs, self.after = Counter(), Counter(), defaultdict(set)
        self.history = Counter()
        for text in texts:
            before = "<begin>"
            for w in toks(text):
                self.uni[w] += 1
                self.pairs[before, w] += 1
                self.after[before].add(w)
                self.history[before] += 1
                before = w
        self.n = sum(self.uni.values())
        kinds = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.CLASSES + 2)]
        self.d1, self.d2 = katz.discounts(kinds(self.uni)), katz.discounts(kinds(self.pairs))
        self.unknown, self.alphas = 1.0, {}
        self.unknown -= sum(self.word(w) for w in self.uni)

    @staticmethod
    def cut(c, d):
        return katz.KEPT * c * (d[c - 1] if c <= katz.CLASSES else 1)

    def word(self, w):
        return self.cut(self.uni[w], self.d1) / self.n if self.uni[w] else self.unknown

    def pair(self, h, w):
        if not self.history[h]:
            return self.word(w)
        if self.pairs[h, w]:
            return self.cut(self.pairs[h, w], self.d2) / self.history[h]
        if h in self.alphas:
            return self.alphas[h] * self.word(w)
        left = 1 - sum(self.cut(self.pairs[h, x], self.d2) for x in self.after[h]) / self.history[h]
        self.alphas[h] = left / (1 - sum(self.word(x) for x in self.after[h]))
        return self.alphas[h] * self.word(w)

    def score(self, text):
        words = toks(text)
        return sum(math.log10(self.pair(h, w)) for h, w in zip(["<begin>", *words], words))


@pytest.mark.parametrize("bucket_tokens, hot", [(1 << 22, 1000), (3000, 50)])
def test_scores_equal_plain_katz(spark, monkeypatch, bucket_tokens, hot):
    monkeypatch.setattr(katz, "HOT_COUNT", hot)
    monkeypatch.setattr(katz, "CHUNK_TOKENS", 9000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    rows += [(9001, None), (9002, ""), (9003, "unheard of words THE of and"), (9003, "unheard of words THE of and"), (None, "the\tthe the")]
    rows += [(9100 + i, "the " * 40 + "newword") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("train", katz.F.lit("clash"))
    learn = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    plain = Plain([t for i, t in rows if learn(i)])
    for h in ("<begin>", "the", "of", "never"):
        total = sum(plain.pair(h, w) for w in plain.uni) + plain.pair(h, "never")
        assert total == pytest.approx(1, abs=1e-9)
    got = katz.katz_scores(df, crc_class("doc_id", 7) != 2, bucket_tokens=bucket_tokens).collect()
    assert len(got) == len(rows) and sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    texts = dict(rows)
    for r in got:
        words = toks(texts[r.doc_id])
        base = sum(math.log10((plain.uni[w] + 1) / (plain.n + len(plain.uni) + 1)) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learn(r.doc_id), len(words), sum(plain.uni[w] > 0 for w in words), plain.n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(plain.score(texts[r.doc_id]), rel=1e-7)


def test_katz_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = katz.katz_scores(df, katz.F.lit(False)).collect()
    assert [(r.score, r.base_score, r.train_tokens) for r in none] == [(0.0, 0.0, 0)] * 2
    one = katz.katz_scores(df, katz.F.col("doc_id") == 2).collect()
    assert all(math.isfinite(r.score) for r in one)
    assert katz.katz_scores(df.limit(0), katz.F.lit(True)).count() == 0


def test_discounts_stay_between_zero_and_one():
    for kinds in ([0] * 6, [5, 0, 0, 0, 0, 0], [100, 60, 30, 20, 10, 9], [1, 2, 3, 4, 5, 6], [0, 3, 0, 0, 0, 0]):
        assert ((katz.discounts(kinds) > 0) & (katz.discounts(kinds) < 1)).all()
