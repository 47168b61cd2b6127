"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import pytest

from vanflow.llm import spelling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def answers(counts):
    out, form = {}, {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        form[w] = near[0][1] if near and -near[0][0] >= 10 * n else None
        out[w] = [n, len(near), -near[0][0] if form[w] else None]
    rows = []
    for w, (n, n_near, form_n) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, n_near, form_n))
    return sorted(rows)


def text_rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("abÀé") for _ in range(rng.randrange(7, 11))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = rng.choices(base, weights=[1 + 40 * (k % 7 == 0) for k in range(60)], k=40)
        for j in range(len(words)):
            if rng.random() < 0.15:
                w, at = words[j], rng.randrange(len(words[j]))
                words[j] = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abéz") + w[at:], w[:at] + "z" + w[at + 1 :], w.upper()])
        rows.append((i, rng.choice([" ", ", ", "7"]).join(words)))
    long = "q" * 40
    rows += [(900, None), (901, ""), (None, "nullidentifier nullidentifier nullidentified"), (902, f"{long} {long} {long}q {long}q {long[:-1]}x {long[:-1]}x")]
    rows += [(903, " ".join(["a" * k + " " + "a" * k for k in range(7, 45)])), (903, "aaaaaaa"), (904, "sevenup sevenup"), (905, "Sevenup " * 30), (906, "chained " * 2 + "chaineds " * 30 + "chaineders " * 3), (907, "chainedst " * 400)]
    return rows


def test_variants_equal_all_pairs(spark):
    rows = text_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "'x' AS node").repartition(5)
    got = sorted(tuple(r) for r in spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = answers(plain(rows))
    assert len(want) > 300 and any(r[1] and r[2] != r[1] for r in want)
    assert got == want


@pytest.mark.parametrize("long", [9, 12])
def test_long_words_meet_the_trie(spark, long):
    words = sorted({w for w in plain(text_rows())})
    table = spark.createDataFrame([(w,) for w in words], "word string")
    got = [tuple(sorted(r)) for r in spelling.near_pairs(table, long).collect()]
    want = [(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)]
    assert sorted(got) == sorted(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(none).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "alone here")], "doc_id long, text string")).count() == 0
