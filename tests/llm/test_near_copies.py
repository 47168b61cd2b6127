"""Near copies by exact shingle similarity against all pairs, and the pipeline's stage on planted copies."""

import random

import pytest

from vanflow.llm import near_copies

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text, shingle=5):
    words = (text or "").translate(FOLD).split()
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def planted():
    """Ten texts of 120 words with copies in which one to four words are replaced, and edge cases."""
    rng, rows = random.Random(7), []
    for base in range(10):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows.append((base * 100, " ".join(words)))
        for copy in range(1, 12):
            other = list(words)
            for at in rng.sample(range(120), 1 + copy % 4):
                other[at] = f"x{rng.randrange(5000)}"
            rows.append((base * 100 + copy, " ".join(other)))
    return rows + [(5000, None), (5001, " . "), (5002, ""), (5003, "one two"), (5004, "One  two"), (None, rows[0][1]), (5003, "two one")]


@pytest.mark.parametrize("block_docs", [512, 4])
def test_components_equal_all_pairs(spark, monkeypatch, block_docs):
    monkeypatch.setattr(near_copies, "BLOCK_DOCS", block_docs)
    rows = planted()
    sets = [plain(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                parent[root(i)] = root(j)
    least = {}
    for n, (key, _) in enumerate(rows):
        if key is not None:
            least[root(n)] = min(key, least.get(root(n), key))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(near_copies.near_copies(df).collect(), key=repr)
    assert got == sorted([(key, least.get(root(n))) for n, (key, _) in enumerate(rows)], key=repr)
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_pipeline_removes_planted_near_copies(spark):
    import corpus_pipeline

    rows = [r for r in planted() if r[0] is not None and r[0] < 5000]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    for key, text in rows:
        same = [k for k, t in rows if k < key and len(plain(t) & plain(text)) >= 0.8 * len(plain(t) | plain(text))]
        assert not (same and key in kept), key
    assert {base * 100 for base in range(10)} <= kept


def test_groups_given_besides_the_bands_are_compared(spark):
    """A pair that shares no band is found where another operator names it, and only if it is similar."""
    from vanflow.llm import near_copies

    a = " ".join(f"w{i}" for i in range(60))
    b = " ".join(f"w{i}" if i < 33 else f"x{i}" for i in range(60))
    c = " ".join(f"y{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a), (2, b), (3, c)], "doc_id long, text string")
    also = spark.createDataFrame([(1, 7), (2, 7), (3, 7)], "doc_id long, group long")
    found = lambda **more: {
        r.doc_id: r.component_id for r in near_copies.near_copies(docs, similarity=0.3, **more).collect()}
    assert found() == {1: 1, 2: 2, 3: 3}
    assert found(also=also) == {1: 1, 2: 1, 3: 3}


def test_the_stage_calls_the_covering_operator(spark, monkeypatch):
    import corpus_pipeline
    from vanflow.llm import covering

    calls, plain = [], covering.near_duplicates
    monkeypatch.setattr(covering, "near_duplicates", lambda *a, **k: calls.append(1) or plain(*a, **k))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a  b c d e f"), (3, "g")], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}
    assert calls


def test_bands_miss_no_pair_sooner_than_hashes_collide(spark):
    """At the threshold no pair is left out by chance, and even pairs far below it are all named as candidates."""
    assert (1 - near_copies.SIMILARITY ** near_copies.ROWS) ** near_copies.BANDS < 2.0**-64
    rng, rows = random.Random(11), []
    for n in range(80):
        words = [f"w{rng.randrange(100_000)}" for _ in range(100)]
        other = [w if i % 20 else f"x{n}" for i, w in enumerate(words)]
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, similarity=0.6).collect()}
    assert found == {key: key - key % 2 for key, _ in rows}


def test_wordless_texts_in_a_given_group_equal_no_text(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "b c"), (4, " ")], "doc_id long, text string")
    also = spark.createDataFrame([(n, 7) for n in range(1, 5)], "doc_id long, group long")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs, also=also).collect()} == {1: 1, 2: 2, 3: 3, 4: 2}
