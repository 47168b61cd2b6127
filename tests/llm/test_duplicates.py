"""Duplicate operators against brute force on small tables, and their edge cases."""

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from vanflow.llm import covering, graph, trie_dedup

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=8)))
def test_patricia_holds_every_string(keys):
    trie = trie_dedup.Patricia()
    for key in keys:
        node = trie.terminal(key)
        node.value = (node.value or 0) + 1
    want = defaultdict(int)
    for key in keys:
        want[key] += 1
    assert dict(trie.terminals(trie.root)) == dict(want)
    total = trie.bytes
    assert total == trie._weight(trie.root)
    spilled = dict(trie.spill())
    assert spilled.items() <= want.items()


@pytest.mark.parametrize("trie_bytes", [1 << 20, 200])
def test_exact_owners_equal_brute_force(spark, trie_bytes):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(5000, None), (5001, ""), (5002, "ABC\xc9"), (5003, "abc\xc9"), (5004, "abc\xe9"), (5003, "abc\xc9"), (None, "abc\xc9"), (None, None)]
    rows += [(6000 + i, rows[i % 3][1]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("kept", trie_dedup.F.lit(1))
    got = trie_dedup.exact_owners(df, trie_bytes=trie_bytes).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(-1 if i is None else i)
    want = {hashlib.sha256(t.encode()).hexdigest(): (max(ids), len(ids)) for t, ids in groups.items()}
    assert len(got) == len(rows) and {r.text_sha256 for r in got} == set(want)
    kept = defaultdict(int)
    for r in got:
        keep, size = want[r.text_sha256]
        assert (r.keep_id, r.group_size) == (keep, size)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == keep
    assert set(kept.values()) == {1}
    assert trie_dedup.exact_owners(df.limit(0)).count() == 0


def plain_simhash(text, shingle=3):
    words = (text or "").translate(FOLD).encode().split()
    runs = [words[i : i + shingle] for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, radius):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if (a ^ b).bit_count() <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_masks_cover_every_pair_in_the_radius():
    rng = random.Random(3)
    for radius in (1, 2, 3):
        tables = covering.masks(radius)
        assert len(tables) == 2 ** (radius + 1) - 1
        for _ in range(500):
            change = sum(1 << i for i in rng.sample(range(64), radius))
            assert any(not change & m for m in tables)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_links_connect_exactly_the_pairs_in_the_radius(spark, radius):
    rng = random.Random(radius)
    words = {rng.getrandbits(64) for _ in range(40)}
    for w in list(words):
        for _ in range(6):
            w ^= sum(1 << i for i in rng.sample(range(64), rng.randint(1, radius + 1)))
            words.add(w)
    df = spark.createDataFrame([(covering._signed(w),) for w in words], "word long")
    found = {r.node: r.root for r in graph.components(covering.links(df, radius)).collect()}
    want = plain_components(words, radius)
    classes = defaultdict(set)
    for w in words:
        classes[found.get(covering._signed(w), covering._signed(w))].add(w)
    expected = defaultdict(set)
    for w, r in want.items():
        expected[r].add(w)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))


def test_near_duplicates_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = " ".join(f"w{i}" for i in range(3000))
    rows += [(7000, None), (7001, ""), (7002, "one two"), (7003, "ONE  two"), (7004, long), (7005, long + " end"), (7005, long), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = covering.near_duplicates(df.withColumn("word", df.text)).collect()
    prints = {(i, t): plain_simhash(t) for i, t in rows}
    want = plain_components(set(prints.values()), 2)
    least = defaultdict(list)
    for (i, _), p in prints.items():
        if i is not None:
            least[want[p]].append(i)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == sorted(
        (str(i), f"{prints[i, t]:016x}", min(least[want[prints[i, t]]])) for i, t in rows
    )
    assert covering.near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_hubs_and_empty_edges(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 2000 + i) for i in range(500)] + [(5, 5), (None, 3), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[2000 + i] for i in range(500)} == {1000} and len(got) == 41 + 501
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_repeats(rows, window):
    import re

    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, (_, t) in enumerate(rows)}
    first = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            for i in range(len(words[k]) - window + 1):
                w = tuple(words[k][i : i + window])
                first[w] = min(first.get(w, doc), doc)
    out = []
    for k, (doc, _) in enumerate(rows):
        gone = set()
        for i in range(len(words[k]) - window + 1) if doc is not None else ():
            if first[tuple(words[k][i : i + window])] < doc:
                gone |= set(range(i, i + window))
        kept = [w for i, w in enumerate(words[k]) if i not in gone]
        out.append((str(doc), len(words[k]), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window, anchor", [(50, 10), (6, 3), (5, 5), (12, 4)])
def test_repeats_equal_brute_force(spark, window, anchor):
    from vanflow.llm import substrings

    rng = random.Random(window)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] if window == 50 else []
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(window + rng.randint(-2, 60))) for _ in range(8)]
    for d in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(f"x{rng.randint(0, 900)}" for _ in range(rng.randint(0, 40)))
                 for _ in range(rng.randint(0, 4))]
        rows.append((10_000 + d // 2 if d % 9 == 0 else 20_000 - d, "\n".join(parts)))
    rows += [(1, None), (2, ""), (None, passages[0]), (30_000, "a " * 300), (30_001, "a " * 200), (30_001, "a " * 200), (30_002, passages[0][2:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("key", trie_dedup.F.lit(1))
    got = substrings.repeats(df, window=window, anchor=anchor).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain_repeats(rows, window)
    assert substrings.repeats(df.limit(0)).count() == 0
