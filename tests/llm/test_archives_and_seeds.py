"""WARC round trips and benchmark decontamination."""

import hashlib
import random
from collections import defaultdict

from vanflow.llm import spaced_seeds, warc

SF = "/root/testdata/sf0.001"


def test_archives_round_trip_and_repeat_bit_for_bit(spark, tmp_path):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    body = "<p>é</p>" * 40
    pages += [(9001, "http://a/\r\nX: y", None), (9002, None, ""), (9003, "u", "short"), (9004, "u", "short"), (9007, "u", body), (9005, "u", body)]
    pages += [(9006, "u", body), (9005, "u", body), (None, None, body), (9010, "u", body * 2000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    first, second = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    warc.write_archives(df.withColumn("digest", df.url), first, shard_bytes=60_000, roll_bytes=8_000)
    got = warc.read_archives(spark, first).collect()
    groups = defaultdict(list)
    for page, _, html in pages:
        groups[(html or "").encode()].append(page)
    assert sorted((str(r.page_id), r.payload_digest) for r in got) == sorted(
        (str(p), hashlib.sha256((h or "").encode()).hexdigest()) for p, _, h in pages
    )
    by_digest = {hashlib.sha256(b).hexdigest(): (b, ids) for b, ids in groups.items()}
    responses = defaultdict(int)
    for r in got:
        payload, ids = by_digest[r.payload_digest]
        least = min(i for i in ids if i is not None)
        assert r.payload_bytes == len(payload)
        if r.record_type == "response":
            assert r.payload == payload and r.refers_to is None
            responses[r.payload_digest] += 1
            assert len(payload) < 100 or r.page_id == least
        else:
            assert len(payload) >= 100 and r.refers_to == least
    assert all(n == 1 for d, n in responses.items() if len(by_digest[d][0]) >= 100)
    warc.write_archives(df.repartition(2), second, shard_bytes=60_000, roll_bytes=8_000)
    listed = [sorted((p.name, p.read_bytes()) for p in (tmp_path / d).glob("*.warc.gz")) for d in ("one", "two")]
    assert listed[0] == listed[1] and len(listed[0]) > 3
    assert warc.archive_round_trip(df.limit(0), f"file://{tmp_path}/none").count() == 0


def test_spaced_seeds_find_substituted_passages_only(spark):
    rng = random.Random(5)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bench += [(None, None), (800, "too short"), (801, "")]
    filler = [f"zz{rng.randint(0, 5000)}" for _ in range(4000)]
    rows, want = [], set()
    for d, (item, text) in enumerate(bench):
        words = (text or "").split()
        if len(words) < 15:
            continue
        changed = [w if rng.random() > 0.2 else "other" for w in words]
        cut = len(changed) // 2
        rows.append((d, " ".join(filler[:50] + changed + filler[50:90]).upper()))
        rows.append((1000 + d, " ".join(words[:cut] + ["added"] + words[cut:])))
        rows.append((2000 + d, " ".join(rng.sample(filler, 60) + words[:5])))
        want |= {(d, item), (1000 + d, item)}
    rows += [(5000, None), (5001, ""), (None, bench[0][1]), (1000, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", spaced_seeds.F.lit(1))
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in spaced_seeds.contaminated_pairs(docs, items).collect()}
    assert want <= got and not [g for g in got if g[0] is not None and g[0] >= 2000] and (None, bench[0][0]) in got
    clean = spaced_seeds.decontaminate(docs, items)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {g[0] for g in got}
    assert spaced_seeds.contaminated_pairs(docs.limit(0), items).count() == 0
    assert spaced_seeds.contaminated_pairs(docs, items.limit(0)).count() == 0
    plan = spaced_seeds.contaminated_pairs(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_seeds_pass_a_filter_and_words_do_not_travel(spark, monkeypatch):
    """Few seeds and many give the same pairs, and no broadcast or join of seeds carries the words of an item or document."""
    rng = random.Random(9)
    bench = [(n, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(5, 40)))) for n in range(120)]
    bench += [(500, bench[3][1]), (None, bench[4][1]), (3, bench[3][1]), (7, bench[8][1])]
    rows = [(n, " ".join(["a b c", bench[n][1], "d e", bench[(n * 7) % 120][1]])) for n in range(60)]
    rows += [(None, bench[5][1]), (1, bench[9][1]), (1, rows[1][1]), (900, None), (901, "nothing of it at all but some words")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    seen, hits = [], spaced_seeds._hits
    monkeypatch.setattr(spaced_seeds, "_hits", lambda texts, seeds: seen.append(hits(texts, seeds)) or seen[-1])
    want = sorted(map(repr, spaced_seeds.contaminated_pairs(docs, items).collect()))
    monkeypatch.setattr(spaced_seeds, "MAX_SEED_ROWS", 10)
    monkeypatch.setattr(spaced_seeds, "MAX_HELD_ROWS", 2)
    assert sorted(map(repr, spaced_seeds.contaminated_pairs(docs, items).collect())) == want and len(want) > 100
    for found in seen:
        assert {t for _, t in found.dtypes} == {"bigint", "int"}
    passed = spaced_seeds.passing(spark.range(100_000).selectExpr("xxhash64(id) AS seed"), spark.range(20_000).selectExpr("xxhash64(id) AS seed"), 20_000)
    assert 20_000 <= passed.count() < 20_800
