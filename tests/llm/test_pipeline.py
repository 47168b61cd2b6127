"""The pipeline against stage-by-stage expectations on a small table."""

import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from vanflow.llm import ppm, spaced_seeds
from vanflow.llm.base import crc_class

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = text.translate(FOLD).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_every_stage_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = [tuple(r) for r in docs.collect()]
    extra = [(8001, None, "en", "s", 0), (8002, "12 34 ,.", None, None, None), (8003, base[0][1], None, None, None),
             (8003, base[0][1], None, "again", None), (None, base[1][1], None, None, None), (8004, base[2][1] + " of", "en", None, 1)]
    rows = base + extra
    made = spark.createDataFrame(rows, docs.schema)
    made.coalesce(2).write.parquet(f"file://{tmp_path}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(f"file://{tmp_path}/benchmark.parquet")

    model = ppm.train(made.where(crc_class("doc_id", 4) != 2))
    kept = [r for r in rows if (a := ppm.answers(model, [r[1]])[0])[0] != "und" and a[2] < 8]
    assert not [r for r in kept if r[0] in (8001, 8002)] and len(kept) >= len(rows) - 8
    groups = defaultdict(list)
    for r in kept:
        groups[r[1].translate(FOLD)].append(r)
    kept = [max(g, key=lambda r: -1 if r[0] is None else r[0]) for g in groups.values()]
    sets = [shingles(r[1]) for r in kept]
    parent = list(range(len(kept)))

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and len(a & b) >= 0.8 * len(a | b)):
                parent[root(i)] = root(j)
    near = defaultdict(list)
    for n, r in enumerate(kept):
        near[root(n)].append(r)
    kept = [min(g, key=lambda r: -1 if r[0] is None else r[0]) for g in near.values()]
    table = spark.createDataFrame(kept, docs.schema)
    held = {r.doc_id for r in spaced_seeds.contaminated_pairs(table, bench).collect()}
    kept = [r for r in kept if r[0] not in held]

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r[0]: [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1] for r in kept}
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    pieces = defaultdict(list)
    for p in got:
        pieces[p.doc_id].append(p)
    assert pieces.keys() == want.keys()
    for key, parts in pieces.items():
        assert sum(p.length for p in parts) == len(want[key]) == parts[0].doc_tokens
        for p in parts:
            ids = want[key][p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_clashing_columns_come_back_unchanged(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(60).selectExpr(
        "*", "doc_id AS _id", "'n' AS _none", "'s' AS _sha", "7 AS _row_key", "1 AS _held", "2 AS node", "'r' AS row"
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        rows = kept.collect()
        assert 0 < len(rows) <= 60 and all(r._id == r.doc_id and (r._none, r._sha, r._row_key, r._held, r.node, r.row) == ("n", "s", 7, 1, 2, "r") for r in rows), name
