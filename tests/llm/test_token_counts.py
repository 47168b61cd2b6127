"""Token counts against one call of the library per whole text."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vanflow.llm import token_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def edge_texts():
    word = "Straße café café ΣΣ don't it's 'S 12 ½ <|endoftext|> a<|startoftext|>b ́x 中文"
    return [None, "", " ", "\n\t", word, word * 3000, "x" * 60_000, "a ́b " * 9000, "a b c" * 9000, ("word " * 5000 + "́") * 4,
            "7 " * 40_000, "<|endoftext|> " * 5000, "a 's b 't " * 6000, "End. end, END., I. İ. x's. 's, '. ,. 4. é, ,", "A\u0301 \u0301. b\u00a0c\u3000d\x0be\x0cf\x85g"]


@pytest.mark.parametrize("batch", [7, 500, 1 << 20])
@pytest.mark.parametrize("known", [3, 100_000])
def test_parts_add_up(tokenizer, batch, known):
    texts = [t or "" for t in edge_texts()]
    want = [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    assert token_counts.Counter(tokenizer, batch, known).count(iter(texts)) == want


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(90_000 + i, t) for i, t in enumerate(edge_texts())] + [(None, "no name"), (90_004, "again")], "doc_id long, text string")
    rows = docs.union(extra).selectExpr("*", "1 AS n_bytes", "true AS over_limit", "0 AS n_tokens")
    texts = sorted(((r.doc_id, r.text or "") for r in rows.collect()), key=repr)
    want = [(k, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False)), n > 2048) for k, t in texts]
    got = token_counts.token_counts(rows)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(rows.limit(0)).count() == 0
