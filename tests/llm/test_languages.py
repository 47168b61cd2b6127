"""Training of the language models: every label, and bounded samples without identifiers."""

from vanflow.llm import ppm


def test_more_than_256_labels_are_all_learned(spark):
    rows = [(i, f"word{i} text", f"l{i % 300:03d}") for i in range(300)]
    assert len(ppm.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages) == 300


def test_rows_without_identifier_are_sampled(spark):
    rows = [(None, f"{i:010d}", "en") for i in range(3000)]
    model = ppm.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=100)
    assert 30 * 10 <= int(model.trees[0][1].sum()) <= 300 * 10


def test_numeric_signs_are_no_letters(spark):
    rows = [(i, t, "en") for i, t in enumerate(["plain words here", "more words there", "yet other words"])]
    model = ppm.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["\u00bd \u00b2 \u2167", "12 _", "", None, "\u4e2d", "a", "x" * 3_000_000 + " " + "words here " * 20_000]
    odd = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string").selectExpr("*", "'fr' AS lang", "1 AS score")
    got = [r.lang_pred for r in ppm.identify(odd.coalesce(1), model).collect()]
    assert got == ["und"] * 4 + ["en"] * 3
