"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vanflow.llm import (
    covering, katz, packing, pii, ppm, repair, secrets, spaced_seeds, spelling, substrings, token_counts, trie_dedup, warc,
)
from vanflow.llm.base import crc_class, read


def op1_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op2_secret_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_versions(read(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")


def op3_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op4_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and benchmark item."""
    return spaced_seeds.contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_patricia_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.exact_owners(read(spark, sf_dir, "documents")).drop("row")


def op6_warc_sharded_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages"))


def op7_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering.near_duplicates(read(spark, sf_dir, "documents"))


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = ppm.train(docs.where(crc_class("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return ppm.identify(docs, model).select(
        "doc_id", (crc_class("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte"
    )


def op9_seed_extend_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(read(spark, sf_dir, "documents"))


def op10_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(read(spark, sf_dir, "documents"), crc_class("doc_id", 7) != 2)


def op11_trie_frontier_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op12_batched_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(read(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_anchor_expansion, op2_secret_blob_ledger, op3_vector_bin_packing, op4_spaced_seed_decontamination,
        op5_patricia_exact_dedup, op6_warc_sharded_writer, op7_covering_simhash, op8_ppm_language, op9_seed_extend_substrings,
        op10_katz_backoff, op11_trie_frontier_spelling, op12_batched_token_counts, op13_conversation_repair,
    )
}
ORACLES: dict[str, str] = {
    "op5_patricia_exact_dedup": """WITH d AS (SELECT doc_id, translate(COALESCE(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, MAX(doc_id) OVER w AS keep_id, COUNT(*) OVER w AS group_size,
          doc_id = MAX(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op6_warc_sharded_writer": """WITH p AS (SELECT page_id, COALESCE(html, '') AS t, strlen(COALESCE(html, '')) AS n FROM pages),
        f AS (SELECT *, MIN(page_id) OVER (PARTITION BY t) AS least FROM p)
        SELECT page_id, n AS payload_bytes, sha256(t) AS payload_digest,
          CASE WHEN n >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN n >= 100 AND page_id <> least THEN least END AS refers_to FROM f""",
    "op9_seed_extend_substrings": r"""WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        starts AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d),
        windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
        again AS (SELECT doc_id, i FROM windows QUALIFY MIN(doc_id) OVER (PARTITION BY h) < doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM again),
        lost AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
        runs AS (SELECT doc_id, MIN(i) - 1 AS a, MAX(i) AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM gone)
          GROUP BY doc_id, r),
        spans AS (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS removed_spans FROM runs GROUP BY doc_id),
        kept AS (SELECT doc_id, w, g, CASE WHEN g IS NULL THEN w
          ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END AS k
          FROM d LEFT JOIN lost USING (doc_id))
        SELECT doc_id, len(w) AS n_words, len(w) - len(k) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256,
          COALESCE(removed_spans, '') AS removed_spans FROM kept LEFT JOIN spans USING (doc_id)""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
