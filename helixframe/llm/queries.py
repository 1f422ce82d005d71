"""The registered queries of this subpackage, on the tables documents, pages, benchmark and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import table
from helixframe.llm.decontamination import CONTAMINATION_SQL, contamination
from helixframe.llm.label_sharding import shard_documents
from helixframe.llm.language_id import held_out, identify_languages, train
from helixframe.llm.lexical_search import SEARCH_SQL, search
from helixframe.llm.line_dedup import dedup_lines
from helixframe.llm.merkle_manifest import lowered_fifth, manifest, manifest_sql
from helixframe.llm.record_files import read_records, write_records
from helixframe.llm.robust_outliers import quality_rules
from helixframe.llm.secret_scan import scan_secrets
from helixframe.llm.simhash_dedup import near_duplicates
from helixframe.llm.source_mixing import mixing_rates
from helixframe.llm.token_counts import token_counts
from helixframe.llm.warc import read_archives, write_archives


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file; its package is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = write_records(table(spark, sf_dir, "documents"), tokenizer_file())
    return read_records(spark, folder, index).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_deleted", "n_words_deleted", F.length("text").cast("long").alias("kept_chars"), F.crc32("text").alias("kept_crc32"))


def op6_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, train(docs.where(~held_out())))


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(spark, folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_benchmark_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_presence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), tampered=lowered_fifth)


def op13_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT h, min(page_id) AS first_id FROM p GROUP BY h
), bits AS (
  SELECT h, first_id, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
         CAST(4 * (instr('0123456789abcdef', substr(h, CAST(i AS INTEGER), 1)) - 1) + 1 AS INTEGER), 4)), '') AS b FROM f
), coded AS (
  SELECT h, first_id, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
         + 16 * CAST(substr(b, CAST(5 * i + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(b, CAST(5 * i + 2 AS INTEGER), 1) AS INTEGER)
         + 4 * CAST(substr(b, CAST(5 * i + 3 AS INTEGER), 1) AS INTEGER) + 2 * CAST(substr(b, CAST(5 * i + 4 AS INTEGER), 1) AS INTEGER)
         + CAST(substr(b, CAST(5 * i + 5 AS INTEGER), 1) AS INTEGER) AS INTEGER), 1)), '') AS d FROM bits
)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, c.d AS payload_digest,
       CASE WHEN p.page_id IS NOT DISTINCT FROM c.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id IS NOT DISTINCT FROM c.first_id THEN NULL ELSE c.first_id END AS refers_to
FROM p JOIN coded c ON p.h = c.h
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_token_records": op2_token_records,
        "op3_robust_outliers": op3_robust_outliers,
        "op4_soft_mixing": op4_soft_mixing,
        "op5_line_winnowing": op5_line_winnowing,
        "op6_language_filters": op6_language_filters,
        "op7_simhash_pigeonring": op7_simhash_pigeonring,
        "op8_label_propagation": op8_label_propagation,
        "op9_warc_index": op9_warc_index,
        "op10_benchmark_ngrams": op10_benchmark_ngrams,
        "op11_presence_masks": op11_presence_masks,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_prefix_counts": op13_prefix_counts,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express."""
    return {"op9_warc_index": WARC_SQL, "op10_benchmark_ngrams": CONTAMINATION_SQL, "op11_presence_masks": SEARCH_SQL, "op12_merkle_manifest": manifest_sql()}
