"""Queries of the training-data operators over whole tables, and their DuckDB restatements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from labelscope.llm import alignment, binary_records, decontamination, filter_audit, html_text, oracle, packing, quality, secrets, simhash, substrings, surrogates, token_counts, warc
from labelscope.llm.common import packed_table, table

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"
BYTES = "byte_bpe_50k.json"
END_ID = 1
SEQUENCE = 2048
TOKEN_LIMIT = 4096
SHINGLE = 3
#: For the query alone; callers bring a secret of their own.
SURROGATE_KEY = b"query"


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.prefix_tables(docs, public_tokenizers.path(PIECES))
    # the prefix tables are stored; every figure is read from them
    stored = packed_table(counted.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "prefix_words", "prefix_steps"))
    read = token_counts.tokens_upto(token_counts.longest_prefix(stored, TOKEN_LIMIT, f"fit_{TOKEN_LIMIT}"), "n_chars", "n_tokens")
    return read.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), f"fit_{TOKEN_LIMIT}")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), SHINGLE)
    return found.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


def op4_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op5_binary_records(spark: SparkSession, folder: str) -> DataFrame:
    index = binary_records.write_records(
        table(spark, folder, "documents"), binary_records.new_folder(spark), public_tokenizers.path(WORDS), END_ID)
    return binary_records.read_digests(index)


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.digests(table(spark, folder, "documents"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, folder, "labels"))
    return quality.judged(docs, rules).select("doc_id", *quality.STATISTICS, "base_failed", "rule", "kept")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), SEQUENCE, public_tokenizers.path(WORDS), END_ID)


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op10_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replaced(docs, SURROGATE_KEY).select("doc_id", "n_entities", "text")


def op11_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(table(spark, folder, "pages").select("page_id", "url", "html"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    found = alignment.scored(table(spark, folder, "documents"), public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.document_audit(table(spark, folder, "documents"), table(spark, folder, "labels"), F.col("lang"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_token_counts, op2_decontamination, op3_simhash, op4_secret_scans, op5_binary_records, op6_substring_dedup, op7_quality_rules, op8_packing, op9_warc, op10_surrogates,
        op11_html_text, op12_alignment, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": oracle.DECONTAMINATION, "op13_filter_audit": oracle.FILTER_AUDIT}
