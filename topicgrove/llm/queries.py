"""The queries of this package for the entry module: thin wrappers that derive digests from the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicgrove.llm import decontamination, license_scan, line_dedup, pii, piece_viterbi, quality_rules, sharding, simhash, token_binary, token_counts
from topicgrove.llm.storage import documents

SHARDS, END_ID = 24, 2


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.license_scan(documents(spark, sf_dir).select("doc_id", "text"))
    starts = F.transform("scan.base", lambda b: b["start"].cast("long"))
    base, more = F.col("scan.base.label"), F.col("scan.detections.label")
    return scanned.select(
        "doc_id",
        F.col("scan.n_words").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        license_scan.labels_joined(base).alias("base_labels"),
        license_scan.labels_joined(F.concat(base, more)).alias("labels"),
        F.col("scan.score").alias("score"),
    )


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [pii.count_of(kind).alias(f"n_{kind}") for kind in pii.BASE]
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *counts, F.sha2(pii.joined_spans(base), 256).alias("base_sha256"), pii.joined_spans(F.col("pii")).alias("spans"))


def byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.balanced_shards(documents(spark, sf_dir), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def token_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_counts.context_table(token_counts.length_histogram(lengths))


def token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_file_index(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def quality_rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_profile(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return piece_viterbi.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False).drop("text")


def fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_report(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.array_join(F.transform("dropped", lambda n: n.cast("string")), ",").alias("dropped"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_benchmark_decontamination": benchmark_decontamination,
        "op2_license_scans": license_scans,
        "op3_simhash_near_dedup": simhash_near_dedup,
        "op4_pii_spans": pii_spans,
        "op5_byte_shards": byte_shards,
        "op6_token_counts": token_count_histogram,
        "op7_token_id_files": token_id_files,
        "op8_quality_rules": quality_rule_verdicts,
        "op9_piece_viterbi": piece_encoding,
        "op10_line_dedup": fuzzy_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {}
