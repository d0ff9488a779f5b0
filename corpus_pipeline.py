"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, pieces."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicgrove.llm import decontamination, line_dedup, piece_viterbi, quality_rules, simhash
from topicgrove.llm.storage import written


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    profiled = quality_rules.quality_profile(docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)]), f"_{docs.columns.index('text')}")
    return profiled.where("kept").select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one, exactly or nearly; documents left without any line go."""
    return line_dedup.without_repeated_lines(docs)


def by_fingerprint(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the smallest id, and of its rows one."""
    return simhash.one_of_each(docs)


def by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the piece ids of their whole texts."""
    return piece_viterbi.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", by_quality),
    ("line dedup", by_lines),
    ("SimHash near-dedup", by_fingerprint),
    ("benchmark decontamination", by_benchmark),
    ("SentencePiece encoding", to_pieces),
]

#: Rolling hashes, fuzzy components and Viterbi segmentation have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
