"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicgrove.llm.storage import written


@lru_cache(maxsize=4)
def _encoding(ranks_file: str, pattern: str):
    import tiktoken

    lines = Path(ranks_file).read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): exact encoded length of each whole text; a null or empty text has 0 tokens.

    Rows are independent: repeated rows get equal lengths, an empty table gives none, other columns are ignored. A
    text of any length is encoded whole, by one task.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks_file, pattern).encode_ordinary
        for batch in batches:
            lengths = [len(encode(text)) if text else 0 for text in map(pa.StringScalar.as_py, batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["doc_id", "n_tokens"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs) for each length that occurs; the rows are bounded by the longest text, not by the corpus."""
    return lengths.groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def context_table(histogram: DataFrame, span: int = 1024) -> DataFrame:
    """For each length L: documents and tokens at or above L, tokens kept when texts are cut at L, and the quantile.

    Suffix sums run in two levels: totals of every ``span`` lengths first, then inside each span, so that no task
    holds the whole histogram. ``truncated_tokens`` = tokens in texts shorter than L + L x (texts of L or more);
    ``quantile`` is the share of documents of at most L tokens. For a limit that no text has, take the next longer
    L': truncated = ``truncated_tokens`` - (L' - L) x ``docs_at_least``. An empty histogram gives an empty table.
    The histogram is written before its two uses, so that the texts are encoded once.
    """
    cells = written(histogram, "histogram").withColumn("cell", F.expr(f"n_tokens div {span}"))
    tops = cells.groupBy("cell").agg(F.sum("n_docs").alias("cell_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("cell_tokens"))
    above = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    tops = tops.select(
        "cell",
        F.coalesce(F.sum("cell_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("cell_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("cell_docs").over(every).alias("total_docs"),
        F.sum("cell_tokens").over(every).alias("total_tokens"),
    )
    suffix = Window.partitionBy("cell").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cells.join(tops, "cell")
        .withColumn("docs_at_least", F.col("docs_above") + F.sum("n_docs").over(suffix))
        .withColumn("tokens_at_least", F.col("tokens_above") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(suffix))
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
            "total_docs",
            "total_tokens",
            ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
        )
    )
