"""An extension: term counts of a stream of documents in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgrove.functions.text import extract_phrases


def windowed_term_counts(stream: DataFrame, time_col: str = "ts", text_col: str = "text", delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, term, n, docs) by window; rows later than ``delay`` are left out, so state is bounded."""
    terms = stream.withWatermark(time_col, delay).select(time_col, F.posexplode(extract_phrases(F.col(text_col))).alias("pos", "term"))
    counted = terms.groupBy(F.window(time_col, size).alias("w"), "term").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "term", "n")
