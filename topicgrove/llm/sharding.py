"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicgrove.llm.storage import written


def balanced_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """(id, size, text_crc32, shard, slot): shards are contiguous in id order and near equal in bytes.

    A document's size is its UTF-8 bytes (a null text has none) plus ``overhead``. Only (id, size, crc) move: they
    are dealt into sorted ranges, each range is summed, and the few range totals give every range its offset in
    the global prefix sum. A document goes to the shard that holds the middle of its bytes, so a shard misses
    its target by less than the largest document at either cut. Slots count from 0 in each shard in the same order.

    Null ids come first; equal ids and repeated rows are ordered by crc, size and text hash and all kept. An
    empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = ["doc_id", "text_crc32", "size", "_hash", "_row"]
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "sizes")

    # one row for each range: bounded by the number of partitions, whatever the input
    by_part = ranged.groupBy("part").agg(F.sum("size").alias("bytes"))
    before = by_part.select("part", (F.sum("bytes").over(Window.orderBy("part")) - F.col("bytes")).alias("before"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside))
        .join(F.broadcast(before), "part")
        # twice the byte at the document's middle, so that all is in integers
        .withColumn("middle", 2 * F.col("before") + 2 * F.col("upto") - F.col("size"))
        .withColumn("shard", F.expr(f"cast(middle * {shards} div (2 * total) as int)"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    )
    placed = written(placed.select("doc_id", "size", "text_crc32", "part", "shard", "nth"), "placed")
    # a (range, shard) cell is a run of rows; its first row and the cells before it in the shard give the slots
    cells = placed.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    cells = cells.select("part", "shard", "first", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("earlier"))
    return placed.join(F.broadcast(cells), ["part", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("earlier") + F.col("nth") - F.col("first")).cast("long").alias("slot")
    )
