"""Order over a whole table without one task: sorted ranges are numbered or summed apart, few totals move them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicgrove.sources.checkpoints import held


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held(df.repartitionByRange(parts, *order).withColumn("range_no", F.spark_partition_id()))


def _moved(ranged: DataFrame, total: Column, inside: Column, name: str) -> DataFrame:
    # a row a range: bounded by the number of partitions, whatever the input
    sums = ranged.groupBy("range_no").agg(total.alias("range_sum"))
    before = sums.select("range_no", (F.sum("range_sum").over(Window.orderBy("range_no")) - F.col("range_sum")).alias("range_before"))
    return ranged.join(F.broadcast(before), "range_no").withColumn(name, F.col("range_before") + inside).drop("range_no", "range_before")


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with a column ``name``: each row's number from 0 in ``order``, which should leave no ties."""
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy(*order)) - 1
    return _moved(_ranged(df, list(order)), F.count("*"), inside.cast("long"), name)


def summed_up(df: DataFrame, value: str, name: str, *order: Column) -> DataFrame:
    """``df`` with a column ``name``: the sum of ``value`` over the rows up to each one in ``order``."""
    upto = F.sum(value).over(Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _moved(_ranged(df, list(order)), F.sum(value), upto, name)
