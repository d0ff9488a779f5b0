"""Top-k and order statistics; ties are broken by the named keys, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The k rows of the largest scores: each partition sends k at most."""
    return df.orderBy(F.desc(score), *ties).limit(k)


def top_k_by(df: DataFrame, by: list[str], score: str, k: int, *ties: str) -> DataFrame:
    """The k best of each group, with ``rank`` from 1; Spark keeps k a group before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def candidate_cut(n: int, most: int = 500, share: float = 0.2) -> int:
    return min(most, int(share * n))


def order_statistic(df: DataFrame, score: str, share: float = 0.2) -> float | None:
    """The score at position int(share x n) of the falling order; null if the table is empty.

    Found by bisection of counted ranges: each round counts rows above a few cuts, so nothing is sorted as a whole.
    """
    n, low, high = df.agg(F.count(score), F.min(score), F.max(score)).first()
    if not n:
        return None
    index = int(share * n)
    while True:
        # cuts inside [low, high]; the value sought is the largest v with more than ``index`` rows at or above it
        cuts = [low + (high - low) * i / 64 for i in range(1, 64)]
        counts = df.agg(*[F.sum((F.col(score) >= c).cast("long")) for c in cuts]).first()
        below = [c for c, m in zip(cuts, counts, strict=True) if m > index]
        above = [c for c, m in zip(cuts, counts, strict=True) if m <= index]
        new = (max([low, *below]), min([high, *above]))
        inside = df.where((F.col(score) >= new[0]) & (F.col(score) <= new[1]))
        distinct = inside.select(score).distinct().orderBy(F.desc(score)).limit(65).collect()
        if len(distinct) < 65 or new == (low, high):
            values = [r[0] for r in distinct]
            at_least = df.agg(*[F.sum((F.col(score) >= v).cast("long")) for v in values]).first()
            return next(v for v, m in zip(values, at_least, strict=True) if m > index)
        low, high = new
