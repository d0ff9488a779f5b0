"""Connected components as a distributed union-find over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicgrove.llm.storage import written


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("high"), F.least(a, b).alias("low")]


def _flattened(hooks: DataFrame) -> DataFrame:
    """Follow ``high -> low`` to its end by pointer jumping; ``low`` is always smaller, so there is no cycle."""
    while True:
        target = hooks.select(F.col("high").alias("via"), F.col("low").alias("beyond"))
        hooks = written(
            hooks.join(target, hooks.low == target.via, "left").select(
                "high", F.coalesce("beyond", "low").alias("low"), F.col("beyond").isNotNull().alias("moved")
            ),
            "jump",
        )
        if hooks.where("moved").isEmpty():
            return hooks.select("high", "low")
        hooks = hooks.select("high", "low")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that is not the smallest of its component; ``root`` is that smallest node.

    Each round hooks every node onto its smallest smaller neighbour, flattens the hooks and contracts the edges
    to their roots; every round leaves at most the nodes without a smaller neighbour, and the edges between them.
    Nulls and self loops are no links. Nothing is gathered on the driver but whether edges are left. A node with
    very many edges is pre-aggregated by the minimum; in the joins its rows stand on the side that Spark splits.
    """
    links = written(edges.select(*_ordered(F.col(a), F.col(b))).where("high <> low").distinct(), "links")
    label = None
    while not links.isEmpty():
        flat = _flattened(links.groupBy("high").agg(F.min("low").alias("low")))
        step = flat.select(F.col("high").alias("old"), F.col("low").alias("new"))
        if label is None:
            label = flat.select(F.col("high").alias("node"), F.col("low").alias("root"))
        else:
            kept = label.join(step, label.root == step.old, "left").select("node", F.coalesce("new", "root").alias("root"))
            # roots of earlier rounds that were hooked now are nodes of their own
            label = written(kept.unionByName(step.select(F.col("old").alias("node"), F.col("new").alias("root"))), "label")
        at = links.join(step, links.high == step.old, "left").select(F.coalesce("new", "high").alias("high"), "low")
        at = at.join(step, at.low == step.old, "left").select("high", F.coalesce("new", "low").alias("low"))
        links = written(at.select(*_ordered(F.col("high"), F.col("low"))).where("high <> low").distinct(), "links")
    if label is None:
        label = links.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return label
