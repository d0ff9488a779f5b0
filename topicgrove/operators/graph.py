"""Operators over typed networks: look-ups, neighbours, slices, subgraphs, meta-paths and normalizations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgrove.functions.text import parse_metapath
from topicgrove.operators.ranges import numbered
from topicgrove.sources.checkpoints import held
from topicgrove.sources.network import Network, summed


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count("*").alias("n"))


def of_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("node_type") == node_type)


def positions(nodes: DataFrame) -> DataFrame:
    """Nodes with their position among those of their type, by id: numbered by ranges of (type, id), so that no task holds a type."""
    placed = numbered(nodes, "at_all", F.col("node_type"), F.col("nid"))
    first = placed.groupBy("node_type").agg(F.min("at_all").alias("first"))  # a row a type
    return placed.join(F.broadcast(first), "node_type").withColumn("position", F.col("at_all") - F.col("first")).drop("at_all", "first")


def lookup(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node_type, entity_id) with its nid: null if there is none, the largest of several."""
    known = nodes.groupBy("node_type", "entity_id").agg(F.max("nid").alias("nid"))
    return wanted.join(known, ["node_type", "entity_id"], "left")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def neighbors(edges: DataFrame, of: DataFrame, nodes: DataFrame | None = None, node_type: str | None = None) -> DataFrame:
    """(src, dst, w) from the ids ``of`` (nid), to one type only if asked for."""
    found = edges.join(of.select(F.col("nid").alias("src")), "src", "left_semi")
    if node_type is not None:
        found = found.join(of_type(nodes, node_type).select(F.col("nid").alias("dst")), "dst", "left_semi")
    return found.select("src", "dst", "w")


def type_slice(network: Network, source: str, target: str) -> DataFrame:
    """Edges from one type to another."""
    a = of_type(network.nodes, source).select(F.col("nid").alias("src"))
    b = of_type(network.nodes, target).select(F.col("nid").alias("dst"))
    return network.edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select("src", "dst", "w")


def subgraph(network: Network, keep: DataFrame) -> Network:
    """The network among the ids ``keep`` (nid), ids made dense in their order.

    They are numbered by sorted ranges of the kept nodes.
    """
    kept = network.nodes.join(keep.select("nid").distinct(), "nid", "left_semi")
    moved = held(numbered(kept, "new", F.col("nid")))
    ids = moved.select("nid", "new")
    edges = (
        network.edges.join(ids.select(F.col("nid").alias("src"), F.col("new").alias("_s")), "src")
        .join(ids.select(F.col("nid").alias("dst"), F.col("new").alias("_d")), "dst")
        .select(F.col("_s").alias("src"), F.col("_d").alias("dst"), "w")
    )
    extra = [c for c in network.nodes.columns if c != "nid"]
    return Network(moved.select(F.col("new").alias("nid"), *extra), edges)


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sparse matrix product of (src, dst, w) tables: meet on the middle, sum the products."""
    r = right.select(F.col("src").alias("mid"), F.col("dst").alias("far"), F.col("w").alias("w2"))
    met = left.join(r, left.dst == r.mid)
    return met.groupBy("src", F.col("far").alias("dst")).agg(F.sum(F.col("w") * F.col("w2")).alias("w"))


def path_matrix(network: Network, path: str) -> DataFrame:
    """Weights of all instances of a meta-path such as ``K<-P->A``; a step against the edges turns its slice over."""
    steps = []
    for a, b, direction in parse_metapath(path):
        if direction > 0:
            steps.append(type_slice(network, a, b))
        else:
            steps.append(type_slice(network, b, a).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return reduce(product, steps)


def sym_normalized(edges: DataFrame) -> DataFrame:
    """w / sqrt(sum of its row x sum of its column); 0 where a sum is 0."""
    rows = edges.groupBy("src").agg(F.sum("w").alias("_r"))
    columns = edges.groupBy("dst").agg(F.sum("w").alias("_c"))
    w = F.coalesce(F.try_divide(F.col("w"), F.sqrt(F.col("_r") * F.col("_c"))), F.lit(0.0))
    return edges.join(rows, "src").join(columns, "dst").select("src", "dst", w.alias("w"))


def row_normalized(table: DataFrame, row: str, value: str) -> DataFrame:
    total = table.groupBy(row).agg(F.sum(value).alias("_sum"))
    return table.join(total, row).withColumn(value, F.coalesce(F.try_divide(value, "_sum"), F.lit(0.0))).drop("_sum")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst array) sorted by id: a row holds one node's neighbours."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dst"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["summed"]
