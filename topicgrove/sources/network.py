"""Readers of text-rich networks: nodes, edges, documents, background lines, vectors and vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicgrove.functions.text import extract_phrases
from topicgrove.sources.checkpoints import held


@dataclass(frozen=True)
class Config:
    """What a build is told: where data lie, the children of each level, and the lifts."""

    data_dir: str
    output_dir: str = "taxonomy"
    base_name: str = "run"
    levels: tuple[int, ...] = (5, 4)
    tf_lift: float = 1.5
    idf_lift: float = 1.5
    lift_decay: float = 0.9
    damping: float = 0.8


@dataclass(frozen=True)
class Network:
    """nodes(nid, node_type, entity_id, extra), edges(src, dst, w)."""

    nodes: DataFrame
    edges: DataFrame


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(
        F.get(parts, 0).cast("long").alias("nid"),
        F.get(parts, 1).alias("node_type"),
        F.get(parts, 2).alias("entity_id"),
        F.slice(parts, F.lit(4), F.greatest(F.size(parts) - 3, F.lit(0))).alias("extra"),
    )


def read_edges(spark: SparkSession, path: str, keep_weights: bool = True) -> DataFrame:
    """Lines of 2 or 3 tokens after the header; the weight is 1 unless given; other lines are skipped.

    Each file's first line is its header, which ``_metadata`` tells apart.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    # the first line of a file's first block has the smallest number in that block
    first = rows.where("block = 0").groupBy("file").agg(F.min("n").alias("n")).select("n")
    parts = F.split(F.trim("value"), r"\s+")
    body = rows.join(F.broadcast(first), "n", "left_anti").select(parts.alias("t")).where(F.size("t").isin(2, 3))
    w = F.coalesce(F.try_element_at("t", F.lit(3)).try_cast("double"), F.lit(1.0)) if keep_weights else F.lit(1.0)
    edges = body.select(F.get("t", 0).try_cast("long").alias("src"), F.get("t", 1).try_cast("long").alias("dst"), w.alias("w"))
    return edges.where("src is not null and dst is not null")


def summed(edges: DataFrame) -> DataFrame:
    """Edges that are given several times are one edge of the summed weight."""
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def symmetrized(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, then summed; a self loop weighs twice."""
    return summed(edges.select("src", "dst", "w").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))


def without_typed_edges(edges: DataFrame, nodes: DataFrame, node_type: str = "P") -> DataFrame:
    """Edges but those between two nodes of one type."""
    typed = nodes.where(F.col("node_type") == node_type).select("nid")
    both = edges.join(typed.withColumnRenamed("nid", "src"), "src", "left_semi").join(typed.withColumnRenamed("nid", "dst"), "dst", "left_semi")
    return edges.join(both.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def load_graph(spark: SparkSession, data_dir: str, undirected: bool = True, drop_citations: bool = True, keep_weights: bool = True) -> Network:
    nodes = read_nodes(spark, f"{data_dir}/node_info.txt")
    edges = read_edges(spark, f"{data_dir}/edges.txt", keep_weights)
    if drop_citations:
        edges = without_typed_edges(edges, nodes)
    return Network(nodes, symmetrized(edges) if undirected else summed(edges))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file or a folder of them, line numbers from 0 by file name and place.

    Lines are counted in each block of a file on the JVM; a row a block moves them.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    each = Window.partitionBy("file", "block")
    inside = held(rows.withColumn("inside", F.row_number().over(each.orderBy("at")) - 1))
    sizes = inside.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = sizes.select("file", "block", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("before"))
    return inside.join(F.broadcast(before), ["file", "block"]).select((F.col("before") + F.col("inside")).alias("line"), "value")


def load_documents(spark: SparkSession, data_dir: str) -> DataFrame:
    """(doc_id, line, text, phrases): ids and texts are matched by line number; of equal ids the last line stays."""
    ids, texts = _numbered(spark, f"{data_dir}/indices.txt"), _numbered(spark, f"{data_dir}/text_documents.txt")
    both = ids.withColumnRenamed("value", "doc_id").join(texts.withColumnRenamed("value", "text"), "line", "full")
    if not both.where("doc_id is null or text is null").isEmpty():
        raise ValueError("indices.txt and text_documents.txt have different numbers of lines")
    last = both.groupBy("doc_id").agg(F.max("line").alias("line"))
    return both.join(last, ["doc_id", "line"]).select("doc_id", "line", "text", extract_phrases(F.col("text")).alias("phrases"))


def read_background(spark: SparkSession, path: str) -> DataFrame:
    """(text, phrases): every line is a document, also one without phrases."""
    return spark.read.text(path).select(F.col("value").alias("text"), extract_phrases(F.col("value")).alias("phrases"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(term, vec) of a text file of vectors, with or without a header of two numbers: how many and how long."""
    parts = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).select(parts.alias("t")).where(F.size("t") > 1)
    seen = rows.agg(F.max(F.size("t") - 1).alias("dim"), F.count("*").alias("lines"))  # one row
    whole = (F.size("t") == 2) & (F.get("t", 1).try_cast("long") == F.col("dim")) & F.get("t", 0).try_cast("long").isNotNull()
    header = whole & ((F.col("dim") > 1) | (F.get("t", 0).try_cast("long") == F.col("lines") - 1))
    body = rows.crossJoin(F.broadcast(seen)).where(~F.coalesce(header, F.lit(False)))
    return body.select(F.get("t", 0).alias("term"), F.transform(F.slice("t", F.lit(2), F.size("t") - 1), lambda x: x.cast("double")).alias("vec"))


def warm_start(vocabulary: DataFrame, saved: DataFrame, dim: int, start: DataFrame) -> DataFrame:
    """(term, vec): saved vectors of the right length where there are any, else those of ``start``."""
    fit = saved.where(F.size("vec") == dim).select("term", F.col("vec").alias("saved_vec"))
    return vocabulary.select("term").join(fit, "term", "left").join(start, "term", "left").select("term", F.coalesce("saved_vec", "vec").alias("vec"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", " ")
    return spark.read.text(path).select(F.get(parts, 0).alias("word"), F.get(parts, 1).cast("long").alias("cn"))
