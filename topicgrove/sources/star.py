"""A text-rich network from star-schema tables: orders are documents, part names are phrases.

Types: P orders, K part names, A suppliers, V nations of customers, Y order years; ids are parted by type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicgrove.functions.text import add_phrase_tags
from topicgrove.sources.checkpoints import held
from topicgrove.sources.network import Network

OFFSET = {"P": 1_000_000_000, "K": 2_000_000_000, "A": 3_000_000_000, "V": 4_000_000_000, "Y": 5_000_000_000}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nid(kind: str, key) -> F.Column:
    return (F.lit(OFFSET[kind]) + key).cast("long")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_name, nid): distinct names, numbered in order. The window holds the vocabulary, not the corpus."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", nid("K", F.row_number().over(Window.orderBy("p_name"))).alias("nid"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    parts = [
        orders.select(nid("P", F.col("o_orderkey")).alias("nid"), F.lit("P").alias("node_type"), F.col("o_orderkey").cast("string").alias("entity_id")),
        terms(spark, sf_dir).select("nid", F.lit("K").alias("node_type"), add_phrase_tags(F.col("p_name")).alias("entity_id")),
        table(spark, sf_dir, "supplier").select(nid("A", F.col("s_suppkey")).alias("nid"), F.lit("A").alias("node_type"), F.col("s_name").alias("entity_id")),
        table(spark, sf_dir, "nation").select(nid("V", F.col("n_nationkey")).alias("nid"), F.lit("V").alias("node_type"), F.col("n_name").alias("entity_id")),
        orders.select(F.year("o_orderdate").alias("y")).distinct().select(nid("Y", F.col("y")).alias("nid"), F.lit("Y").alias("node_type"), F.col("y").cast("string").alias("entity_id")),
    ]
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return made


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w) from documents: weights of terms and suppliers count line items."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name").join(terms(spark, sf_dir), "p_name")
    by_term = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", "nid").agg(F.count("*").cast("double").alias("w"))
    by_author = lines.groupBy("l_orderkey", "l_suppkey").agg(F.count("*").cast("double").alias("w"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    venues = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return (
        by_term.select(nid("P", F.col("l_orderkey")).alias("src"), F.col("nid").alias("dst"), "w")
        .unionByName(by_author.select(nid("P", F.col("l_orderkey")).alias("src"), nid("A", F.col("l_suppkey")).alias("dst"), "w"))
        .unionByName(venues.select(nid("P", F.col("o_orderkey")).alias("src"), nid("V", F.col("c_nationkey")).alias("dst"), F.lit(1.0).alias("w")))
        .unionByName(orders.select(nid("P", F.col("o_orderkey")).alias("src"), nid("Y", F.year("o_orderdate")).alias("dst"), F.lit(1.0).alias("w")))
    )


def network(spark: SparkSession, sf_dir: str) -> Network:
    """The network, held: a plan over several slices of it reads the star tables once."""
    return Network(held(nodes(spark, sf_dir)), held(edges(spark, sf_dir)))


def doc_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prefix, parent, doc_id, term, n, weight): counts of a term in a document; a document without terms has a null.

    The prefix is the customer's nation below its region; the weight is 1 more for an urgent order.
    """
    orders, customers, nations = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    placed = (
        orders.join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("doc_id"),
            F.concat(F.lit("0/"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_nationkey").cast("string")).alias("prefix"),
            F.concat(F.lit("0/"), F.col("n_regionkey").cast("string")).alias("parent"),
            F.when(F.col("o_orderpriority") == "1-URGENT", 2.0).otherwise(1.0).alias("weight"),
        )
    )
    counted = (
        table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("doc_id"), F.col("p_name").alias("term")).agg(F.count("*").alias("n"))
    )
    return placed.join(counted, "doc_id", "left").select("prefix", "parent", "doc_id", "term", F.coalesce("n", F.lit(0)).alias("n"), "weight")
