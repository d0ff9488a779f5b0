"""Writers of taxonomies, vectors, vocabularies and contexts, and the reader of a dumped taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicgrove.functions.text import file_safe, strip_phrase_tags
from topicgrove.operators.topk import top_k_by


def _score_map(table: DataFrame, key: str, value: str, name: str) -> DataFrame:
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))))
    return table.groupBy("prefix").agg(F.map_from_entries(entries).alias(name))


def node_objects(tax_nodes: DataFrame, terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(prefix, term_scores, doc_prior, term_prior) of terms (prefix, term, score, prior) and docs (prefix, doc_id, prior).

    A prior that is missing is 1. A node's maps hold that node's terms and documents; nodes come level by level.
    """
    none = F.create_map().cast("map<string,double>")
    terms, docs = terms.withColumn("prior", F.coalesce("prior", F.lit(1.0))), docs.withColumn("prior", F.coalesce("prior", F.lit(1.0)))
    made = (
        tax_nodes.select("prefix").distinct()
        .join(_score_map(terms.where("score is not null"), "term", "score", "term_scores"), "prefix", "left")
        .join(_score_map(docs.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "prior", "doc_prior"), "prefix", "left")
        .join(_score_map(terms, "term", "prior", "term_prior"), "prefix", "left")
    )
    return made.select("prefix", *[F.coalesce(c, none).alias(c) for c in ("term_scores", "doc_prior", "term_prior")])


def save_taxonomy(path: str, tax_nodes: DataFrame, terms: DataFrame, docs: DataFrame) -> None:
    """Compressed JSON, an object a node, by level and then by prefix."""
    rows = node_objects(tax_nodes, terms, docs)
    rows.orderBy(F.size(F.split("prefix", "/")), "prefix").write.mode("overwrite").json(path, compression="gzip")


def load_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, terms, docs) as they were saved, scores included."""
    kind = "map<string,double>"
    rows = spark.read.schema(f"prefix string, term_scores {kind}, doc_prior {kind}, term_prior {kind}").json(path)
    prior = rows.select("prefix", F.explode("term_prior").alias("term", "prior"))
    score = rows.select("prefix", F.explode("term_scores").alias("term", "score"))
    terms = prior.join(score, ["prefix", "term"], "full").select("prefix", "term", "score", "prior")
    return rows.select("prefix"), terms, rows.select("prefix", F.explode("doc_prior").alias("doc_id", "prior"))


def save_readable(path: str, terms: DataFrame, docs: DataFrame) -> None:
    """``terms`` and ``documents`` as TSV folders by node; only nodes with a scored term."""
    scored = terms.where("score is not null")
    some = scored.select("prefix").distinct()
    named = scored.select(file_safe(F.col("prefix")).alias("node"), "term", "score").orderBy("node", F.desc("score"), "term")
    named.write.mode("overwrite").partitionBy("node").csv(f"{path}/terms", sep="\t")
    kept = docs.join(some, "prefix", "left_semi").select(file_safe(F.col("prefix")).alias("node"), "doc_id", F.coalesce("prior", F.lit(1.0)).alias("prior"))
    kept.orderBy("node", F.desc("prior"), "doc_id").write.mode("overwrite").partitionBy("node").csv(f"{path}/documents", sep="\t")


def dot_graph(terms: DataFrame, shrink_root: bool = True, max_level: int = 4, top: int = 20) -> str:
    """A tree in DOT: the best terms of each node, ``top`` rows a node on the driver; the root may be a star."""
    best = top_k_by(terms.where("score is not null"), ["prefix"], "score", top, "term")
    best = best.withColumn("shown", F.when(F.col("term").startswith("<phrase>"), strip_phrase_tags(F.col("term"))).otherwise(F.col("term")))
    rows = best.where(F.size(F.split("prefix", "/")) <= max_level).groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("rank", "shown"))).alias("t")).orderBy("prefix").collect()
    lines, known = ["digraph taxonomy {", "  node [shape=box];"], {r["prefix"] for r in rows}
    for r in rows:
        shown = "*" if shrink_root and "/" not in r["prefix"] else "\\n".join(x["shown"].replace('"', "'") for x in r["t"])
        lines.append(f'  "{r["prefix"]}" [label="{shown}"];')
        parent = r["prefix"].rpartition("/")[0]
        if parent in known:
            lines.append(f'  "{parent}" -> "{r["prefix"]}";')
    return "\n".join([*lines, "}"])


def save_vectors(path: str, vectors: DataFrame) -> None:
    """Text files of ``term v1 ... vn``; the first line of the first one tells how many there are and how long they are."""
    seen = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"))
    header = seen.select(F.concat_ws(" ", F.col("n").cast("string"), F.coalesce("dim", F.lit(0)).cast("string")).alias("line"))
    rows = vectors.select(F.concat_ws(" ", "term", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("line"))
    header.coalesce(1).unionAll(rows).write.mode("overwrite").text(path)


def save_vocabulary(path: str, vocabulary: DataFrame) -> None:
    vocabulary.select("word", "cn").write.mode("overwrite").csv(path, sep=" ")


def save_dot(path: str, terms: DataFrame, **how) -> None:
    """``dot_graph`` as one text file of the folder ``path``; the tree is as small as its top terms."""
    spark = terms.sparkSession
    spark.createDataFrame([(dot_graph(terms, **how),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_contexts(path: str, context: DataFrame, prefix: str, inputs: str) -> None:
    """Motif contexts (motif, term, instance, w) of a node, kept by its prefix and by a name of what they were made from."""
    context.write.mode("overwrite").partitionBy("motif").parquet(f"{path}/inputs={inputs}/node={file_safe_name(prefix)}")


def load_contexts(spark: SparkSession, path: str, prefix: str, inputs: str) -> DataFrame | None:
    """The contexts that ``save_contexts`` has kept for the node and the inputs; None if there are none."""
    folder = f"{path}/inputs={inputs}/node={file_safe_name(prefix)}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("term string, instance string, w double, motif string").parquet(folder).select("motif", "term", "instance", "w")


def file_safe_name(prefix: str) -> str:
    return prefix.replace("/", "_")
