"""Builds a taxonomy from the files of a folder: ``python -m topicgrove --data_dir DIR --output_dir DIR``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from topicgrove.plans.taxonomy import Builder, Node, Settings
from topicgrove.sources import sinks
from topicgrove.sources.checkpoints import clean_up
from topicgrove.sources.network import Config, load_documents, load_graph, read_background


def read_config(args: list[str] | None = None) -> Config:
    parser = argparse.ArgumentParser("topicgrove")
    default = Config("")
    parser.add_argument("--data_dir", required=True)
    for name in ("output_dir", "base_name"):
        parser.add_argument(f"--{name}", default=getattr(default, name))
    for name in ("tf_lift", "idf_lift", "damping"):
        parser.add_argument(f"--{name}", type=float, default=getattr(default, name))
    parser.add_argument("--levels", type=int, nargs="+", default=list(default.levels))
    found = vars(parser.parse_args(args))
    return Config(**found | {"levels": tuple(found["levels"])})


def tables(root: Node) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prefix), (prefix, term, score, prior) and (prefix, doc_id, prior) of a tree."""
    nodes = list(root.walk())
    spark = root.docs.sparkSession
    names = spark.createDataFrame([(n.prefix,) for n in nodes], "prefix string")
    priors = Builder.keyed([(n.prefix, n.terms) for n in nodes])
    scores = Builder.keyed([(n.prefix, n.scores) for n in nodes if n.scores is not None])
    return names, priors.join(scores, ["prefix", "term"], "left").select("prefix", "term", "score", "prior"), Builder.keyed([(n.prefix, n.docs) for n in nodes])


def build(spark: SparkSession, config: Config, settings: Settings | None = None) -> Node:
    """Read the folder's network, documents and background, build, and write the dump, the readable tree and the drawing."""
    network = load_graph(spark, config.data_dir)
    corpus = load_documents(spark, config.data_dir)
    background = read_background(spark, f"{config.data_dir}/background_documents.txt")
    root = Builder(corpus, network, background, config, settings).build()
    nodes, terms, docs = tables(root)
    out = f"{config.output_dir}/{config.base_name}"
    sinks.save_taxonomy(f"{out}/taxonomy", nodes, terms, docs)
    sinks.save_readable(f"{out}/readable", terms, docs)
    sinks.save_dot(f"{out}/tree", terms)
    return root


def main(args: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("topicgrove").getOrCreate()
    try:
        build(spark, read_config(args))
    finally:
        clean_up(spark)


if __name__ == "__main__":
    main()
