"""Contrast scores: how much more a term marks a node than its parent and its best sibling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicgrove.functions.text import contrast_equation


def best_sibling_tf(stats: DataFrame) -> DataFrame:
    """(prefix, term, sibling_tf): the largest positive tf of a term among the other nodes of the same parent.

    The two largest of each (parent, term) tell it for every node: no node is joined with its siblings.
    """
    return with_sibling_tf(stats).select("prefix", "term", "sibling_tf")


def with_sibling_tf(stats: DataFrame) -> DataFrame:
    """``stats`` with ``sibling_tf``; one window over (parent, term), which holds the children of one parent at most."""
    all_ = F.collect_list(F.when(F.col("tf") > 0, F.col("tf"))).over(Window.partitionBy("parent", "term"))
    most = F.sort_array(all_, asc=False)
    return stats.withColumn("sibling_tf", F.when(F.col("tf") == F.get(most, 0), F.get(most, 1)).otherwise(F.get(most, 0)))


def node_contrast(stats: DataFrame, parents: DataFrame, tf_lift: float, idf_lift: float, siblings: bool = True) -> DataFrame:
    """(prefix, term, distinct, score) of ``stats`` (prefix, parent, term, tf, idf) against ``parents`` (parent, term, tf).

    distinct = min(tf / parent's tf, tf / best sibling's tf), the second only if a sibling has the term; a term
    without tf scores 0.
    """
    own = with_sibling_tf(stats) if siblings else stats
    joined = own.join(parents.select("parent", "term", F.col("tf").alias("parent_tf")), ["parent", "term"])
    to_parent = F.try_divide("tf", "parent_tf")
    if siblings:
        distinct = F.least(to_parent, F.try_divide(F.col("tf"), F.col("sibling_tf")))  # least skips nulls
    else:
        distinct = to_parent
    score = F.when(F.col("tf") > 0, contrast_equation(distinct, F.col("tf"), F.col("idf"), tf_lift, idf_lift)).otherwise(0.0)
    return joined.select("prefix", "term", F.coalesce(distinct, F.lit(0.0)).alias("distinct_ratio"), F.coalesce(score, F.lit(0.0)).alias("score"))


def cluster_contrast(stats: DataFrame, larger: DataFrame, tf_lift: float, idf_lift: float, *by: str) -> DataFrame:
    """(by..., term, score): (tf / larger tf) x tf^tf_lift x idf^idf_lift, 0 without tf."""
    joined = stats.join(larger.select("term", F.col("tf").alias("larger_tf")), "term")
    score = contrast_equation(F.try_divide("tf", "larger_tf"), F.col("tf"), F.col("idf"), tf_lift, idf_lift)
    return joined.select(*by, "term", F.when(F.col("tf") > 0, F.coalesce(score, F.lit(0.0))).otherwise(0.0).alias("score"))


def with_prior(scores: DataFrame, priors: DataFrame) -> DataFrame:
    """Scores times (prefix, term, prior); a term without a prior keeps its score."""
    joined = scores.join(priors, ["prefix", "term"], "left")
    return joined.withColumn("score", F.col("score") * F.coalesce("prior", F.lit(1.0))).drop("prior")
