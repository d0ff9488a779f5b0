"""Network motifs: instances of small typed patterns around a term, all as (motif, term, instance, w)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicgrove.functions.text import period_of, uniform
from topicgrove.operators.graph import of_type, product, type_slice
from topicgrove.operators.ranges import numbered
from topicgrove.operators.ranking import bipartite_authority, normalized_entropy
from topicgrove.operators.walks import cell_of, in_cells, placed_intervals
from topicgrove.sources.checkpoints import held
from topicgrove.sources.network import Network


class Matcher(Protocol):
    """The extension point: anything with a name and a ``match`` of this form can be given to ``contexts``."""

    name: str

    def match(self, network: Network, docs: DataFrame | None, terms: DataFrame | None) -> DataFrame: ...


def _restricted(table: DataFrame, ids: DataFrame | None, column: str) -> DataFrame:
    return table if ids is None else table.join(ids.select(F.col("nid").alias(column)), column, "left_semi")


def term_documents(network: Network, docs: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(src = term, dst = document, w), within the node's documents and terms."""
    found = type_slice(network, "P", "K").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return _restricted(_restricted(found, docs, "dst"), terms, "src")


def _named(name: str, table: DataFrame) -> DataFrame:
    return table.select(F.lit(name).alias("motif"), F.col("src").alias("term"), F.col("dst").cast("string").alias("instance"), "w")


class TermPaper:
    name = "KP"

    def match(self, network, docs=None, terms=None):
        return _named(self.name, term_documents(network, docs, terms))


class TermVenue:
    name = "KPV"

    def match(self, network, docs=None, terms=None):
        return _named(self.name, product(term_documents(network, docs, terms), type_slice(network, "P", "V")))


class TermAuthor:
    name = "KPA"

    def match(self, network, docs=None, terms=None):
        return _named(self.name, product(term_documents(network, docs, terms), type_slice(network, "P", "A")))


class TermVenuePeriod:
    """Papers of a term at a venue in a five-year period; years without a period are left out."""

    name = "KPVY"

    def match(self, network, docs=None, terms=None):
        venue = type_slice(network, "P", "V").groupBy("src").agg(F.min("dst").alias("venue"))
        year = type_slice(network, "P", "Y").groupBy("src").agg(F.min("dst").alias("ynid"))
        years = of_type(network.nodes, "Y").select(F.col("nid").alias("ynid"), period_of(F.col("entity_id").try_cast("int")).alias("period"))
        place = venue.join(year, "src").join(F.broadcast(years), "ynid").where("period is not null")
        place = place.select(F.col("src").alias("dst"), F.concat_ws(" ", F.col("venue").cast("string"), F.col("period").cast("string")).alias("instance"))
        met = term_documents(network, docs, terms).join(place, "dst")
        counted = met.groupBy("src", "instance").agg(F.count("*").cast("double").alias("w"))
        return counted.select(F.lit(self.name).alias("motif"), F.col("src").alias("term"), "instance", "w")


#: authors of a paper that are paired in one piece
PIECE = 512


def author_pairs(network: Network, threshold: int = 1) -> DataFrame:
    """(p, a1, a2) with a1 < a2 of each paper, of authors who have ``threshold`` papers at least.

    The join is on the paper; one of very many authors is joined in pieces of about PIECE first authors each.
    """
    pa = type_slice(network, "P", "A").select(F.col("src").alias("p"), F.col("dst").alias("a")).distinct()
    if threshold > 1:
        pa = held(pa)
        pa = pa.join(pa.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= threshold).select("a"), "a", "left_semi")
    sizes = pa.groupBy("p").agg(F.ceil(F.count("*") / F.lit(PIECE)).alias("pieces"))
    sized = pa.join(sizes, "p")
    left = sized.select("p", F.col("a").alias("a1"), F.pmod(F.xxhash64("a"), "pieces").alias("piece"))
    right = sized.select("p", F.col("a").alias("a2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
    return left.join(right, ["p", "piece"]).where("a1 < a2").select("p", "a1", "a2")


def frequent_pairs(pairs: DataFrame, threshold: int = 5) -> DataFrame:
    return pairs.groupBy("a1", "a2").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)


class TermAuthorPair:
    """Papers of a term by a pair of authors who wrote ``threshold`` papers or more together, of all papers.

    ``strict``: a paper adds the number of its neighbours at or after the last of term and authors, in id order.
    """

    name = "KPAA"

    def __init__(self, threshold: int = 5, strict: bool = False):
        self.threshold, self.strict = threshold, strict

    def match(self, network, docs=None, terms=None):
        pairs = held(author_pairs(network, self.threshold))
        frequent = pairs.join(frequent_pairs(pairs, self.threshold).select("a1", "a2"), ["a1", "a2"], "left_semi")
        kp = term_documents(network, docs, terms).select(F.col("src").alias("term"), F.col("dst").alias("p"))
        met = kp.join(frequent, "p")
        label = F.concat_ws(" - ", F.col("a1").cast("string"), F.col("a2").cast("string"))
        if not self.strict:
            counted = met.groupBy("term", "a1", "a2").agg(F.count_distinct("p").cast("double").alias("w"))
        else:
            order = Window.partitionBy("p").orderBy("nid")
            papers = of_type(network.nodes, "P").select(F.col("nid").alias("p"))
            near = network.edges.select(F.col("src").alias("p"), F.col("dst").alias("nid")).join(papers, "p", "left_semi").distinct()
            placed = near.select("p", "nid", F.row_number().over(order).alias("at"), F.count("*").over(Window.partitionBy("p")).alias("n"))
            for who in ("term", "a1", "a2"):
                met = met.join(placed.select("p", F.col("nid").alias(who), F.col("at").alias(f"at_{who}"), F.col("n").alias(f"n_{who}")), ["p", who])
            weight = F.col("n_term") - F.greatest("at_term", "at_a1", "at_a2") + 1
            counted = met.groupBy("term", "a1", "a2").agg(F.sum(weight).cast("double").alias("w"))
        return counted.select(F.lit(self.name).alias("motif"), "term", label.alias("instance"), "w")


MATCHERS = (TermPaper(), TermVenue(), TermAuthor(), TermVenuePeriod(), TermAuthorPair())


def contexts(network: Network, matchers: Iterable[Matcher] = MATCHERS, docs: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [m.match(network, docs, terms) for m in matchers])


def propagated(seeds: DataFrame, context: DataFrame, iterations: int = 4, tolerance: float | None = None) -> DataFrame:
    """(cluster, instance, score) of one motif's contexts, from seeds (cluster, term)."""
    matrix = context.select(F.col("term").alias("src"), F.col("instance").alias("dst"), "w")
    start = seeds.select("cluster", F.col("term").alias("src"), F.lit(1.0).alias("a"))
    return bipartite_authority(matrix, start, iterations, tolerance).withColumnRenamed("dst", "instance")


def instance_scores(seeds: DataFrame, context: DataFrame, k: int, tolerance: float | None = None) -> DataFrame:
    """(instance, score): mean score over k clusters after 4 rounds x (1 - normalized entropy after 1 round).

    0 for an instance that one round does not reach.
    """
    mean = normalized_entropy(propagated(seeds, context, 4, tolerance), k, "instance").select("instance", "mean")
    sure = normalized_entropy(propagated(seeds, context, 1), k, "instance").where("total > 0").select("instance", (1 - F.col("entropy")).alias("sure"))
    joined = context.select("instance").distinct().join(mean, "instance", "left").join(sure, "instance", "left")
    return joined.select("instance", (F.coalesce("mean", F.lit(0.0)) * F.coalesce("sure", F.lit(0.0))).alias("score"))


def selected(context: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Contexts of the instances that score over the threshold; ties at it go."""
    return context.join(scores.where(F.col("score") > threshold).select("motif", "instance"), ["motif", "instance"], "left_semi")


def sampled_sequences(context: DataFrame, per_term: int = 40, length: int = 4, weighted: bool = False, smooth_all: bool = False, seed: int = 0) -> DataFrame:
    """(motif, term, seq, step, instance): sequences of instances drawn for each term, with replacement.

    Draws are uniform among the term's instances, or by weight; ``smooth_all`` draws among all instances of the
    motif. A term without instances has no sequences. The draws depend on the keys and the seed alone.
    """
    if smooth_all:
        listed = numbered(context.select("motif", "instance").distinct(), "at_all", F.col("motif"), F.col("instance"))
        sizes = listed.groupBy("motif").agg(F.count("*").alias("n"), F.min("at_all").alias("first"))  # a row a motif
        listed = listed.join(F.broadcast(sizes), "motif").select("motif", "instance", (F.col("at_all") - F.col("first")).alias("at"))
        terms = context.select("motif", "term").distinct().join(F.broadcast(sizes), "motif").select("motif", "term", "n")
    else:
        placed = held(placed_intervals(context, ["motif", "term"], "instance", F.col("w") if weighted else F.lit(1.0)))
        terms = placed.select("motif", "term", "total", "n").distinct()
    draws = terms.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(per_term - 1)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    u = uniform("motif", "term", "seq", "step", seed=seed)
    names = ["motif", "term", "seq", "step", "instance"]
    if smooth_all:
        return draws.withColumn("at", F.floor(u * F.col("n"))).join(listed, ["motif", "at"]).select(*names)
    drawn = draws.withColumn("u", u * F.col("total"))
    if not weighted:  # the draw is a place: an equi-join
        return drawn.withColumn("low", F.floor("u").cast("double")).join(placed.select("motif", "term", "instance", "low"), ["motif", "term", "low"]).select(*names)
    rows = in_cells(placed).select("motif", "term", "instance", "low", "high", "cell")
    return drawn.withColumn("cell", cell_of("u")).join(rows, ["motif", "term", "cell"]).where("low <= u and u < high").select(*names)


def sequence_lines(draws: DataFrame, seed: int = 0) -> DataFrame:
    """(line): ``term motif_instance ...`` of each sequence, in an order drawn by hash."""
    steps = F.array_sort(F.collect_list(F.struct("step", F.concat_ws("_", "motif", F.translate("instance", " ", "_")).alias("x"))))
    rows = draws.groupBy("motif", "term", "seq").agg(F.transform(steps, lambda s: s["x"]).alias("x"))
    line = F.concat_ws(" ", F.col("term").cast("string"), F.array_join("x", " "))
    return rows.select(line.alias("line"), F.xxhash64("motif", "term", "seq", F.lit(seed)).alias("at")).orderBy("at").select("line")
