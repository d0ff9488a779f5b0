"""Building a taxonomy: a level's nodes share one plan for statistics and scores, keyed by prefix; each is then expanded."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgrove.functions.text import decayed
from topicgrove.operators import clustering, contrast, motifs, ranking, text_stats, topk
from topicgrove.operators.embedding import Sgns
from topicgrove.operators.graph import lookup
from topicgrove.sources.checkpoints import held
from topicgrove.sources.network import Config, Network


@dataclass(frozen=True)
class Settings:
    """Limits of an expansion. ``cut`` thresholds are factor / number of children."""

    candidates: int = 500
    candidate_share: float = 0.2
    anchors: int = 50
    keep_ratio: float = 0.2
    factor: float = 2.0
    sequences: int = 40
    sequence_length: int = 4
    pagerank_rounds: int = 10
    sgns: Sgns = field(default_factory=Sgns)
    confident: motifs.Matcher = field(default_factory=motifs.TermAuthor)
    matchers: tuple[motifs.Matcher, ...] = motifs.MATCHERS


@dataclass
class Node:
    """docs (doc_id, prior), terms (term, prior); scores (term, score) once expanded."""

    prefix: str
    docs: DataFrame
    terms: DataFrame
    scores: DataFrame | None = None
    children: list[Node] = field(default_factory=list)

    @property
    def level(self) -> int:
        return self.prefix.count("/")

    def walk(self) -> Iterable[Node]:
        """This node and all below, level by level."""
        queue = [self]
        while queue:
            node = queue.pop(0)
            yield node
            queue += node.children


class Builder:
    """``corpus`` (doc_id string, text, phrases), a network whose documents carry those ids, and a background corpus."""

    def __init__(self, corpus: DataFrame, network: Network, background: DataFrame, config: Config, settings: Settings | None = None):
        self.corpus, self.network, self.config = corpus, network, config
        self.settings = settings or Settings()
        self.spark = corpus.sparkSession
        keywords = network.nodes.where("node_type = 'K'").select(F.col("entity_id").alias("term")).distinct()
        counts = text_stats.count_terms(background.withColumn("doc_id", F.monotonically_increasing_id()))
        self.background = self.held(text_stats.background_tf_idf(counts, keywords))
        one = F.lit(1.0).alias("prior")
        self.root = Node("0", self.held(corpus.select("doc_id", one)), self.held(keywords.select("term", one)))
        self.vectors: DataFrame | None = None
        self.net_vectors: DataFrame | None = None

    @staticmethod
    def held(df: DataFrame) -> DataFrame:
        return held(df)

    def stats(self, nodes: list[Node]) -> DataFrame:
        """(prefix, term, tf, idf) of each node's terms over its documents, weighted by their prior: one plan for all nodes."""
        docs = self.keyed([(n.prefix, n.docs) for n in nodes])
        terms = self.keyed([(n.prefix, n.terms) for n in nodes]).select("prefix", "term").distinct()
        counts = self.held(text_stats.count_terms(self.corpus.join(docs, "doc_id"), "prefix", weight="prior"))
        listed = terms.join(text_stats.term_sums(counts, "prefix"), ["prefix", "term"], "left")
        return text_stats.from_sums(listed, text_stats.group_totals(counts, "prefix"), "prefix")

    @staticmethod
    def keyed(tables: list[tuple[str, DataFrame]]) -> DataFrame:
        return reduce(DataFrame.unionByName, [t.select(F.lit(prefix).alias("prefix"), "*") for prefix, t in tables])

    def scores(self, nodes: list[Node], stats: DataFrame, parents: DataFrame) -> DataFrame:
        """(prefix, term, score) of all nodes of a level against their parents (parent, term, tf) and siblings."""
        level, c = nodes[0].level, self.config
        lifts = decayed(c.tf_lift, level, c.lift_decay), decayed(c.idf_lift, level, c.lift_decay)
        own = stats.withColumn("parent", F.regexp_replace("prefix", "/?[^/]*$", ""))
        scored = contrast.node_contrast(own, parents, *lifts)
        return contrast.with_prior(scored, self.keyed([(n.prefix, n.terms) for n in nodes])).select("prefix", "term", "score")

    def cluster_scores(self, labels: DataFrame, own: DataFrame, term_docs: DataFrame, lifts: tuple[float, float]) -> DataFrame:
        """(label, term, score): each cluster's terms in the cluster's documents against the node's statistics."""
        near = clustering.cluster_documents(labels, term_docs).withColumnRenamed("doc", "doc_id")
        rows = self.corpus.join(near, "doc_id")
        counts = text_stats.count_terms(rows, "label", weight="weight")
        stats = text_stats.tf_idf(counts, "label").join(labels, ["label", "term"], "left_semi")
        return contrast.cluster_contrast(stats, own, *lifts, "label")

    def expand(self, node: Node, n_children: int, own: DataFrame) -> None:
        """Give a scored node its children; ``own`` is the node's statistics (term, tf, idf)."""
        s, level = self.settings, node.level
        if n_children < 1 or node.scores.isEmpty():
            return
        ids = lookup(self.network.nodes, node.terms.select(F.lit("K").alias("node_type"), F.col("term").alias("entity_id"))).where("nid is not null")
        papers = lookup(self.network.nodes, node.docs.select(F.lit("P").alias("node_type"), F.col("doc_id").alias("entity_id"))).where("nid is not null")
        name = ids.select("nid", F.col("entity_id").alias("term"))
        context = self.held(motifs.contexts(self.network, s.matchers, papers, ids).join(name.withColumnRenamed("term", "t"), F.col("term") == F.col("nid")).select("motif", F.col("t").alias("term"), "instance", "w"))
        lines = self.held(self.local_lines(node))
        trained = s.sgns if level == 0 else s.sgns.deeper()
        word = trained.fit(lines, start=self.vectors)
        sure = context.where(F.col("motif") == s.confident.name)
        net = self.sequences(sure)
        joint_net = Sgns(**{**trained.__dict__, "lam_net": 1.0})
        net_vectors = joint_net.fit(lines, net, start=self.net_vectors)
        if level == 0:
            self.vectors, self.net_vectors = self.held(word), self.held(net_vectors)

        top = topk.top_k(node.scores, "score", max(n_children, topk.candidate_cut(node.terms.count(), s.candidates, s.candidate_share)), "term").select("term")
        a, _ = clustering.with_vectors(top, word)
        b, _ = clustering.with_vectors(top, net_vectors)
        by_word, by_net = self.held(clustering.spherical_kmeans(a, n_children)), self.held(clustering.spherical_kmeans(b, n_children))
        both = self.held(clustering.agreed(by_word, by_net, clustering.aligned(by_word, by_net)))
        term_docs = self.held(self.term_documents(papers, name))
        lifts = decayed(self.config.tf_lift, level + 1, self.config.lift_decay), decayed(self.config.idf_lift, level + 1, self.config.lift_decay)
        anchors = topk.top_k_by(self.cluster_scores(both, own, term_docs, lifts), ["label"], "score", s.anchors, "term")
        seeds = self.held(anchors.select(F.col("label").alias("cluster"), "term"))
        if seeds.isEmpty():
            return
        chosen = self.chosen_contexts(context, seeds, n_children)
        joint = (s.sgns if level == 0 else s.sgns.deeper(True)).fit(lines, self.sequences(chosen), start=self.vectors)

        x, _ = clustering.with_vectors(top, joint)
        mixture = clustering.fit_vmf(self.held(x), n_children)
        soft = clustering.hard_labels(clustering.posteriors(x, mixture))
        # the clusters' own priors: default lifts, no decay
        prior = self.cluster_scores(soft, own, term_docs, (self.config.tf_lift, self.config.idf_lift))
        every, _ = clustering.with_vectors(node.terms.select("term"), joint)
        child_terms = self.held(clustering.posteriors(every, mixture).where(F.col("p") > s.factor / n_children))
        reset = prior.where("score > 0").join(name, "term").select(F.col("label").alias("cluster"), "nid", F.col("score").alias("p"))
        members = ranking.membership(self.network.edges, ranking.weighted_reset(reset), self.config.damping, s.pagerank_rounds)
        doc_ids = papers.select("nid", F.col("entity_id").alias("doc_id"))
        child_docs = self.held(ranking.assigned(members, n_children, s.factor).join(doc_ids, "nid").select("cluster", "doc_id", "p"))
        for c in range(n_children):
            terms = child_terms.where(F.col("cluster") == c).select("term", F.col("p").alias("prior"))
            docs = child_docs.where(F.col("cluster") == c).select("doc_id", F.col("p").alias("prior"))
            if not terms.isEmpty() and not docs.isEmpty():
                node.children.append(Node(f"{node.prefix}/{c}", docs, terms))

    def local_lines(self, node: Node) -> DataFrame:
        """(text): the node's documents, phrases in one word each, 1 to 10 times by prior."""
        spaced = F.regexp_replace("text", "(?<=<phrase>)([^<]*)(?=</phrase>)", "$1")
        whole = F.array_join(F.transform(F.split(spaced, "(?=<phrase>)|(?<=</phrase>)"), lambda x: F.when(x.startswith("<phrase>"), F.translate(x, " ", "_")).otherwise(x)), " ")
        rows = text_stats.rescaled(node.docs, "prior").join(self.corpus, "doc_id")
        return text_stats.replicated(rows).select(whole.alias("text"))

    def term_documents(self, papers: DataFrame, name: DataFrame) -> DataFrame:
        found = motifs.term_documents(self.network, papers, name)
        doc = papers.select(F.col("nid").alias("dst"), F.col("entity_id").alias("doc"))
        return found.join(name.select(F.col("nid").alias("src"), "term"), "src").join(doc, "dst").select("term", "doc", "w")

    def sequences(self, context: DataFrame) -> DataFrame:
        draws = motifs.sampled_sequences(context, self.settings.sequences, self.settings.sequence_length)
        return motifs.sequence_lines(draws).select(F.col("line").alias("text"))

    def chosen_contexts(self, context: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
        """Contexts of the best-scored share of instances over all motifs."""
        scores = None
        for matcher in self.settings.matchers:
            some = motifs.instance_scores(seeds, context.where(F.col("motif") == matcher.name), k).select(F.lit(matcher.name).alias("motif"), "instance", "score")
            scores = some if scores is None else scores.unionByName(some)
        scores = self.held(scores)
        threshold = topk.order_statistic(scores, "score", self.settings.keep_ratio)
        return motifs.selected(context, scores, threshold if threshold is not None else 0.0)

    def build(self) -> Node:
        """Expand level after level; one more level below the last is only scored."""
        level, parents = [self.root], self.background.select(F.lit("").alias("parent"), "term", "tf")
        for n_children in (*self.config.levels, 0):
            if not level:
                break
            stats = self.held(self.stats(level))
            scores = self.held(self.scores(level, stats, parents))
            for node in level:
                node.scores = scores.where(F.col("prefix") == node.prefix).select("term", "score")
                self.expand(node, n_children, stats.where(F.col("prefix") == node.prefix).select("term", "tf", "idf"))
            level, parents = [c for node in level for c in node.children], stats.select(F.col("prefix").alias("parent"), "term", "tf")
        return self.root
