"""The engine's queries by name, each with the SQL that gives the same rows on the same tables.

Floats are rounded to six places on both sides, since sums differ in order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicgrove.functions import text as X
from topicgrove.functions import vectors as V
from topicgrove.operators import clustering, contrast, embedding, graph, motifs, ranking, text_stats, topk, walks
from topicgrove.sources import star
from topicgrove.sources.checkpoints import held
from topicgrove.sources.network import Network, symmetrized, without_typed_edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The star network as common table expressions.
STAR = """
k AS (SELECT p_name, 2000000000 + row_number() OVER (ORDER BY p_name) AS nid FROM (SELECT DISTINCT p_name FROM part)),
kp AS (SELECT 1000000000 + l_orderkey AS p, k.nid AS k, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN part ON l_partkey = p_partkey JOIN k USING (p_name) GROUP BY 1, 2),
pa AS (SELECT 1000000000 + l_orderkey AS p, 3000000000 + l_suppkey AS a, CAST(count(*) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2),
pv AS (SELECT 1000000000 + o_orderkey AS p, 4000000000 + c_nationkey AS v, 1.0E0 AS w FROM orders JOIN customer ON o_custkey = c_custkey),
py AS (SELECT 1000000000 + o_orderkey AS p, 5000000000 + year(o_orderdate) AS y, 1.0E0 AS w FROM orders),
e AS (SELECT p AS src, k AS dst, w FROM kp UNION ALL SELECT p, a, w FROM pa UNION ALL SELECT p, v, w FROM pv UNION ALL SELECT p, y, w FROM py),
u AS (SELECT src, dst, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY 1, 2),
n AS (SELECT 1000000000 + o_orderkey AS nid, 'P' AS node_type, CAST(o_orderkey AS VARCHAR) AS entity_id FROM orders
 UNION ALL SELECT nid, 'K', '<phrase>' || replace(lower(p_name), ' ', '_') || '</phrase>' FROM k
 UNION ALL SELECT 3000000000 + s_suppkey, 'A', s_name FROM supplier
 UNION ALL SELECT 4000000000 + n_nationkey, 'V', n_name FROM nation
 UNION ALL SELECT DISTINCT 5000000000 + year(o_orderdate), 'Y', CAST(year(o_orderdate) AS VARCHAR) FROM orders)
"""
# Term counts by nation below region, and their statistics.
TERMS = """
d AS (SELECT '0/' || n_regionkey || '/' || n_nationkey AS prefix, '0/' || n_regionkey AS parent, o_orderkey AS doc_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 2.0E0 ELSE 1.0E0 END AS weight FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
c AS (SELECT l_orderkey AS doc_id, p_name AS term, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
dc AS (SELECT d.*, c.term, coalesce(c.n, 0) AS n FROM d LEFT JOIN c USING (doc_id))
"""


def _stats(group: str, weight: str) -> str:
    keys = f"{group}, " if group else ""
    on = f"USING ({group})" if group else "ON true"
    docs = f"(SELECT {keys}sum(m) AS all_mass, sum(weight) AS all_docs FROM (SELECT {keys}doc_id, max({weight}) AS weight, sum(n * {weight}) AS m FROM dc GROUP BY {keys}doc_id) {f'GROUP BY {group}' if group else ''})"
    return f"SELECT {keys}term, mass / all_mass AS tf, CASE WHEN df > 0 THEN ln(all_docs / df) ELSE 0.0E0 END AS idf FROM (SELECT {keys}term, sum(n * {weight}) AS mass, sum({weight}) AS df FROM dc WHERE term IS NOT NULL GROUP BY {keys}term) JOIN {docs} {on}"


NODE_STATS = f"{TERMS}, t AS (SELECT * FROM ({_stats('prefix', '1.0E0')})), tp AS (SELECT * FROM ({_stats('parent', '1.0E0')})), s AS (SELECT t.prefix, regexp_replace(t.prefix, '/[^/]*$', '') AS parent, t.term, t.tf, t.idf FROM t)"


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql.strip()
        return f

    return register


def r6(c) -> F.Column:
    return F.round(c, 6)


def _net(spark: SparkSession, sf_dir: str) -> Network:
    return star.network(spark, sf_dir)


def _symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symmetrized(star.edges(spark, sf_dir))


# --- network ---------------------------------------------------------------------------------------------------------
@query("graph_node_type_counts", f"WITH {STAR} SELECT node_type, count(*) AS n FROM n GROUP BY 1")
def node_type_counts(spark, sf_dir):
    return graph.type_counts(star.nodes(spark, sf_dir))


@query("graph_edge_dedupe_sum", "SELECT 1000000000 + l_orderkey AS src, 3000000000 + l_suppkey AS dst, CAST(sum(l_quantity) AS DOUBLE) AS w FROM lineitem GROUP BY 1, 2")
def edge_dedupe_sum(spark, sf_dir):
    lines = star.table(spark, sf_dir, "lineitem")
    return graph.summed(lines.select(star.nid("P", F.col("l_orderkey")).alias("src"), star.nid("A", F.col("l_suppkey")).alias("dst"), F.col("l_quantity").alias("w")))


@query("graph_symmetrize", f"WITH {STAR} SELECT src, dst, w FROM u")
def symmetrize(spark, sf_dir):
    return _symmetric(spark, sf_dir)


@query("graph_drop_same_type_edges", f"WITH {STAR} SELECT src, dst, w FROM u WHERE NOT (src BETWEEN 1000000000 AND 1999999999 AND dst BETWEEN 2000000000 AND 2999999999)")
def drop_same_type(spark, sf_dir):
    # papers and terms under one type, so that their edges are those between two nodes of a type
    nodes = star.nodes(spark, sf_dir).withColumn("node_type", F.when(F.col("node_type") == "K", "P").otherwise(F.col("node_type")))
    kept = without_typed_edges(star.edges(spark, sf_dir), nodes, "P")
    back = star.edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return kept.unionByName(back)


@query("graph_degree", f"WITH {STAR} SELECT src, count(*) AS degree, CAST(sum(w) AS DOUBLE) AS strength FROM u GROUP BY 1")
def degree(spark, sf_dir):
    return graph.degrees(_symmetric(spark, sf_dir))


@query("entity_lookup_left", f"WITH {STAR} SELECT w.node_type, w.entity_id, x.nid FROM (SELECT 'A' AS node_type, c_name AS entity_id FROM customer UNION ALL SELECT 'V', n_name FROM nation) w LEFT JOIN (SELECT node_type, entity_id, max(nid) AS nid FROM n GROUP BY 1, 2) x USING (node_type, entity_id)")
def entity_lookup(spark, sf_dir):
    wanted = star.table(spark, sf_dir, "customer").select(F.lit("A").alias("node_type"), F.col("c_name").alias("entity_id"))
    wanted = wanted.unionByName(star.table(spark, sf_dir, "nation").select(F.lit("V").alias("node_type"), F.col("n_name").alias("entity_id")))
    return graph.lookup(star.nodes(spark, sf_dir), wanted)


@query("neighbors_by_type", f"WITH {STAR} SELECT src, dst, w FROM u WHERE src BETWEEN 2000000000 AND 2999999999 AND dst BETWEEN 1000000000 AND 1999999999")
def neighbors_by_type(spark, sf_dir):
    nodes = star.nodes(spark, sf_dir)
    return graph.neighbors(_symmetric(spark, sf_dir), graph.of_type(nodes, "K"), nodes, "P")


@query("induced_subgraph_remap", f"WITH {STAR}, m AS (SELECT nid, row_number() OVER (ORDER BY nid) - 1 AS new FROM n WHERE node_type IN ('P', 'K')) SELECT a.new AS src, b.new AS dst, w FROM e JOIN m a ON e.src = a.nid JOIN m b ON e.dst = b.nid")
def induced_subgraph(spark, sf_dir):
    net = _net(spark, sf_dir)
    return graph.subgraph(net, net.nodes.where(F.col("node_type").isin("P", "K"))).edges


@query("type_matrix_slice", f"WITH {STAR} SELECT p AS src, a AS dst, w FROM pa")
def type_matrix_slice(spark, sf_dir):
    return graph.type_slice(_net(spark, sf_dir), "P", "A")


@query("type_positions", f"WITH {STAR} SELECT nid, node_type, row_number() OVER (PARTITION BY node_type ORDER BY nid) - 1 AS position FROM n")
def type_positions(spark, sf_dir):
    return graph.positions(star.nodes(spark, sf_dir)).select("nid", "node_type", F.col("position").cast("long").alias("position"))


@query("metapath_product", f"WITH {STAR} SELECT kp.k AS src, pa.a AS dst, CAST(sum(kp.w * pa.w) AS DOUBLE) AS w FROM kp JOIN pa USING (p) GROUP BY 1, 2")
def metapath_product(spark, sf_dir):
    return graph.path_matrix(_net(spark, sf_dir), "K<-P->A")


KPV_SQL = "kpv AS (SELECT kp.k AS src, pv.v AS dst, CAST(sum(kp.w * pv.w) AS DOUBLE) AS w FROM kp JOIN pv USING (p) GROUP BY 1, 2)"
NORM_SQL = "r AS (SELECT src, sum(w) AS r FROM kpv GROUP BY 1), cs AS (SELECT dst, sum(w) AS c FROM kpv GROUP BY 1), wn AS (SELECT src, dst, w / sqrt(r * c) AS w FROM kpv JOIN r USING (src) JOIN cs USING (dst))"


def _kpv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.path_matrix(_net(spark, sf_dir), "K<-P->V")


@query("sym_normalize", f"WITH {STAR}, {KPV_SQL}, {NORM_SQL} SELECT src, dst, round(w, 6) AS w FROM wn")
def sym_normalize(spark, sf_dir):
    return graph.sym_normalized(_kpv(spark, sf_dir)).withColumn("w", r6("w"))


@query("row_normalize", f"WITH {STAR}, {KPV_SQL} SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM kpv")
def row_normalize(spark, sf_dir):
    return graph.row_normalized(_kpv(spark, sf_dir), "src", "w").select("src", "dst", r6("w").alias("w"))


# --- phrases and prefixes --------------------------------------------------------------------------------------------
@query("phrase_extract", "SELECT p_partkey, '<phrase>' || replace(p_name, ' ', '_') || '</phrase>' AS phrase, 'x' || p_name AS line FROM part")
def phrase_extract(spark, sf_dir):
    line = F.concat(F.lit("in <phrase>"), F.col("p_name"), F.lit("</phrase> we"))
    return star.table(spark, sf_dir, "part").select("p_partkey", F.explode(X.extract_phrases(line)).alias("phrase"), F.concat(F.lit("x"), F.col("p_name")).alias("line"))


@query("phrase_strip", "SELECT p_partkey, p_name AS term FROM part")
def phrase_strip(spark, sf_dir):
    return star.table(spark, sf_dir, "part").select("p_partkey", X.strip_phrase_tags(X.add_phrase_tags(F.col("p_name"))).alias("term"))


@query("phrase_tag", "SELECT p_partkey, '<phrase>' || replace(lower(p_brand || ' ' || p_name), ' ', '_') || '</phrase>' AS term FROM part")
def phrase_tag(spark, sf_dir):
    return star.table(spark, sf_dir, "part").select("p_partkey", X.add_phrase_tags(F.concat_ws(" ", "p_brand", "p_name")).alias("term"))


@query("prefix_parse", "SELECT n_nationkey, n_regionkey AS region, '0/' || n_regionkey AS parent, 2 AS level, '0_' || n_regionkey || '_' || n_nationkey AS safe FROM nation")
def prefix_parse(spark, sf_dir):
    prefix = F.concat_ws("/", F.lit("0"), F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"))
    rows = star.table(spark, sf_dir, "nation").select("n_nationkey", prefix.alias("x"))
    return rows.select("n_nationkey", F.get(X.parse_prefix(F.col("x")), 1).alias("region"), X.parent_prefix(F.col("x")).alias("parent"), X.level_of(F.col("x")).alias("level"), X.file_safe(F.col("x")).alias("safe"))


@query("year_period", "SELECT o_orderkey, CASE WHEN y < 2020 THEN greatest((y // 5 + 1) * 5, 1965) END::INT AS period FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)")
def year_period(spark, sf_dir):
    return star.table(spark, sf_dir, "orders").select("o_orderkey", X.period_of(F.year("o_orderdate")).alias("period"))


# --- term statistics and contrast ------------------------------------------------------------------------------------
@query("tfidf_unweighted", f"WITH {TERMS} SELECT prefix, term, round(tf, 6) AS tf, round(idf, 6) AS idf FROM ({_stats('prefix', '1.0E0')})")
def tfidf_unweighted(spark, sf_dir):
    counts = star.doc_terms(spark, sf_dir).withColumn("weight", F.lit(1.0))
    return text_stats.tf_idf(counts, "prefix").select("prefix", "term", r6("tf").alias("tf"), r6("idf").alias("idf"))


@query("tfidf_weighted", f"WITH {TERMS} SELECT term, round(tf, 6) AS tf, round(idf, 6) AS idf FROM ({_stats('', 'weight')})")
def tfidf_weighted(spark, sf_dir):
    return text_stats.tf_idf(star.doc_terms(spark, sf_dir)).select("term", r6("tf").alias("tf"), r6("idf").alias("idf"))


@query(
    "tfidf_background_smoothed",
    f"WITH {TERMS} SELECT x.term, round((coalesce(n, 0) + 1.0E0) / all_n, 6) AS tf, round(CASE WHEN df > 0 THEN ln(docs / CAST(df AS DOUBLE)) ELSE 0.0E0 END, 6) AS idf FROM (SELECT DISTINCT p_name AS term FROM part UNION SELECT DISTINCT p_brand FROM part) x LEFT JOIN (SELECT term, sum(n) AS n, count(*) AS df FROM dc WHERE term IS NOT NULL GROUP BY 1) y USING (term), (SELECT sum(n) AS all_n, count(DISTINCT doc_id) AS docs FROM dc)",
)
def tfidf_background(spark, sf_dir):
    part = star.table(spark, sf_dir, "part")
    listed = part.select(F.col("p_name").alias("term")).union(part.select("p_brand"))
    return text_stats.background_tf_idf(star.doc_terms(spark, sf_dir), listed).select("term", r6("tf").alias("tf"), r6("idf").alias("idf"))


@query("distinct_terms", "SELECT DISTINCT p_name AS term FROM lineitem JOIN part ON l_partkey = p_partkey")
def distinct_terms(spark, sf_dir):
    return text_stats.distinct_terms(star.doc_terms(spark, sf_dir))


def _node_stats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(prefix, parent, term, tf, idf) and (parent, term, tf, idf): documents are counted once, parents rolled up from their nodes."""
    counts = held(star.doc_terms(spark, sf_dir).withColumn("weight", F.lit(1.0)))
    sums = held(text_stats.term_sums(counts, "prefix", "parent"))
    totals = held(text_stats.group_totals(counts, "prefix", "parent"))
    return text_stats.from_sums(sums, totals, "prefix", "parent"), text_stats.from_sums(*text_stats.rolled_up(sums, totals, "parent"), "parent")


def _contrast_sql(siblings: bool, a: float, b: float) -> str:
    sib = "LEFT JOIN (SELECT x.prefix, x.term, max(y.tf) AS m FROM s x JOIN s y ON x.parent = y.parent AND x.term = y.term AND x.prefix <> y.prefix GROUP BY 1, 2) z ON z.prefix = s.prefix AND z.term = s.term" if siblings else ""
    ratio = "least(s.tf / tp.tf, s.tf / z.m)" if siblings else "s.tf / tp.tf"
    return f"WITH {NODE_STATS} SELECT s.prefix, s.term, round({ratio}, 6) AS distinct_ratio, round({ratio} * pow(s.tf, {a!r}) * pow(s.idf, {b!r}), 6) AS score FROM s JOIN tp ON tp.parent = s.parent AND tp.term = s.term {sib}"


@query("contrast_node_parent", _contrast_sql(False, 1.5, 1.5))
def contrast_node_parent(spark, sf_dir):
    found = contrast.node_contrast(*_node_stats(spark, sf_dir), 1.5, 1.5, siblings=False)
    return found.select("prefix", "term", r6("distinct_ratio").alias("distinct_ratio"), r6("score").alias("score"))


@query("contrast_node_siblings", _contrast_sql(True, 1.0, 1.0))
def contrast_node_siblings(spark, sf_dir):
    found = contrast.node_contrast(*_node_stats(spark, sf_dir), 1.0, 1.0)
    return found.select("prefix", "term", r6("distinct_ratio").alias("distinct_ratio"), r6("score").alias("score"))


@query("contrast_level_decay", _contrast_sql(True, X.decayed(1.5, 2), X.decayed(1.5, 2)))
def contrast_level_decay(spark, sf_dir):
    found = contrast.node_contrast(*_node_stats(spark, sf_dir), X.decayed(1.5, 2), X.decayed(1.5, 2))
    return found.select("prefix", "term", r6("distinct_ratio").alias("distinct_ratio"), r6("score").alias("score"))


@query("contrast_cluster", f"WITH {TERMS}, t AS (SELECT * FROM ({_stats('parent', '1.0E0')})), l AS (SELECT * FROM ({_stats('', '1.0E0')})) SELECT t.parent, t.term, round(t.tf / l.tf * pow(t.tf, 1.5E0) * pow(t.idf, 1.5E0), 6) AS score FROM t JOIN l USING (term)")
def contrast_cluster(spark, sf_dir):
    counts = star.doc_terms(spark, sf_dir).withColumn("weight", F.lit(1.0))
    found = contrast.cluster_contrast(text_stats.tf_idf(counts, "parent"), text_stats.tf_idf(counts), 1.5, 1.5, "parent")
    return found.select("parent", "term", r6("score").alias("score"))


# --- top-k ------------------------------------------------------------------------------------------------------------
@query("topk_global", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk_global(spark, sf_dir):
    return topk.top_k(star.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 50, "o_orderkey")


@query("topk_per_node", f"WITH {NODE_STATS} SELECT prefix, term, rank FROM (SELECT prefix, term, CAST(row_number() OVER (PARTITION BY prefix ORDER BY round(tf, 9) DESC, term) AS INT) AS rank FROM s) WHERE rank <= 20")
def topk_per_node(spark, sf_dir):
    own = _node_stats(spark, sf_dir)[0].withColumn("tf", F.round("tf", 9))
    return topk.top_k_by(own, ["prefix"], "tf", 20, "term").select("prefix", "term", "rank")


@query("candidate_cut", "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i, count(*) OVER () AS n FROM orders) WHERE i <= least(500, floor(0.2E0 * n))")
def candidate_cut(spark, sf_dir):
    orders = star.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return topk.top_k(orders, "o_totalprice", topk.candidate_cut(orders.count()), "o_orderkey")


@query("order_stat_threshold", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT o_totalprice FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC) AS i, count(*) OVER () AS n FROM orders) WHERE i = floor(0.2E0 * n) + 1)")
def order_stat_threshold(spark, sf_dir):
    orders = star.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.where(F.col("o_totalprice") > topk.order_statistic(orders, "o_totalprice", 0.2)).select("o_orderkey")


# --- documents of clusters, replicas ---------------------------------------------------------------------------------
@query("cluster_documents", f"WITH {STAR} SELECT substr(p_name, 1, instr(p_name, ' ') - 1) AS label, kp.p AS doc, CAST(sum(kp.w) AS DOUBLE) AS weight FROM kp JOIN k ON kp.k = k.nid GROUP BY 1, 2")
def cluster_documents(spark, sf_dir):
    labels = star.terms(spark, sf_dir).select(F.col("nid").alias("term"), F.substring_index("p_name", " ", 1).alias("label"))
    links = motifs.term_documents(_net(spark, sf_dir)).select(F.col("src").alias("term"), F.col("dst").alias("doc"), "w")
    return clustering.cluster_documents(labels, links)


RESCALE = "SELECT c_custkey, CAST(CASE WHEN hi > lo THEN floor(1 + 9 * ((c_acctbal - lo) / (hi - lo))) ELSE 1 END AS INT) AS replicas FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)"


@query("rescale_weights_1_10", RESCALE)
def rescale_weights(spark, sf_dir):
    return text_stats.rescaled(star.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "replicas")


@query("replicate_corpus", f"SELECT c_custkey, CAST(unnest(range(1, replicas + 1)) AS INT) AS copy FROM ({RESCALE})")
def replicate_corpus(spark, sf_dir):
    return text_stats.replicated(rescale_weights(spark, sf_dir)).select("c_custkey", "copy")


# --- motifs -----------------------------------------------------------------------------------------------------------
def _motif(matcher: motifs.Matcher) -> Query:
    return lambda spark, sf_dir: matcher.match(_net(spark, sf_dir))


def _motif_of_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a node are its urgent orders, its terms the names of small parts."""
    urgent = star.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(star.nid("P", F.col("o_orderkey")).alias("nid"))
    small = star.terms(spark, sf_dir).join(star.table(spark, sf_dir, "part").where("p_size <= 25").select("p_name"), "p_name", "left_semi").select("nid")
    return motifs.TermAuthor().match(_net(spark, sf_dir), urgent, small)


PAIRS = "pr AS (SELECT x.p, x.a AS a1, y.a AS a2 FROM pa x JOIN pa y ON x.p = y.p AND x.a < y.a), fp AS (SELECT a1, a2, count(*) AS n FROM pr GROUP BY 1, 2 HAVING count(*) >= 5)"
query("motif_kp", f"WITH {STAR} SELECT 'KP' AS motif, k AS term, CAST(p AS VARCHAR) AS instance, w FROM kp")(_motif(motifs.TermPaper()))
query("motif_kpv", f"WITH {STAR}, {KPV_SQL} SELECT 'KPV' AS motif, src AS term, CAST(dst AS VARCHAR) AS instance, w FROM kpv")(_motif(motifs.TermVenue()))
query("motif_kpa", f"WITH {STAR} SELECT 'KPA' AS motif, kp.k AS term, CAST(pa.a AS VARCHAR) AS instance, CAST(sum(kp.w * pa.w) AS DOUBLE) AS w FROM kp JOIN pa USING (p) GROUP BY 1, 2, 3")(_motif(motifs.TermAuthor()))
query("motif_kpa_of_node", f"WITH {STAR}, dn AS (SELECT 1000000000 + o_orderkey AS p FROM orders WHERE o_orderpriority = '1-URGENT'), tn AS (SELECT DISTINCT k.nid AS k FROM part JOIN k USING (p_name) WHERE p_size <= 25) SELECT 'KPA' AS motif, kp.k AS term, CAST(pa.a AS VARCHAR) AS instance, CAST(sum(kp.w * pa.w) AS DOUBLE) AS w FROM kp JOIN pa USING (p) WHERE kp.p IN (SELECT p FROM dn) AND kp.k IN (SELECT k FROM tn) GROUP BY 1, 2, 3")(_motif_of_node)
query("motif_kpvy", f"WITH {STAR} SELECT 'KPVY' AS motif, kp.k AS term, v || ' ' || greatest(((y - 5000000000) // 5 + 1) * 5, 1965) AS instance, CAST(count(*) AS DOUBLE) AS w FROM kp JOIN pv USING (p) JOIN py USING (p) WHERE y < 5000002020 GROUP BY 1, 2, 3")(_motif(motifs.TermVenuePeriod()))
query("motif_kpaa", f"WITH {STAR}, {PAIRS} SELECT 'KPAA' AS motif, kp.k AS term, a1 || ' - ' || a2 AS instance, CAST(count(DISTINCT p) AS DOUBLE) AS w FROM kp JOIN pr USING (p) JOIN fp USING (a1, a2) GROUP BY 1, 2, 3")(_motif(motifs.TermAuthorPair()))
query(
    "motif_kpaa_strict",
    f"WITH {STAR}, {PAIRS}, o AS (SELECT src AS p, dst AS nid, row_number() OVER (PARTITION BY src ORDER BY dst) AS i, count(*) OVER (PARTITION BY src) AS n FROM e) SELECT 'KPAA' AS motif, kp.k AS term, a1 || ' - ' || a2 AS instance, CAST(sum(x.n - greatest(x.i, y.i, z.i) + 1) AS DOUBLE) AS w FROM kp JOIN pr USING (p) JOIN fp USING (a1, a2) JOIN o x ON x.p = kp.p AND x.nid = kp.k JOIN o y ON y.p = kp.p AND y.nid = a1 JOIN o z ON z.p = kp.p AND z.nid = a2 GROUP BY 1, 2, 3",
)(_motif(motifs.TermAuthorPair(strict=True)))


@query("freq_pairs", f"WITH {STAR}, {PAIRS} SELECT a1, a2, n FROM fp")
def freq_pairs(spark, sf_dir):
    return motifs.frequent_pairs(motifs.author_pairs(_net(spark, sf_dir)))


# --- rankings ---------------------------------------------------------------------------------------------------------
SEEDS_SQL = "sd AS (SELECT nid AS src, substr(p_name, 1, instr(p_name, ' ') - 1) AS cluster FROM k)"


def _authority_sql(rounds: int) -> str:
    steps = ["a0 AS (SELECT cluster, src, 1.0E0 AS a FROM sd)"]
    for i in range(1, rounds + 1):
        steps.append(f"b{i} AS (SELECT cluster, dst, sum(a * w) AS b FROM a{i - 1} JOIN wn USING (src) GROUP BY 1, 2)")
        steps.append(f"a{i} AS (SELECT cluster, src, sum(b * w) AS a FROM b{i} JOIN wn USING (dst) GROUP BY 1, 2)")
    return ", ".join(steps) + f", s{rounds} AS (SELECT cluster, dst, b / sum(b) OVER (PARTITION BY cluster) AS score FROM b{rounds})"


AUTHORITY = f"WITH {STAR}, {KPV_SQL}, {NORM_SQL}, {SEEDS_SQL}, "


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.terms(spark, sf_dir).select(F.substring_index("p_name", " ", 1).alias("cluster"), F.col("nid").alias("term"))


def _authority(rounds: int) -> Query:
    def run(spark, sf_dir):
        context = motifs.TermVenue().match(_net(spark, sf_dir))
        found = motifs.propagated(_seeds(spark, sf_dir), context, rounds)
        return found.select("cluster", F.col("instance").cast("long").alias("dst"), r6("score").alias("score"))

    return run


query("authority_bipartite_1iter", f"{AUTHORITY}{_authority_sql(1)} SELECT cluster, dst, round(score, 6) AS score FROM s1")(_authority(1))
query("authority_bipartite_4iter", f"{AUTHORITY}{_authority_sql(4)} SELECT cluster, dst, round(score, 6) AS score FROM s4")(_authority(4))

SCORES_SQL = f"{AUTHORITY}{_authority_sql(4)}, s1 AS (SELECT cluster, dst, b / sum(b) OVER (PARTITION BY cluster) AS score FROM b1), kk AS (SELECT count(DISTINCT cluster) AS k FROM sd), me AS (SELECT dst, sum(score) / max(k) AS mean FROM s4, kk GROUP BY 1), en AS (SELECT dst, 1 + sum(q * ln(q)) / max(ln(k)) AS sure FROM (SELECT dst, score / sum(score) OVER (PARTITION BY dst) AS q FROM s1), kk GROUP BY 1), fs AS (SELECT dst, round(mean * sure, 9) AS score FROM me JOIN en USING (dst))"


def _instance_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    context = held(motifs.TermVenue().match(_net(spark, sf_dir)))
    seeds = held(_seeds(spark, sf_dir))
    k = seeds.select("cluster").distinct().count()
    scores = motifs.instance_scores(seeds, context, k).select(F.lit("KPV").alias("motif"), "instance", F.round("score", 9).alias("score"))
    return context, scores


@query("motif_instance_score", f"{SCORES_SQL} SELECT CAST(dst AS VARCHAR) AS instance, round(score, 6) AS score FROM fs")
def motif_instance_score(spark, sf_dir):
    return _instance_scores(spark, sf_dir)[1].select("instance", r6("score").alias("score"))


@query("motif_selected", f"{SCORES_SQL} SELECT src AS term, CAST(dst AS VARCHAR) AS instance, w FROM kpv JOIN fs USING (dst) WHERE score > (SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS i, count(*) OVER () AS n FROM fs) WHERE i = floor(0.2E0 * n) + 1)")
def motif_selected(spark, sf_dir):
    context, scores = _instance_scores(spark, sf_dir)
    scores = scores.persist()
    return motifs.selected(context, scores, topk.order_statistic(scores, "score", 0.2)).select("term", "instance", "w")


def _ppr_sql(damping: float, rounds: int, reset: str) -> str:
    steps = [f"rs AS MATERIALIZED ({reset})", "um AS MATERIALIZED (SELECT src, dst, 1.0E0 / count(*) OVER (PARTITION BY src) AS share FROM u)", "p0 AS MATERIALIZED (SELECT * FROM rs)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"i{i} AS MATERIALIZED (SELECT cluster, dst AS nid, sum(p * share) AS q FROM p{i - 1} JOIN um ON um.src = p{i - 1}.nid GROUP BY 1, 2), "
            f"l{i} AS MATERIALIZED (SELECT cluster, total - coalesce(moved, 0.0E0) AS lost FROM (SELECT cluster, sum(p) AS total FROM p{i - 1} GROUP BY 1) LEFT JOIN (SELECT cluster, sum(q) AS moved FROM i{i} GROUP BY 1) USING (cluster)), "
            f"p{i} AS MATERIALIZED (SELECT cluster, nid, {1 - damping!r} * coalesce(p, 0.0E0) + {damping!r} * (coalesce(q, 0.0E0) + lost * coalesce(p, 0.0E0)) AS p FROM i{i} FULL JOIN rs USING (cluster, nid) JOIN l{i} USING (cluster))"
        )
    return f"WITH {STAR}, {SEEDS_SQL}, " + ", ".join(steps)


ALL_RESET = "SELECT 0 AS cluster, nid, 1.0E0 / count(*) OVER () AS p FROM (SELECT DISTINCT src AS nid FROM u)"
SEED_RESET = "SELECT cluster, src AS nid, 1.0E0 / count(*) OVER (PARTITION BY cluster) AS p FROM sd"


@query("pagerank_n10", f"{_ppr_sql(0.85, 10, ALL_RESET)} SELECT nid, round(p * 1E6, 3) AS p FROM p10")
def pagerank_n10(spark, sf_dir):
    return ranking.pagerank(_symmetric(spark, sf_dir), 0.85, 10).select("nid", F.round(F.col("p") * 1e6, 3).alias("p"))


def _seed_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.uniform_reset(_seeds(spark, sf_dir).withColumnRenamed("term", "nid"))


@query("ppr_n10", f"{_ppr_sql(0.85, 10, SEED_RESET)} SELECT cluster, nid, round(p * 1E6, 3) AS p FROM p10")
def ppr_n10(spark, sf_dir):
    found = ranking.personalized_pagerank(_symmetric(spark, sf_dir), _seed_reset(spark, sf_dir), 0.85, 10)
    return found.select("cluster", "nid", F.round(F.col("p") * 1e6, 3).alias("p"))


MEMBERS = f"{_ppr_sql(0.8, 10, SEED_RESET)}, mb AS (SELECT cluster, nid, p / sum(p) OVER (PARTITION BY nid) AS p FROM p10)"


@query("ppr_membership", f"{MEMBERS} SELECT cluster, nid, round(p, 6) AS p FROM mb")
def ppr_membership(spark, sf_dir):
    return ranking.membership(_symmetric(spark, sf_dir), _seed_reset(spark, sf_dir)).select("cluster", "nid", r6("p").alias("p"))


@query("doc_assignment", f"{MEMBERS} SELECT cluster, nid FROM mb WHERE round(p, 9) > 2.0E0 / 8 AND nid BETWEEN 1000000000 AND 1999999999")
def doc_assignment(spark, sf_dir):
    members = ranking.membership(_symmetric(spark, sf_dir), _seed_reset(spark, sf_dir)).withColumn("p", F.round("p", 9))
    return ranking.assigned(members, 8).where(F.col("nid").between(1_000_000_000, 1_999_999_999)).select("cluster", "nid")


# --- words -------------------------------------------------------------------------------------------------------------
WORDS = "w AS (SELECT w AS word, count(*) AS cn FROM (SELECT unnest(list_append(list_filter(regexp_split_to_array(replace(text, chr(13), ''), '[ \\t]+'), lambda x: x <> ''), '</s>')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)) GROUP BY 1)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("text"))


@query("vocab_counts", f"WITH {WORDS} SELECT word, cn FROM w")
def vocab_counts(spark, sf_dir):
    return text_stats.word_counts(_lines(spark, sf_dir))


@query("vocab_pruned", f"WITH {WORDS} SELECT word, cn, row_number() OVER (ORDER BY word <> '</s>', cn DESC, word) - 1 AS idx FROM w WHERE cn >= 2 OR word = '</s>'")
def vocab_pruned(spark, sf_dir):
    kept = text_stats.ranked(text_stats.pruned(text_stats.word_counts(_lines(spark, sf_dir))))
    return kept.select("word", "cn", F.col("idx").cast("long").alias("idx"))


@query("subsample_keep_prob", f"WITH {WORDS}, v AS (SELECT word, cn, cn / (1e-4 * sum(cn) OVER ()) AS q FROM w WHERE cn >= 2 OR word = '</s>') SELECT word, round((sqrt(q) + 1) / q, 6) AS keep_p FROM v")
def subsample_keep_prob(spark, sf_dir):
    kept = text_stats.pruned(text_stats.word_counts(_lines(spark, sf_dir)))
    return text_stats.keep_probabilities(kept).select("word", r6("keep_p").alias("keep_p"))


@query("unigram75", f"WITH {WORDS}, v AS (SELECT word, cn, pow(cn, 0.75E0) AS m FROM w WHERE cn >= 2 OR word = '</s>') SELECT word, round(m / sum(m) OVER () * 1E6, 3) AS p, round(sum(m) OVER (ORDER BY cn DESC, word ROWS UNBOUNDED PRECEDING) / sum(m) OVER () * 1E3, 3) AS upto FROM v")
def unigram75(spark, sf_dir):
    kept = text_stats.pruned(text_stats.word_counts(_lines(spark, sf_dir)))
    return text_stats.noise_distribution(kept).select("word", F.round(F.col("p") * 1e6, 3).alias("p"), F.round(F.col("upto") * 1e3, 3).alias("upto"))


@query(
    "skipgram_pairs",
    "WITH x AS (SELECT o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey) AS i, p_name AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey) SELECT a.doc_id, a.t AS center, b.t AS context, count(*) AS n FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.i <> b.i AND abs(a.i - b.i) <= 2 GROUP BY 1, 2, 3",
)
def skipgram_pairs(spark, sf_dir):
    lines = star.table(spark, sf_dir, "lineitem").join(star.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    words = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name")))
    docs = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(words, lambda s: s["p_name"]).alias("words"))
    return text_stats.skipgram_pairs(docs, 2)


# --- vectors -----------------------------------------------------------------------------------------------------------
def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("term"), V.doubles(F.col("embedding")).alias("vec"), "label")


DIM = "x AS (SELECT vec_id AS term, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), cm AS (SELECT label AS cluster, i, avg(x) AS m FROM x GROUP BY 1, 2), cu AS (SELECT cluster, i, m / sqrt(sum(m * m) OVER (PARTITION BY cluster)) AS m FROM cm)"


def _centroids(vectors: DataFrame) -> DataFrame:
    """(cluster, mu): unit means of the labels."""
    each = vectors.select(F.col("label").alias("cluster"), F.posexplode("vec").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m"))
    means = each.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s"))
    return means.select("cluster", V.unit(F.transform("s", lambda s: s["m"])).alias("mu"))


@query("vec_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 6) AS norm FROM embeddings")
def vec_norm(spark, sf_dir):
    return _vectors(spark, sf_dir).select(F.col("term").alias("vec_id"), r6(V.norm(F.col("vec"))).alias("norm"))


@query("vec_cosine_to_centroid", f"WITH {DIM} SELECT term, cluster, round(sum(x.x * cu.m), 6) AS cosine FROM x JOIN cu USING (i) GROUP BY 1, 2")
def vec_cosine(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    scored = rows.crossJoin(F.broadcast(_centroids(rows)))  # a row a label
    return scored.select("term", "cluster", r6(V.dot(F.col("vec"), F.col("mu"))).alias("cosine"))


#: A mixture whose concentrations and weights differ: kappa = 10 + label, weight in proportion to label + 1.
MIXTURE_SQL = f"{DIM}, kp AS (SELECT DISTINCT label AS cluster, 10.0E0 + label AS kappa, label + 1.0E0 AS wt FROM embeddings), dm AS (SELECT max(len(embedding)) AS d FROM embeddings), bs AS (SELECT cluster, max(kappa) AS kappa, max(wt) AS wt, max((d / 2.0E0 - 1) * ln(kappa)) - ln(sum(exp((2 * m + d / 2.0E0 - 1) * ln(kappa / 2) - lgamma(m + 1.0E0) - lgamma(m + d / 2.0E0)))) AS c FROM kp, dm, (SELECT unnest(range(0, 120)) AS m) GROUP BY 1), nx AS (SELECT term, i, x / sqrt(sum(x * x) OVER (PARTITION BY term)) AS x FROM x), lj AS (SELECT term, cluster, max(ln(wt) + c) + sum(kappa * nx.x * cu.m) AS j FROM nx JOIN cu USING (i) JOIN bs USING (cluster) GROUP BY 1, 2), ex AS (SELECT term, cluster, exp(j - max(j) OVER (PARTITION BY term)) AS e FROM lj)"


@query("vmf_posterior_fixed_params", f"WITH {MIXTURE_SQL} SELECT term, cluster, round(e / sum(e) OVER (PARTITION BY term), 6) AS p FROM ex")
def vmf_fixed(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    centers = sorted(_centroids(rows).collect())  # labels x dimensions
    labels, weights = [r["cluster"] for r in centers], np.array([r["cluster"] + 1.0 for r in centers])
    mixture = clustering.Mixture(np.array([r["mu"] for r in centers]), weights / weights.sum(), np.array([10.0 + x for x in labels]))
    found = clustering.posteriors(rows, mixture)
    return found.select("term", F.get(F.array(*map(F.lit, labels)), F.col("cluster")).alias("cluster"), r6("p").alias("p"))


NEAREST = f"{DIM}, d AS (SELECT term, cluster, round(sum(x.x * cu.m), 9) AS c FROM x JOIN cu USING (i) GROUP BY 1, 2), na AS (SELECT term, cluster AS b FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY c DESC, cluster) AS i FROM d) WHERE i = 1), la AS (SELECT vec_id AS term, label AS a FROM embeddings)"


def _two_labelings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _vectors(spark, sf_dir)
    scored = rows.crossJoin(F.broadcast(_centroids(rows))).select("term", "cluster", F.round(V.dot(F.col("vec"), F.col("mu")), 9).alias("c"))
    nearest = scored.withColumn("i", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("c"), "cluster"))).where("i = 1")
    return rows.select("term", "label"), nearest.select("term", F.col("cluster").alias("label"))


@query("jaccard_clusters", f"WITH {NEAREST} SELECT a, b, round(coalesce(n, 0) / CAST(na_ + nb_ - coalesce(n, 0) AS DOUBLE), 6) AS jaccard FROM (SELECT a, count(*) AS na_ FROM la GROUP BY 1) CROSS JOIN (SELECT b, count(*) AS nb_ FROM na GROUP BY 1) LEFT JOIN (SELECT a, b, count(*) AS n FROM la JOIN na USING (term) GROUP BY 1, 2) USING (a, b)")
def jaccard_clusters(spark, sf_dir):
    return clustering.overlaps(*_two_labelings(spark, sf_dir)).select("a", "b", r6("jaccard").alias("jaccard"))


JACCARD = f"{NEAREST}, jc AS (SELECT a, b, coalesce(n, 0) / CAST(na_ + nb_ - coalesce(n, 0) AS DOUBLE) AS jaccard FROM (SELECT a, count(*) AS na_ FROM la GROUP BY 1) CROSS JOIN (SELECT b, count(*) AS nb_ FROM na GROUP BY 1) LEFT JOIN (SELECT a, b, count(*) AS n FROM la JOIN na USING (term) GROUP BY 1, 2) USING (a, b)), pf AS (SELECT a, row_number() OVER (ORDER BY a) AS i, list(b ORDER BY round(jaccard, 9) DESC, b) AS bs FROM jc GROUP BY a), al(i, a, b, used) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS INT), CAST(NULL AS INT), CAST([] AS INT[]) UNION ALL SELECT pf.i, CAST(pf.a AS INT), CAST(list_filter(bs, lambda y: NOT list_contains(used, CAST(y AS INT)))[1] AS INT), list_append(used, CAST(list_filter(bs, lambda y: NOT list_contains(used, CAST(y AS INT)))[1] AS INT)) FROM al JOIN pf ON pf.i = al.i + 1)"


@query("cluster_intersection", f"WITH RECURSIVE {JACCARD} SELECT la.term, la.a AS label FROM la JOIN na USING (term) JOIN al ON al.a = la.a AND al.b = na.b")
def cluster_intersection(spark, sf_dir):
    a, b = _two_labelings(spark, sf_dir)
    return clustering.agreed(a, b, clustering.aligned(a, b))


@query("cluster_align", f"WITH RECURSIVE {JACCARD} SELECT a, b FROM al WHERE i > 0")
def cluster_align(spark, sf_dir):
    a, b = _two_labelings(spark, sf_dir)
    return spark.createDataFrame(sorted(clustering.aligned(a, b).items()), "a int, b int")


@query("spherical_kmeans")
def spherical_kmeans(spark, sf_dir):
    return clustering.spherical_kmeans(_vectors(spark, sf_dir), 10)


@query("vmf_fit")
def vmf_fit(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return clustering.posteriors(rows, clustering.fit_vmf(rows, 10)).select("term", "cluster", r6("p").alias("p"))


@query("sgns_train")
def sgns_train(spark, sf_dir):
    lines = star.table(spark, sf_dir, "lineitem").join(star.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    text = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))), lambda s: F.translate(s["p_name"], " ", "_")), " ").alias("text"))
    return embedding.Sgns(dim=16, epochs=2).fit(text.select("text"))


# --- walks -------------------------------------------------------------------------------------------------------------
def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.terms(spark, sf_dir).select(F.col("nid").alias("walk"), "nid")


def _u(*keys: str) -> str:
    """The draw of ``text.uniform`` in SQL."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 13) AS BIGINT) / 4503599627370496.0E0)"


def _walks_sql(index: str, starts: str, steps: int, hop: str, back: str, damping: float = 0.8) -> str:
    made = [f"ix AS MATERIALIZED ({index})", f"w0 AS MATERIALIZED ({starts})"]
    for i in range(1, steps):
        here = f"w{i - 1}"
        goes = f"(SELECT *, {_u('walk', str(i), '0')} AS d FROM {here} WHERE {_u('walk', str(i), '1')} < {damping!r}) h"
        made.append(f"w{i} AS MATERIALIZED (SELECT walk, start, ix.dst AS src FROM {goes} JOIN ix ON ix.src = h.src AND {hop} UNION ALL {back.format(here=here, stays=f'NOT ({_u("walk", str(i), "1")} < {damping!r})', i=i)})")
    every = " UNION ALL ".join(f"SELECT walk, {i} AS step, src AS nid FROM w{i}" for i in range(steps))
    return f"WITH {STAR}, " + ", ".join(made) + f", ww AS ({every})"


PLACES = "SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS at, count(*) OVER (PARTITION BY src) AS n, sum(w) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING) AS hi, w, sum(w) OVER (PARTITION BY src) AS total FROM u"
OWN_START = "SELECT walk, start, start FROM {here} WHERE {stays}"
WALKERS = "SELECT nid AS walk, nid AS start, nid AS src FROM k"
BY_PLACE, BY_WEIGHT = "ix.at = floor(h.d * ix.n)", "h.d * ix.total >= ix.hi - ix.w AND h.d * ix.total < ix.hi"


@query("walks_uniform", f"{_walks_sql(PLACES, WALKERS, 6, BY_PLACE, OWN_START)} SELECT walk, step, nid FROM ww")
def walks_uniform(spark, sf_dir):
    return walks.uniform_walks(_symmetric(spark, sf_dir), _starts(spark, sf_dir), 6)


@query("walks_weighted", f"{_walks_sql(PLACES, WALKERS, 6, BY_WEIGHT, OWN_START)} SELECT walk, step, nid FROM ww")
def walks_weighted(spark, sf_dir):
    return walks.uniform_walks(_symmetric(spark, sf_dir), _starts(spark, sf_dir), 6, weighted=True)


def _metapath_sql(types: list[str], steps: int) -> str:
    made = ["ix AS MATERIALIZED (SELECT src, dst, node_type AS kind, row_number() OVER (PARTITION BY src, node_type ORDER BY dst) - 1 AS at, count(*) OVER (PARTITION BY src, node_type) AS n FROM u JOIN n ON n.nid = u.dst)", f"w0 AS MATERIALIZED ({WALKERS})"]
    for i in range(1, steps):
        made.append(f"w{i} AS MATERIALIZED (SELECT walk, ix.dst AS src FROM (SELECT *, {_u('walk', str(i), '0')} AS d FROM w{i - 1}) h JOIN ix ON ix.src = h.src AND ix.kind = '{types[i % len(types)]}' AND {BY_PLACE})")
    every = " UNION ALL ".join(f"SELECT walk, {i} AS step, src AS nid FROM w{i}" for i in range(steps))
    return f"WITH {STAR}, " + ", ".join(made) + f" SELECT walk, step, nid FROM ({every})"


@query("walks_metapath", _metapath_sql(["K", "P", "A", "P"], 6))
def walks_metapath(spark, sf_dir):
    net = _net(spark, sf_dir)
    return walks.metapath_walks(symmetrized(net.edges), net.nodes, _starts(spark, sf_dir), ["K", "P", "A", "P"], 6)


RESTARTS = "rs AS (SELECT nid, row_number() OVER (ORDER BY nid) AS hi, count(*) OVER () AS total FROM k)"
MC_SQL = _walks_sql(PLACES, "SELECT nid || '/' || j AS walk, nid AS start, nid AS src FROM k, (SELECT unnest(range(0, 10)) AS j)", 10, BY_PLACE, f"SELECT b.walk, b.start, rs.nid FROM (SELECT *, {_u('walk', '{i}', '2')} AS d FROM {{here}} WHERE {{stays}}) b JOIN rs ON b.d * rs.total >= rs.hi - 1 AND b.d * rs.total < rs.hi").replace("ix AS MATERIALIZED", f"{RESTARTS}, ix AS MATERIALIZED", 1)


@query("ppr_mc", f"{MC_SQL} SELECT nid, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 1E6, 3) AS p FROM ww GROUP BY 1")
def ppr_mc(spark, sf_dir):
    """Ten walks of ten nodes from each term, a tenth of the operator's defaults each."""
    reset = star.terms(spark, sf_dir).select("nid", F.lit(1.0).alias("p"))
    return walks.monte_carlo_pagerank(_symmetric(spark, sf_dir), reset, 0.8, 10, 10).select("nid", F.round(F.col("p") * 1e6, 3).alias("p"))


@query(
    "context_samples",
    f"WITH {STAR}, cx AS (SELECT kp.k AS term, CAST(pa.a AS VARCHAR) AS instance FROM kp JOIN pa USING (p) GROUP BY 1, 2), pl AS (SELECT term, instance, row_number() OVER (PARTITION BY term ORDER BY instance) - 1 AS spot, count(*) OVER (PARTITION BY term) AS n FROM cx), dr AS (SELECT term, seq, step, floor({_u(chr(39) + 'KPA' + chr(39), 'term', 'seq', 'step', '0')} * n) AS spot FROM (SELECT DISTINCT term, n FROM pl), (SELECT unnest(range(0, 40)) AS seq), (SELECT unnest(range(0, 4)) AS step)) SELECT 'KPA' AS motif, term, CAST(seq AS INT) AS seq, CAST(step AS INT) AS step, instance FROM dr JOIN pl USING (term, spot)",
)
def context_samples(spark, sf_dir):
    return motifs.sampled_sequences(motifs.TermAuthor().match(_net(spark, sf_dir)), 40, 4)


def _metapath_authority_sql(rounds: int) -> str:
    steps = ["s0 AS (SELECT src, 1.0E0 / count(*) OVER () AS score FROM (SELECT DISTINCT src FROM wn))"]
    for i in range(1, rounds + 1):
        steps.append(f"h{i} AS (SELECT dst, sum(score * w) AS h FROM s{i - 1} JOIN wn USING (src) GROUP BY 1), r{i} AS (SELECT src, sum(h * w) AS q FROM h{i} JOIN wn USING (dst) GROUP BY 1), s{i} AS MATERIALIZED (SELECT src, q / sum(q) OVER () AS score FROM r{i})")
    return f"WITH {STAR}, {KPV_SQL}, {NORM_SQL.replace('r AS', 'rr AS', 1).replace('JOIN r USING', 'JOIN rr USING')}, " + ", ".join(steps) + f" SELECT src, round(score * 1E6, 3) AS score FROM s{rounds}"


@query("metapath_authority", _metapath_authority_sql(10))
def metapath_authority(spark, sf_dir):
    """Ten rounds, without an early end."""
    found = ranking.metapath_authority(_kpv(spark, sf_dir), iterations=10, tolerance=0.0)
    return found.select("src", F.round(F.col("score") * 1e6, 3).alias("score"))


@query("adjacency", f"WITH {STAR} SELECT src, CAST(count(*) AS INT) AS n, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM u GROUP BY 1")
def adjacency(spark, sf_dir):
    lists = graph.adjacency(_symmetric(spark, sf_dir))
    return lists.select("src", F.size("dst").alias("n"), F.array_join(F.col("dst").cast("array<string>"), ",").alias("neighbours"))


@query("subsample_words", f"WITH w0 AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, p_name AS word FROM lineitem JOIN part ON l_partkey = p_partkey), v AS (SELECT word, count(*) / (1e-3 * sum(count(*)) OVER ()) AS q FROM w0 GROUP BY 1) SELECT doc_id, pos, word FROM w0 JOIN v USING (word) WHERE (sqrt(q) + 1) / q >= {_u('doc_id', 'pos', '0')}")
def subsample_words(spark, sf_dir):
    lines = star.table(spark, sf_dir, "lineitem").join(star.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    words = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.col("p_name").alias("word"))
    return text_stats.subsampled(words, words.groupBy("word").agg(F.count("*").alias("cn")), 1e-3)


@query("taxonomy_build")
def taxonomy_build(spark, sf_dir):
    """A small taxonomy over the whole star network: every node's scored terms.

    Smaller than the operator's defaults, so that it ends in a minute: one level of three children, sequences of 5 for
    40, 16 dimensions and one epoch for 100 and 5, three rounds of PageRank for 10, and thresholds of 1 for 2 over the
    number of children. All five motifs, and every document and term.
    """
    from topicgrove.operators.embedding import Sgns
    from topicgrove.plans.taxonomy import Builder, Settings
    from topicgrove.sources.network import Config

    lines = star.table(spark, sf_dir, "lineitem").join(star.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tagged = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))), lambda s: X.add_phrase_tags(s["p_name"]))
    corpus = lines.groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(F.array_join(tagged, " ").alias("text"))
    corpus = corpus.withColumn("phrases", X.extract_phrases(F.col("text")))
    net = _net(spark, sf_dir)
    net = Network(net.nodes, symmetrized(net.edges))
    settings = Settings(candidate_share=0.8, sgns=Sgns(dim=16, epochs=1), sequences=5, pagerank_rounds=3, factor=1.0)
    root = Builder(corpus, net, corpus.select("text", "phrases"), Config("", levels=(3,)), settings).build()
    rows = None
    for node in root.walk():
        if node.scores is not None:
            some = node.scores.select(F.lit(node.prefix).alias("prefix"), "term", r6("score").alias("score"))
            rows = some if rows is None else rows.unionByName(some)
    return rows
