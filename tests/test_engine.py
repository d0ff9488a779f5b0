"""The engine on small hand-made inputs, with the results worked out by hand."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicgrove.functions import text as X
from topicgrove.functions import vectors as V
from topicgrove.operators import clustering, contrast, embedding, graph, motifs, ranking, text_stats, topk, walks
from topicgrove.sources import network, sinks

NODES = """0\tP\tp0
1\tP\tp1
2\tP\tp2\textra\tmore
3\tK\t<phrase>data_mining</phrase>
4\tK\t<phrase>deep_learning</phrase>
5\tA\tann
6\tA\tbob
7\tV\tv1
8\tV\tv2
9\tY\t1999
10\tY\t2021
"""
EDGES = "11 17\n" + "\n".join("0-3 0-5 0-6 0-7 0-9 1-3 1-4 1-5 1-6 1-7 1-9 2-4 2-5 2-8 2-10 0-1 0-3".replace("-", ",").split()).replace(",", " ") + "\nbad line of tokens\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("net")
    (d / "node_info.txt").write_text(NODES)
    (d / "edges.txt").write_text(EDGES)
    (d / "indices.txt").write_text("d1\nd2\nd3\nd1\n")
    (d / "text_documents.txt").write_text("x <phrase>a b</phrase> <phrase>c</phrase>\n\n<phrase>Q r</phrase>\nlast <phrase>z</phrase>\n")
    return str(d)


@pytest.fixture(scope="module")
def net(spark, folder):
    loaded = network.load_graph(spark, folder)
    return network.Network(loaded.nodes.persist(), loaded.edges.persist())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_loader(spark, folder, net):
    nodes = {r["nid"]: r for r in net.nodes.collect()}
    assert nodes[2]["extra"] == ["extra", "more"] and nodes[0]["extra"] == []
    w = {(r["src"], r["dst"]): r["w"] for r in net.edges.collect()}
    assert w[3, 0] == w[0, 3] == 2 and (0, 1) not in w and len(w) == 30
    plain = network.load_graph(spark, folder, keep_weights=False, drop_citations=False)
    assert (1, 0) in {(r["src"], r["dst"]) for r in plain.edges.collect()}
    docs = {r["doc_id"]: list(r["phrases"]) for r in network.load_documents(spark, folder).collect()}
    assert docs == {"d1": ["<phrase>z</phrase>"], "d2": [], "d3": ["<phrase>Q_r</phrase>"]}


def test_motifs(spark, net):
    kp = motifs.TermPaper().match(net)
    assert rows(kp.select("term", "instance", "w")) == [(3, "0", 2.0), (3, "1", 1.0), (4, "1", 1.0), (4, "2", 1.0)]
    kpv = motifs.TermVenue().match(net).select("term", "instance", "w")
    assert rows(kpv) == [(3, "7", 3.0), (4, "7", 1.0), (4, "8", 1.0)]
    kpvy = motifs.TermVenuePeriod().match(net).select("term", "instance", "w")
    assert rows(kpvy) == [(3, "7 2000", 2.0), (4, "7 2000", 1.0)]
    pairs = motifs.TermAuthorPair(2).match(net).select("term", "instance", "w")
    assert rows(pairs) == [(3, "5 - 6", 2.0), (4, "5 - 6", 1.0)]
    strict = motifs.TermAuthorPair(2, strict=True).match(net).select("term", "instance", "w")
    assert rows(strict) == [(3, "5 - 6", 6.0), (4, "5 - 6", 3.0)]
    some = spark.createDataFrame([(0,)], "nid long")
    assert rows(motifs.TermAuthor().match(net, docs=some).select("term", "instance", "w")) == [(3, "5", 2.0), (3, "6", 2.0)]


def test_contexts_are_sampled_from_links(net):
    context = motifs.contexts(net, [motifs.TermVenue(), motifs.TermAuthor()])
    for weighted in (False, True):
        drawn = motifs.sampled_sequences(context, 10, 4, weighted=weighted)
        assert drawn.count() == 4 * 40 and drawn.join(context, ["motif", "term", "instance"], "left_anti").isEmpty()
        assert rows(drawn) == rows(motifs.sampled_sequences(context, 10, 4, weighted=weighted))
    assert motifs.sampled_sequences(context, 10, 4, smooth_all=True).count() == 160
    lines = [r["line"] for r in motifs.sequence_lines(motifs.sampled_sequences(context, 2, 3)).collect()]
    assert len(lines) == 8 and all(len(x.split()) == 4 for x in lines)


def test_graph_views(spark, net):
    found = graph.lookup(net.nodes, spark.createDataFrame([("A", "bob"), ("A", "eve")], "node_type string, entity_id string"))
    assert {r["entity_id"]: r["nid"] for r in found.collect()} == {"bob": 6, "eve": None}
    sub = graph.subgraph(net, spark.createDataFrame([(0,), (3,), (7,)], "nid long"))
    assert rows(sub.edges) == [(0, 1, 2.0), (0, 2, 1.0), (1, 0, 2.0), (2, 0, 1.0)]
    assert rows(graph.path_matrix(net, "K<-P->V")) == rows(graph.path_matrix(net, "K->P->V"))
    sums = graph.row_normalized(net.edges, "src", "w").groupBy("src").agg(F.sum("w").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in sums)
    assert X.parse_metapath("A->P<-B") == [("A", "P", 1), ("P", "B", -1)]
    with pytest.raises(ValueError):
        X.parse_metapath("A")


CORPUS = [("d1", ["a", "a", "b"], 2.0), ("d2", ["b", "c"], 1.0), ("d3", [], 1.0)]


def test_tf_idf(spark):
    docs = spark.createDataFrame(CORPUS, "doc_id string, phrases array<string>, w double")
    plain = {r["term"]: (r["tf"], r["idf"]) for r in text_stats.tf_idf(text_stats.count_terms(docs)).collect()}
    assert plain["a"] == pytest.approx((0.4, math.log(3))) and plain["b"] == pytest.approx((0.4, math.log(1.5)))
    listed = spark.createDataFrame([("a",), ("z",)], "term string")
    heavy = {r["term"]: (r["tf"], r["idf"]) for r in text_stats.tf_idf(text_stats.count_terms(docs, weight="w"), phrases=listed).collect()}
    assert heavy == {"a": pytest.approx((0.5, math.log(2))), "z": (0.0, 0.0)}
    back = {r["term"]: (r["tf"], r["idf"]) for r in text_stats.background_tf_idf(text_stats.count_terms(docs), listed).collect()}
    assert back["a"] == pytest.approx((0.6, math.log(3))) and back["z"] == pytest.approx((0.2, 0.0))
    assert text_stats.tf_idf(text_stats.count_terms(docs.limit(0))).count() == 0


def test_contrast(spark):
    s = [("0/0", "0", "t", 0.4, 1.0), ("0/1", "0", "t", 0.1, 1.0), ("0/0", "0", "u", 0.3, 1.0), ("0/1", "0", "u", 0.0, 1.0), ("0/2", "0", "v", 0.2, 1.0), ("0/3", "0", "v", 0.2, 1.0)]
    stats = spark.createDataFrame(s, "prefix string, parent string, term string, tf double, idf double")
    parents = spark.createDataFrame([("0", "t", 0.2), ("0", "u", 0.1), ("0", "v", 0.4)], "parent string, term string, tf double")
    got = {(r["prefix"], r["term"]): r["score"] for r in contrast.node_contrast(stats, parents, 1.0, 1.0).collect()}
    assert got["0/0", "t"] == pytest.approx(0.8) and got["0/0", "u"] == pytest.approx(0.9) and got["0/1", "u"] == 0
    assert got["0/2", "v"] == pytest.approx(0.1)  # two best siblings of one tf


def test_rescaling_and_order_statistics(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 1.0)], "k int, p double")
    assert [r["replicas"] for r in text_stats.rescaled(df, "p").orderBy("k").collect()] == [1, 5, 10]
    assert [r["replicas"] for r in text_stats.rescaled(df.withColumn("p", F.lit(0.3)), "p").collect()] == [1, 1, 1]
    values = [((i * 7919) % 1000) / 3 for i in range(1000)] + [5.0] * 300
    table = spark.createDataFrame([(v,) for v in values], "s double")
    assert topk.order_statistic(table, "s", 0.2) == sorted(values, reverse=True)[260]
    assert topk.order_statistic(table.withColumn("s", F.lit(2.0)), "s") == 2.0 and topk.order_statistic(table.limit(0), "s") is None
    years = spark.createDataFrame([(y,) for y in (1960, 1964, 1965, 1999, 2019, 2020, None)], "y int")
    assert [r[0] for r in years.select(X.period_of(F.col("y"))).collect()] == [1965, 1965, 1970, 2000, 2020, None, None]


def test_pagerank_sums_to_one(net):
    assert ranking.pagerank(net.edges).agg(F.sum("p")).first()[0] == pytest.approx(1)
    seeds = net.nodes.where("node_type = 'K'").select((F.col("nid") - 3).alias("cluster"), "nid")
    p = ranking.personalized_pagerank(net.edges, ranking.uniform_reset(seeds), tolerance=1e-3, iterations=30)
    assert all(r[1] == pytest.approx(1) for r in p.groupBy("cluster").agg(F.sum("p")).collect())
    members = ranking.membership(net.edges, ranking.uniform_reset(seeds), iterations=5)
    assert all(r[1] == pytest.approx(1) for r in members.groupBy("nid").agg(F.sum("p")).collect())
    # against a dense power iteration
    a = np.zeros((11, 11))
    for r in net.edges.collect():
        a[r["src"], r["dst"]] = 1
    step, r0 = a / a.sum(axis=1, keepdims=True), np.eye(11)[3]
    want = r0
    for _ in range(60):
        want = 0.15 * r0 + 0.85 * want @ step
    got = {r["nid"]: r["p"] for r in p.where("cluster = 0").collect()}
    assert all(got.get(i, 0.0) == pytest.approx(want[i], abs=2e-3) for i in range(11))


def test_walks_follow_edges(spark, net):
    starts = spark.createDataFrame([(i, i % 3) for i in range(30)], "walk long, nid long")
    steps = {}
    for r in walks.uniform_walks(net.edges, starts, 6).collect():
        steps.setdefault(r["walk"], {})[r["step"]] = r["nid"]
    edges = {(r["src"], r["dst"]) for r in net.edges.collect()}
    for walk, at in steps.items():
        assert len(at) == 6
        assert all((at[i], at[i + 1]) in edges or at[i + 1] == walk % 3 for i in range(5))
    kinds = {r["nid"]: r["node_type"] for r in net.nodes.collect()}
    for r in walks.metapath_walks(net.edges, net.nodes, starts, ["P", "A"], 4).collect():
        assert kinds[r["nid"]] == "PA"[r["step"] % 2]
    reset = spark.createDataFrame([(0, 1.0), (1, 3.0)], "nid long, p double")
    assert walks.monte_carlo_pagerank(net.edges, reset, 0.8, 20, 5).agg(F.sum("p")).first()[0] == pytest.approx(1)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    centers = np.eye(8)[:3]
    data = [(f"t{i}", (centers[i % 3] + rng.normal(0, 0.1, 8)).tolist()) for i in range(90)]
    return spark.createDataFrame(data, "term string, vec array<double>").persist()


def test_clusters_of_vectors(blobs):
    labels = clustering.spherical_kmeans(blobs, 3)
    mixture = clustering.fit_vmf(blobs, 3)
    p = clustering.posteriors(blobs, mixture)
    assert all(r[1] == pytest.approx(1) for r in p.groupBy("term").agg(F.sum("p")).collect())
    soft = clustering.hard_labels(p)
    for table in (labels, soft):
        groups = {}
        for r in table.collect():
            groups.setdefault(int(r["term"][1:]) % 3, set()).add(r["label"])
        assert sorted(map(len, groups.values())) == [1, 1, 1]
    match = clustering.aligned(labels, soft)
    assert sorted(match) == [0, 1, 2] == sorted(match.values())
    assert clustering.agreed(labels, soft, match).count() == 90


def test_alignment_of_swapped_labels(spark):
    a = spark.createDataFrame([("w", 0), ("x", 0), ("y", 1), ("z", 1)], "term string, label int")
    b = spark.createDataFrame([("w", 1), ("x", 1), ("y", 0), ("z", 0)], "term string, label int")
    assert clustering.aligned(a, b) == {0: 1, 1: 0}


def test_alignment_goes_by_the_labels_of_the_first(spark):
    """Label 0 takes its best match although label 1 overlaps more with it."""
    a = spark.createDataFrame([(i, 0) for i in range(6)] + [(i, 1) for i in range(6, 10)], "term long, label int")
    b = spark.createDataFrame([(i, 0) for i in range(3)] + [(i, 1) for i in range(3, 10)], "term long, label int")
    assert clustering.aligned(a, b) == {0: 0, 1: 1}
    b = spark.createDataFrame([(i, 0) for i in range(2)] + [(i, 1) for i in range(2, 10)], "term long, label int")
    assert clustering.aligned(a, b) == {0: 1, 1: 0}


@settings(max_examples=25, deadline=None)
@given(st.integers(30, 120), st.floats(1, 1400))
def test_bessel_expansion_near_the_series(dim, x):
    order = dim / 2 - 1
    term = [order * math.log(x / 2) - math.lgamma(order + 1)]
    for k in range(1, 2000):
        term.append(term[-1] + 2 * math.log(x / 2) - math.log(k) - math.log(order + k))
    top = max(term)
    series = top + math.log(sum(math.exp(t - top) for t in term))
    assert float(V.log_bessel(order, np.array(x))) == pytest.approx(series, abs=1e-4)


def test_embedding_learns_company(spark):
    lines = [("a b a b a b",), ("c d c d c d",)] * 150
    corpus = spark.createDataFrame(lines, "text string")
    vecs = {r["term"]: np.array(r["vec"]) for r in embedding.Sgns(dim=8, epochs=6, alpha=0.3, sample=1.0, window=2, partitions=2).fit(corpus).collect()}
    cosine = lambda x, y: vecs[x] @ vecs[y] / np.linalg.norm(vecs[x]) / np.linalg.norm(vecs[y])
    assert {"a", "b", "c", "d", "</s>"} == set(vecs) and cosine("a", "b") > cosine("a", "c")


def test_taxonomy_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("0",), ("0/1",)], "prefix string")
    terms = spark.createDataFrame([("0", "<phrase>a_b</phrase>", 2.0, None), ("0/1", "c", 1.0, 0.5)], "prefix string, term string, score double, prior double")
    docs = spark.createDataFrame([("0", "d1", None), ("0/1", "d2", 0.25)], "prefix string, doc_id string, prior double")
    sinks.save_taxonomy(str(tmp_path / "dump"), nodes, terms, docs)
    n, t, d = sinks.load_taxonomy(spark, str(tmp_path / "dump"))
    assert rows(n) == [("0",), ("0/1",)]
    assert rows(t) == [("0", "<phrase>a_b</phrase>", 2.0, 1.0), ("0/1", "c", 1.0, 0.5)]
    assert rows(d) == [("0", "d1", 1.0), ("0/1", "d2", 0.25)]
    sinks.save_readable(str(tmp_path / "tree"), terms, docs)
    assert spark.read.csv(str(tmp_path / "tree/terms"), sep="\t").count() == 2
    dot = sinks.dot_graph(terms)
    assert '"0" -> "0/1"' in dot and '[label="*"]' in dot and "a b" in sinks.dot_graph(terms, shrink_root=False)
    sinks.save_vectors(str(tmp_path / "vec"), spark.createDataFrame([("x", [1.0, 2.0, 3.0])], "term string, vec array<double>"))
    assert rows(network.read_vectors(spark, str(tmp_path / "vec"))) == [("x", [1.0, 2.0, 3.0])]


def test_stream_counts(spark, tmp_path):
    from topicgrove.streaming.term_counts import windowed_term_counts

    src = spark.createDataFrame([("2024-01-01 00:10:00", "<phrase>a b</phrase> <phrase>c</phrase>"), ("2024-01-01 00:20:00", "<phrase>a b</phrase>"), ("2024-01-01 05:00:00", "<phrase>z</phrase>")], "ts string, text string")
    src.select(F.to_timestamp("ts").alias("ts"), "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = windowed_term_counts(stream).writeStream.format("memory").queryName("terms").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["term"], r["n"]) for r in spark.table("terms").collect()) == [("<phrase>a_b</phrase>", 2), ("<phrase>c</phrase>", 1), ("<phrase>z</phrase>", 1)]
