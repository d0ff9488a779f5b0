"""From files to a taxonomy and back: the folder's formats, the build that reads them, and small helpers."""

import random

import pytest
from pyspark.sql import functions as F

from topicgrove.__main__ import build, read_config
from topicgrove.functions import text as X
from topicgrove.functions import vectors as V
from topicgrove.operators import clustering, embedding, ranges, walks
from topicgrove.operators.embedding import Sgns
from topicgrove.plans.taxonomy import Settings
from topicgrove.sources import checkpoints, network, sinks

TOPICS = ["deep net", "query plan"], ["graph cut", "random walk"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Forty documents of two topics, their terms, two authors and two venues, in the files of a network's folder."""
    d, rng = tmp_path_factory.mktemp("data"), random.Random(4)
    nodes, edges, ids, texts = [], [], [], []
    terms = [t for topic in TOPICS for t in topic]
    for i in range(40):
        nodes.append(f"{i}\tP\td{i}")
        ids.append(f"d{i}")
        chosen = [rng.choice(TOPICS[i % 2]) for _ in range(4)] + [rng.choice(terms)]
        texts.append(" and ".join(f"<phrase>{t}</phrase>" for t in chosen))
        edges += [f"{i} {40 + terms.index(t)}" for t in chosen] + [f"{i} {44 + i % 2}", f"{i} {46 + i % 2} 2", f"{i} 48"]
    nodes += [f"{40 + k}\tK\t<phrase>{t.replace(' ', '_')}</phrase>" for k, t in enumerate(terms)]
    nodes += ["44\tA\tann\textra", "45\tA\tbob", "46\tV\tone", "47\tV\ttwo", "48\tY\t1999"]
    edges.append("0 1")  # a citation, which is left out
    for name, lines in (("node_info", nodes), ("edges", [f"49 {len(edges)}", *edges]), ("indices", ids), ("text_documents", texts), ("background_documents", texts + ["nothing here"])):
        (d / f"{name}.txt").write_text("\n".join(lines) + "\n")
    return str(d)


def test_files_are_read(spark, folder):
    net = network.load_graph(spark, folder)
    assert {r["node_type"]: r["n"] for r in net.nodes.groupBy("node_type").agg(F.count("*").alias("n")).collect()} == {"P": 40, "K": 4, "A": 2, "V": 2, "Y": 1}
    assert net.nodes.where("nid = 44").first()["extra"] == ["extra"]
    assert net.edges.where("src = 0 and dst = 1").isEmpty() and net.edges.where("src = 46 and dst = 0").first()["w"] == 2.0
    docs = {r["line"]: r["doc_id"] for r in network.load_documents(spark, folder).collect()}
    assert docs == {i: f"d{i}" for i in range(40)}
    assert network.read_background(spark, f"{folder}/background_documents.txt").where("size(phrases) = 0").count() == 1


def test_build_from_files_to_the_dump(spark, folder, tmp_path):
    config = read_config(["--data_dir", folder, "--output_dir", str(tmp_path), "--base_name", "b", "--levels", "2"])
    assert config.levels == (2,) and config.damping == 0.8
    few = Settings(candidate_share=1.0, sgns=Sgns(dim=8, epochs=2), sequences=4, pagerank_rounds=3, factor=0.5)
    root = build(spark, config, few)
    assert [n.prefix for n in root.walk()][0] == "0" and len(root.children) == 2
    nodes, terms, docs = sinks.load_taxonomy(spark, f"{tmp_path}/b/taxonomy")
    assert {r["prefix"] for r in nodes.collect()} == {n.prefix for n in root.walk()}
    assert terms.where("prefix = '0'").count() == 4 and docs.where("prefix = '0'").count() == 40
    assert spark.read.text(f"{tmp_path}/b/tree").first()[0].startswith("digraph taxonomy")
    assert spark.read.text(f"{tmp_path}/b/readable/terms").count() > 4


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    lines = [f"line {i}" for i in range(3000)]
    (tmp_path / "x.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = network._numbered(spark, str(tmp_path / "x.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["line"]: r["value"] for r in got} == dict(enumerate(lines))


def test_ranges_number_and_sum_in_order(spark):
    values = [random.Random(1).randrange(10**6) for _ in range(500)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long")
    got = ranges.summed_up(ranges.numbered(df, "at", F.desc("v"), F.col("i")), "v", "upto", F.desc("v"), F.col("i")).collect()
    order, upto = sorted(range(500), key=lambda i: (-values[i], i)), 0
    want = {}
    for at, i in enumerate(order):
        upto += values[i]
        want[i] = (at, upto)
    assert {r["i"]: (r["at"], r["upto"]) for r in got} == want
    assert ranges.numbered(df.limit(0), "at", F.col("v")).count() == 0


def test_vectors_vocabularies_and_contexts_are_read_back(spark, tmp_path):
    vectors = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [3.0, 4.0]), ("2", [5.0, 2.0])], "term string, vec array<double>")
    sinks.save_vectors(str(tmp_path / "v"), vectors)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert "3 2" in lines and len(lines) == 4
    assert sorted(map(tuple, network.read_vectors(spark, str(tmp_path / "v")).collect())) == sorted(map(tuple, vectors.collect()))
    one = spark.createDataFrame([("x", [1.0]), ("7", [2.0])], "term string, vec array<double>")
    sinks.save_vectors(str(tmp_path / "w"), one)
    assert network.read_vectors(spark, str(tmp_path / "w")).count() == 2
    start = spark.createDataFrame([("x", [9.0, 9.0]), ("z", [8.0, 8.0])], "term string, vec array<double>")
    warm = network.warm_start(start.select("term"), vectors, 2, start)
    assert {r["term"]: r["vec"] for r in warm.collect()} == {"x": [1.0, 2.0], "z": [8.0, 8.0]}
    words = spark.createDataFrame([("</s>", 3), ("a", 2)], "word string, cn long")
    sinks.save_vocabulary(str(tmp_path / "voc"), words)
    assert sorted(map(tuple, network.read_vocabulary(spark, str(tmp_path / "voc")).collect())) == [("</s>", 3), ("a", 2)]
    context = spark.createDataFrame([("KP", "t", "1", 2.0)], "motif string, term string, instance string, w double")
    sinks.save_contexts(str(tmp_path / "c"), context, "0/1", "graph-7")
    assert sinks.load_contexts(spark, str(tmp_path / "c"), "0/1", "graph-7").collect() == context.collect()
    assert sinks.load_contexts(spark, str(tmp_path / "c"), "0/1", "graph-8") is None


def test_small_helpers(spark):
    row = spark.range(1).select(X.sigmoid(F.lit(0.0)).alias("s"), X.sigmoid(F.lit(7.0)).alias("t"), V.difference_norm(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0))).alias("d")).first()
    assert (row["s"], row["t"], row["d"]) == (0.5, 1.0, 5.0)
    labels = spark.createDataFrame([("a", 0), ("b", 1)], "term string, label int")
    assert [r["term"] for r in clustering.cluster_terms(labels, 1).collect()] == ["b"]
    base = spark.createDataFrame([("a", [1.0, 1.0])], "term string, vec array<double>")
    assert embedding.assembled(base, base).first()["vec"] == [2.0, 2.0]


def test_weighted_and_restarting_walks_follow_the_weights(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 2, 3.0), (1, 0, 1.0), (2, 0, 1.0)], "src long, dst long, w double")
    starts = spark.range(2000).select(F.col("id").alias("walk"), F.lit(0).cast("long").alias("nid"))
    first = walks.uniform_walks(edges, starts, 2, damping=1.0, weighted=True).where("step = 1").groupBy("nid").count()
    got = {r["nid"]: r["count"] for r in first.collect()}
    assert 1400 < got[2] < 1600 and got[1] + got[2] == 2000
    restart = spark.createDataFrame([(1, 1.0), (2, 4.0)], "nid long, p double")
    again = walks.uniform_walks(edges, starts, 2, damping=0.0, restart=restart).where("step = 1").groupBy("nid").count()
    got = {r["nid"]: r["count"] for r in again.collect()}
    assert 1520 < got[2] < 1680 and got[1] + got[2] == 2000


def test_held_tables_are_cleaned_up(spark):
    import os

    checkpoints.held(spark.range(3))
    paths = [p.removeprefix("file:") for p in checkpoints._kept]
    assert any(os.path.exists(p) for p in paths)
    checkpoints.clean_up(spark)
    assert not any(os.path.exists(p) for p in paths)
