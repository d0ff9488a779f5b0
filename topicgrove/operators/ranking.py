"""Iterative rankings as join-aggregate plans; the state is keyed by cluster, so one loop serves all clusters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicgrove.operators.graph import sym_normalized
from topicgrove.sources.checkpoints import dealt, held


def uniform_reset(seeds: DataFrame) -> DataFrame:
    """(cluster, nid, p) of seeds (cluster, nid): equal chances in each cluster."""
    n = seeds.groupBy("cluster").agg(F.count("*").alias("_n"))
    return seeds.join(F.broadcast(n), "cluster").select("cluster", "nid", (F.lit(1.0) / F.col("_n")).alias("p"))


def weighted_reset(seeds: DataFrame) -> DataFrame:
    total = seeds.groupBy("cluster").agg(F.sum("p").alias("_n"))
    return seeds.join(F.broadcast(total), "cluster").select("cluster", "nid", F.coalesce(F.try_divide("p", "_n"), F.lit(0.0)).alias("p"))


#: neighbours in a row of an adjacency table, rows of one node that are kept together, rounds between two cuts of the plan,
#: and clusters whose states stand side by side in a row
CHUNK, TOGETHER, ROUNDS, ABREAST = 1024, 1024, 4, 16


def dealt_adjacency(edges: DataFrame, weighted: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(src, part, to), to being arrays of (dst, share), dealt by node; and (nid, parts) of the nodes of several parts, if any.

    A node has a row for about CHUNK neighbours and a part for TOGETHER such rows, so that the neighbours of a node
    that touches a third of all others are spread over the partitions: the table is then dealt by (src, part).
    """
    w = F.col("w").cast("double") if weighted else F.lit(1.0)
    out = edges.groupBy("src").agg(F.sum(w).alias("out"), F.ceil(F.count("*") / F.lit(CHUNK)).alias("rows"))
    rows = edges.join(out, "src").select("src", "rows", F.pmod(F.xxhash64("dst"), "rows").alias("row"), F.struct("dst", (w / F.col("out")).alias("share")).alias("one"))
    lists = rows.groupBy("src", "rows", "row").agg(F.collect_list("one").alias("to"))
    parts = F.ceil(F.col("rows") / F.lit(TOGETHER))
    hubs = held(out.select(F.col("src").alias("nid"), parts.alias("parts")).where("parts > 1"))
    if hubs.isEmpty():
        return dealt(lists.select("src", F.lit(0).alias("part"), "to"), "src"), None
    return dealt(lists.select("src", F.pmod("row", parts).cast("int").alias("part"), "to"), "src", "part"), hubs


def personalized_pagerank(edges: DataFrame, reset: DataFrame, damping: float = 0.85, iterations: int = 10, weighted: bool = False, tolerance: float | None = None) -> DataFrame:
    """(cluster, nid, p): p' = (1 - d) r + d (inflow + dangling mass x r), from p = r; ``d`` is the chance to go on.

    ``reset`` (cluster, nid, p) sums to 1 in each cluster. Edges count alike unless ``weighted``. With a tolerance,
    rounds end once no cluster's L1 change exceeds it, at ``iterations`` at the latest. Edges are shuffled before the
    first round alone. The clusters, children of one node, stand ABREAST in a node's row, so that a round makes a row
    an edge whatever their number, and its inflow and reset are summed up on the map side.
    """
    step, hubs = dealt_adjacency(edges, weighted)
    reset = held(reset.select("cluster", "nid", "p"))
    sources = step.select("src").distinct()
    ends = step.select(F.explode("to").alias("t")).select(F.col("t.dst").alias("nid")).union(reset.select("nid")).distinct()
    dangling = held(ends.join(sources, F.col("nid") == F.col("src"), "left_anti"))
    clusters = sorted(r[0] for r in reset.select("cluster").distinct().collect())  # children of one node
    found = None
    for i in range(0, len(clusters), ABREAST):
        some = _ranked_abreast(step, hubs, None if dangling.isEmpty() else dangling, reset, clusters[i : i + ABREAST], damping, iterations, tolerance)
        found = some if found is None else found.unionByName(some)
    return reset if found is None else found


def _ranked_abreast(step: DataFrame, hubs: DataFrame | None, dangling: DataFrame | None, reset: DataFrame, clusters: list, damping: float, iterations: int, tolerance: float | None) -> DataFrame:
    names = [f"p{i}" for i in range(len(clusters))]
    nothing = F.lit(0.0)
    start = reset.groupBy("nid").agg(*[F.sum(F.when(F.col("cluster") == F.lit(c), F.col("p")).otherwise(nothing)).alias(n) for n, c in zip(names, clusters, strict=True)])
    p = start = held(start)
    for i in range(iterations):
        if hubs is not None:
            out = p.join(hubs, "nid", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)).cast("int") - 1)))
            met = out.join(step, (F.col("nid") == step.src) & (out.part == step.part))
        else:
            met = p.join(step, F.col("nid") == step.src)
        flow = met.select(*names, F.explode("to").alias("t")).select(F.col("t.dst").alias("nid"), *[(F.lit(damping) * F.col(n) * F.col("t.share")).alias(n) for n in names])
        if dangling is None:
            back = start.select("nid", *[(F.lit(1 - damping) * F.col(n)).alias(n) for n in names])
        else:
            lost = p.join(dangling, "nid", "left_semi").agg(*[F.coalesce(F.sum(n), nothing).alias(f"lost_{n}") for n in names])  # one row
            back = start.crossJoin(F.broadcast(lost)).select("nid", *[((F.lit(1 - damping) + F.lit(damping) * F.col(f"lost_{n}")) * F.col(n)).alias(n) for n in names])
        new = flow.unionByName(back).groupBy("nid").agg(*[F.sum(n).alias(n) for n in names])
        if dangling is not None or tolerance is not None or i % ROUNDS == ROUNDS - 1:
            new = held(new)
        if tolerance is not None:
            both = new.unionByName(p.select("nid", *[(-F.col(n)).alias(n) for n in names])).groupBy("nid").agg(*[F.abs(F.sum(n)).alias(n) for n in names])
            change = both.agg(*[F.sum(n) for n in names]).first()
            if max(change[: len(names)]) <= tolerance:
                p = new
                break
        p = new
    each = F.array(*[F.struct(F.lit(c).alias("cluster"), F.col(n).alias("p")) for n, c in zip(names, clusters, strict=True)])
    return p.select("nid", F.explode(each).alias("x")).select(F.col("x.cluster").alias("cluster"), "nid", F.col("x.p").alias("p")).where("p > 0")


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 10) -> DataFrame:
    """Reset to all nodes alike."""
    nodes = edges.select(F.col("src").alias("nid")).union(edges.select("dst")).distinct().select(F.lit(0).alias("cluster"), "nid")
    return personalized_pagerank(edges, uniform_reset(nodes), damping, iterations).select("nid", "p")


def membership(edges: DataFrame, reset: DataFrame, damping: float = 0.8, iterations: int = 10) -> DataFrame:
    """(cluster, nid, p): each node's shares of the clusters' rankings; they sum to 1 over the clusters."""
    ranking = personalized_pagerank(edges, reset, damping, iterations)
    total = ranking.groupBy("nid").agg(F.sum("p").alias("_sum"))
    return ranking.join(total, "nid").select("cluster", "nid", F.coalesce(F.try_divide("p", "_sum"), F.lit(0.0)).alias("p"))


def assigned(members: DataFrame, n_children: int, factor: float = 2.0) -> DataFrame:
    """Memberships over factor / n_children; a node may go to several children or to none."""
    return members.where(F.col("p") > factor / n_children)


def bipartite_authority(matrix: DataFrame, seeds: DataFrame, iterations: int = 4, tolerance: float | None = None) -> DataFrame:
    """(cluster, dst, score): scores of the columns of ``matrix`` (src, dst, w), from seed rows (cluster, src, a).

    The matrix is normalized by its row and column sums; b = W'a and a = Wb take turns, and b is divided by its sum.
    With a tolerance, a cluster stops once its a moves less than that; without, all do the same rounds.
    """
    w = held(sym_normalized(matrix))
    a, done = seeds.select("cluster", "src", "a"), None
    b = None
    for i in range(iterations):
        b = held(a.join(w, "src").groupBy("cluster", "dst").agg(F.sum(F.col("a") * F.col("w")).alias("b")))
        if i < iterations - 1 or tolerance is not None:
            new = held(b.join(w, "dst").groupBy("cluster", "src").agg(F.sum(F.col("b") * F.col("w")).alias("a")))
            if tolerance is not None:
                old = a.select("cluster", "src", F.col("a").alias("before"))
                gap = new.join(old, ["cluster", "src"], "full").groupBy("cluster").agg(F.sqrt(F.sum(F.pow(F.coalesce("a", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 2))).alias("gap"))
                still = gap.where(F.col("gap") < tolerance).select("cluster")
                stopped = b.join(still, "cluster", "left_semi")
                done = stopped if done is None else done.unionByName(stopped)
                new = new.join(still, "cluster", "left_anti")
            a = new
    if done is not None:
        open_ = b.join(done.select("cluster").distinct(), "cluster", "left_anti")
        b = done.unionByName(open_)
    total = b.groupBy("cluster").agg(F.sum("b").alias("_sum"))
    return b.join(F.broadcast(total), "cluster").select("cluster", "dst", F.coalesce(F.try_divide("b", "_sum"), F.lit(0.0)).alias("score"))


def metapath_authority(forward: DataFrame, iterations: int = 1000, tolerance: float = 5e-5) -> DataFrame:
    """(src, score): authority over a meta-path matrix, from equal scores until their change is below the tolerance."""
    w = held(sym_normalized(forward))
    rows = w.select("src").distinct()
    n = rows.count()
    score = rows.select("src", F.lit(1.0 / max(1, n)).alias("score"))
    for _ in range(iterations):
        to = score.join(w, "src").groupBy("dst").agg(F.sum(F.col("score") * F.col("w")).alias("h"))
        back = held(to.join(w, "dst").groupBy("src").agg(F.sum(F.col("h") * F.col("w")).alias("raw")))
        total = back.agg(F.sum("raw").alias("_sum"))
        new = held(back.crossJoin(F.broadcast(total)).select("src", (F.col("raw") / F.col("_sum")).alias("score")))
        change = new.join(score.select("src", F.col("score").alias("before")), "src").agg(F.sqrt(F.sum(F.pow(F.col("score") - F.col("before"), 2)))).first()[0]
        score = new
        if (change or 0) < tolerance:
            break
    return score


def normalized_entropy(scores: DataFrame, k: int, *by: str) -> DataFrame:
    """(by..., entropy, mean) over k clusters: entropy of the shares over ln k, 0 for one cluster; missing scores are 0."""
    share = F.try_divide(F.col("score"), F.sum("score").over(Window.partitionBy(*by)))
    part = F.when(share > 0, -share * F.ln(share)).otherwise(0.0)
    base = math.log(k) if k > 1 else 1.0
    return scores.withColumn("_part", part).groupBy(*by).agg((F.sum("_part") / base).alias("entropy"), (F.sum("score") / k).alias("mean"), F.sum("score").alias("total"))

