"""Random walks in long form (walk, step, nid): one join a step; draws are hashes of walk and step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicgrove.functions.text import uniform
from topicgrove.operators.ranges import summed_up
from topicgrove.sources.checkpoints import held


def placed_intervals(rows: DataFrame, keys: list[str], order: str, mass: Column) -> DataFrame:
    """``rows`` with the interval [low, high) of each in its group's draws, the group's ``total`` and number of rows ``n``."""
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumns({"mass": mass, "high": F.sum(mass).over(upto), "total": F.sum(mass).over(whole), "n": F.count("*").over(whole)})
    return placed.withColumn("low", F.col("high") - F.col("mass"))


def in_cells(placed: DataFrame) -> DataFrame:
    """``placed`` once for each of the ``n`` equal cells of its group that a row's interval touches: 2 n rows of n at most.

    A draw u falls into the cell ``cell_of(u)`` and is met there on equality by two rows on average, however many
    the group has.
    """
    cell = lambda edge: F.least(F.floor(F.col(edge) / F.col("total") * F.col("n")), F.col("n") - 1)
    return placed.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))


def cell_of(u: str) -> Column:
    return F.least(F.floor(F.col(u) / F.col("total") * F.col("n")), F.col("n") - 1)


def _indexed(edges: DataFrame, weighted: bool = False, *by: str) -> tuple[DataFrame, DataFrame]:
    """Edges with their source's intervals, in cells where they are weighted, and (keys, total, n) of each source."""
    keys = ["src", *by]
    placed = held(placed_intervals(edges, keys, "dst", F.col("w") if weighted else F.lit(1.0)).select(*keys, "dst", "low", "high", "total", "n"))
    totals = held(placed.select(*keys, "total", "n").distinct())
    return (held(in_cells(placed).select(*keys, "dst", "low", "high", "cell")) if weighted else placed.select(*keys, "dst", "low")), totals


def _hop(at: DataFrame, index: tuple[DataFrame, DataFrame], step: int, seed: int, weighted: bool, *by: str) -> DataFrame:
    keys, (rows, totals) = ["src", *by], index
    drawn = at.join(totals, keys).withColumn("u", uniform("walk", F.lit(step), seed=seed) * F.col("total"))
    if weighted:
        met = drawn.withColumn("cell", cell_of("u")).join(rows, [*keys, "cell"]).where("low <= u and u < high")
    else:  # the draw is a place: an equi-join
        met = drawn.withColumn("low", F.floor("u").cast("double")).join(rows, [*keys, "low"])
    return met.select(*[c for c in at.columns if c not in keys], F.col("dst").alias("src"))


def uniform_walks(edges: DataFrame, starts: DataFrame, length: int, damping: float = 0.8, weighted: bool = False, restart: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Walks from ``starts`` (walk, nid). At each step the walk goes on with chance ``damping``, else it starts over.

    It starts over at its own start, or at a node drawn from ``restart`` (nid, p). A walk ends at a node without edges.
    """
    index = _indexed(edges, weighted)
    at = starts.select("walk", F.col("nid").alias("start"), F.col("nid").alias("src"))
    made = at.select("walk", F.lit(0).alias("step"), F.col("src").alias("nid"))
    resets = None
    if restart is not None:
        share = restart.agg(F.sum("p").alias("total"), F.count("*").alias("n"))  # one row
        summed = summed_up(restart.where("p > 0").select(F.col("nid").alias("again"), "p"), "p", "high", F.col("again")).withColumn("low", F.col("high") - F.col("p"))
        resets = held(in_cells(summed.crossJoin(F.broadcast(share))).select("again", "low", "high", "cell"))
    for step in range(1, length):
        goes = uniform("walk", F.lit(step), seed=seed + 1) < damping
        hop = _hop(at.where(goes), index, step, seed, weighted)
        back = at.where(~goes)
        if resets is None:
            back = back.select("walk", "start", F.col("start").alias("src"))
        else:
            drawn = back.crossJoin(F.broadcast(share)).withColumn("u", uniform("walk", F.lit(step), seed=seed + 2) * F.col("total")).withColumn("cell", cell_of("u"))
            back = drawn.join(resets, "cell").where("low <= u and u < high").select("walk", "start", F.col("again").alias("src"))
        at = held(hop.select("walk", "start", "src").unionByName(back))
        made = made.unionByName(at.select("walk", F.lit(step).alias("step"), F.col("src").alias("nid")))
    return made


def metapath_walks(edges: DataFrame, nodes: DataFrame, starts: DataFrame, types: list[str], length: int, seed: int = 0) -> DataFrame:
    """Walks whose node at step j is of type ``types[j % len(types)]``; a walk ends where no neighbour has the type."""
    typed = edges.join(nodes.select(F.col("nid").alias("dst"), F.col("node_type").alias("to_type")), "dst")
    index = _indexed(typed, False, "to_type")
    at = starts.select("walk", F.col("nid").alias("src"))
    made = at.select("walk", F.lit(0).alias("step"), F.col("src").alias("nid"))
    for step in range(1, length):
        wanted = at.withColumn("to_type", F.lit(types[step % len(types)]))
        at = held(_hop(wanted, index, step, seed, False, "to_type"))
        made = made.unionByName(at.select("walk", F.lit(step).alias("step"), F.col("src").alias("nid")))
    return made


def visit_shares(walks: DataFrame) -> DataFrame:
    """(nid, p): the share of all visits."""
    visits = walks.groupBy("nid").agg(F.count("*").alias("n"))
    return visits.crossJoin(F.broadcast(visits.agg(F.sum("n").alias("all")))).select("nid", (F.col("n") / F.col("all")).alias("p"))


def monte_carlo_pagerank(edges: DataFrame, restart: DataFrame, damping: float = 0.8, n_walk: int = 100, walk_len: int = 100, seed: int = 0) -> DataFrame:
    """(nid, p) from ``n_walk`` walks of each restart node (nid, p); restarts are drawn by p."""
    starts = restart.where("p > 0").select("nid", F.explode(F.sequence(F.lit(0), F.lit(n_walk - 1))).alias("k"))
    starts = starts.select(F.concat_ws("/", F.col("nid").cast("string"), F.col("k").cast("string")).alias("walk"), "nid")
    return visit_shares(uniform_walks(edges, starts, walk_len, damping, restart=restart, seed=seed))
