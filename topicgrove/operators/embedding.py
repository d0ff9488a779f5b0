"""Skip-gram vectors with negative sampling from texts and network contexts, trained in partitions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgrove.functions.text import tokens
from topicgrove.operators.text_stats import context_word_counts, pruned, ranked, word_counts


@dataclass(frozen=True)
class Sgns:
    """Settings of a training: the defaults are those of a root node; ``deeper`` gives those below it.

    ``lam_net`` weighs network pairs, 1 - ``lam_net`` text pairs; ``lam_base`` pulls towards the start vectors.
    The vocabulary must fit in a task's memory (its vectors are broadcast); texts and contexts need not.
    """

    dim: int = 100
    window: int = 5
    negative: int = 5
    epochs: int = 5
    alpha: float = 0.025
    sample: float = 1e-4
    lam_net: float = 0.0
    lam_base: float = 0.0
    min_count: int = 2
    partitions: int = 0
    seed: int = 1

    def deeper(self, joint: bool = False) -> Sgns:
        return replace(self, epochs=2, alpha=0.005 if joint else 0.001, lam_net=0.5 if joint else self.lam_net)

    def vocabulary(self, corpus: DataFrame, net: DataFrame | None) -> DataFrame:
        """(word, cn, idx, net): words of the texts, ranked; words of contexts only come after."""
        words = ranked(pruned(word_counts(corpus), self.min_count)).withColumn("net", F.lit(False))
        if net is None:
            return words
        only = context_word_counts(net).where("word <> '</s>'").join(words, "word", "left_anti")
        targets = net.select(F.get(tokens(F.col("text")), 0).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("cn")).join(words, "word", "left_anti")
        more = only.unionByName(targets).groupBy("word").agg(F.sum("cn").alias("cn"))
        offset = words.count()
        return words.unionByName(ranked(more).select("word", "cn", (F.col("idx") + offset).alias("idx"), F.lit(True).alias("net")))

    def fit(self, corpus: DataFrame, net: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
        """(term, vec) of all words: ``corpus`` (text), ``net`` lines ``target ctx ...`` (text), ``start`` (term, vec).

        Each epoch every partition trains a copy of the parameters on its lines, and the copies are averaged by the
        number of updates; only the averaged parameters reach the driver, |V| x dim numbers whatever the corpus.
        """
        rows = self.vocabulary(corpus, net).orderBy("idx").collect()  # the vocabulary
        words = [r["word"] for r in rows]
        index = {w: i for i, w in enumerate(words)}
        counts = np.array([r["cn"] for r in rows], float)
        of_net = np.array([r["net"] for r in rows], bool)
        rng = np.random.default_rng(self.seed)
        base = (rng.random((len(words), self.dim)) - 0.5) / self.dim
        if start is not None:
            for r in start.where(F.size("vec") == self.dim).join(F.broadcast(corpus.sparkSession.createDataFrame([(w,) for w in words], "term string")), "term").collect():
                base[index[r["term"]]] = r["vec"]
        inner, outer = base.copy(), np.zeros_like(base)
        lines = corpus.select(tokens(F.col("text")).alias("words"), F.lit(False).alias("is_net"))
        if net is not None and self.lam_net > 0:
            lines = lines.unionByName(net.select(tokens(F.col("text")).alias("words"), F.lit(True).alias("is_net")))
        parts = self.partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lines = lines.repartition(parts).persist()
        context = corpus.sparkSession.sparkContext
        for epoch in range(self.epochs):
            alpha = max(self.alpha * (1 - epoch / self.epochs), self.alpha * 1e-4)
            state = context.broadcast((inner, outer, base))
            settings, known, c, n = self, index, counts, of_net

            def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                from pyspark import TaskContext

                kernel = _Kernel(settings, known, c, n, state.value, settings.seed * 1009 + epoch * 101 + TaskContext.get().partitionId())
                for frame in frames:
                    for line, is_net in zip(frame["words"], frame["is_net"], strict=True):
                        kernel.line(list(line), is_net, alpha)
                m = max(kernel.updates, 0)
                yield pd.DataFrame({"i": np.arange(len(known)), "a": list(kernel.inner * m), "b": list(kernel.outer * m), "m": float(m)})

            parts = lines.mapInPandas(train, "i int, a array<double>, b array<double>, m double")
            summed = parts.groupBy("i").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"), F.sum("m").alias("m"))  # a row a partition
            total = summed.select("i", _sum_vectors("a").alias("a"), _sum_vectors("b").alias("b"), "m").collect()
            for r in total:
                if r["m"]:
                    inner[r["i"]], outer[r["i"]] = np.array(r["a"]) / r["m"], np.array(r["b"]) / r["m"]
            state.unpersist()
        lines.unpersist()
        return corpus.sparkSession.createDataFrame(pd.DataFrame({"term": words, "vec": inner.tolist()}), "term string, vec array<double>")


def _sum_vectors(col: str):
    """Elementwise sum of an array of vectors, one a partition."""
    first = F.transform(F.get(F.col(col), 0), lambda x: F.lit(0.0))
    return F.aggregate(F.col(col), first, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))


class _Kernel:
    """Updates of one partition's copy of the parameters."""

    def __init__(self, settings: Sgns, index: dict[str, int], counts: np.ndarray, of_net: np.ndarray, state: tuple, seed: int):
        self.s, self.index = settings, index
        self.inner, self.outer, self.base = state[0].copy(), state[1].copy(), state[2]
        self.rng = np.random.default_rng(seed)
        noise = np.where(of_net, 0, counts**0.75)
        self.noise = np.cumsum(noise) / noise.sum() if noise.sum() else None
        net_noise = counts**0.75
        self.net_noise = np.cumsum(net_noise) / net_noise.sum()
        ratio = counts / (settings.sample * counts.sum())
        self.keep = (np.sqrt(ratio) + 1) / ratio
        self.updates = 0

    def line(self, words: list[str], is_net: bool, alpha: float) -> None:
        ids = np.array([self.index[w] for w in words if w in self.index], int)
        if is_net:
            if len(ids) > 1 and words[0] in self.index:
                self.pairs(np.full(len(ids) - 1, ids[0]), ids[1:], alpha * self.s.lam_net, self.net_noise)
            return
        for at in range(0, len(ids), 1000):
            part = ids[at : at + 1000]
            part = part[self.keep[part] >= self.rng.random(len(part))]
            n, shrunk = len(part), self.rng.integers(1, self.s.window + 1, len(part))
            for lag in range(1, self.s.window + 1):
                if lag >= n:
                    break
                left, right = np.arange(n - lag), np.arange(lag, n)
                by_left, by_right = shrunk[left] >= lag, shrunk[right] >= lag
                inputs = np.concatenate([part[right[by_left]], part[left[by_right]]])
                outputs = np.concatenate([part[left[by_left]], part[right[by_right]]])
                self.pairs(inputs, outputs, alpha * (1 - self.s.lam_net), self.noise)

    def pairs(self, inputs: np.ndarray, outputs: np.ndarray, rate: float, noise: np.ndarray | None) -> None:
        if not len(inputs) or noise is None or rate <= 0:
            return
        self.updates += len(inputs)
        negatives = np.searchsorted(noise, self.rng.random((len(inputs), self.s.negative)))
        targets = np.concatenate([outputs[:, None], negatives], axis=1)
        labels = np.zeros(targets.shape)
        labels[:, 0] = 1
        live = np.ones(targets.shape)
        live[:, 1:] = negatives != outputs[:, None]
        u, v = self.inner[inputs], self.outer[targets]
        g = rate * live * (labels - 1 / (1 + np.exp(-np.clip(np.einsum("ij,ikj->ik", u, v), -6, 6))))
        step = np.einsum("ik,ikj->ij", g, v)
        if self.s.lam_base:
            step -= rate * self.s.lam_base * (u - self.base[inputs])
        np.add.at(self.outer, targets.reshape(-1), (g[:, :, None] * u[:, None, :]).reshape(-1, self.s.dim))
        np.add.at(self.inner, inputs, step)


def assembled(base: DataFrame, increment: DataFrame) -> DataFrame:
    """(term, vec): vectors plus their increments."""
    joined = base.join(increment.select("term", F.col("vec").alias("_more")), "term")
    return joined.select("term", F.zip_with("vec", "_more", lambda x, y: x + y).alias("vec"))
