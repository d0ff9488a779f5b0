"""Clustering of term vectors: spherical k-means, von Mises-Fisher mixtures, overlaps and alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicgrove.functions.vectors import doubles, dot, unit, vmf_log_normalizer


def with_vectors(terms: DataFrame, vectors: DataFrame) -> tuple[DataFrame, int]:
    """Terms that have a vector, at length 1, and how many have none."""
    found = terms.join(vectors.select("term", unit(doubles(F.col("vec"))).alias("vec")), "term")
    return found, terms.join(vectors.select("term"), "term", "left_anti").count()


def spherical_kmeans(vectors: DataFrame, k: int, seed: int = 1, max_iter: int = 20) -> DataFrame:
    """(term, label) by Spark's k-means under the cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("term", array_to_vector(doubles(F.col("vec"))).alias("features"))
    model = KMeans(k=k, distanceMeasure="cosine", seed=seed, maxIter=max_iter).fit(rows)
    return model.transform(rows).select("term", F.col("prediction").alias("label"))


@dataclass(frozen=True)
class Mixture:
    """A von Mises-Fisher mixture of k components; k x dim numbers whatever the number of terms."""

    centers: np.ndarray
    weights: np.ndarray
    kappas: np.ndarray

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        dim = self.centers.shape[1]
        return x @ self.centers.T * self.kappas + vmf_log_normalizer(self.kappas, dim) + np.log(np.maximum(self.weights, 1e-300))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        joint = self.log_joint(x)
        p = np.exp(joint - joint.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _matrix(vecs: pd.Series) -> np.ndarray:
    x = np.array(vecs.tolist(), float)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def fit_vmf(vectors: DataFrame, k: int, seed: int = 1, iterations: int = 25, tolerance: float = 1e-4, most_kappa: float = 1e4) -> Mixture:
    """EM over all vectors: partitions send sums of k x (dim + 2) numbers each round, nothing else.

    Starts from spherical k-means. kappa by Banerjee's approximation; an empty component keeps its center.
    """
    labels = spherical_kmeans(vectors, k, seed)
    first = vectors.select("term", "vec").join(labels, "term").select("label", F.posexplode(unit(doubles(F.col("vec")))).alias("i", "x"))
    sums = first.groupBy("label", "i").agg(F.sum("x").alias("x")).collect()  # k x dim
    dim = 1 + max(r["i"] for r in sums)
    centers = np.zeros((k, dim))
    for r in sums:
        centers[r["label"], r["i"]] = r["x"]
    centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    mixture, before = Mixture(centers, np.full(k, 1 / k), np.full(k, float(dim))), None
    rows = vectors.select("vec").persist()
    for _ in range(iterations):
        current = mixture

        def expect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, mass, likelihood = np.zeros((k, dim)), np.zeros(k), 0.0
            for frame in frames:
                if len(frame):
                    x = _matrix(frame["vec"])
                    joint = current.log_joint(x)
                    top = joint.max(axis=1)
                    likelihood += float((top + np.log(np.exp(joint - top[:, None]).sum(axis=1))).sum())
                    p = current.posterior(x)
                    total += p.T @ x
                    mass += p.sum(axis=0)
            yield pd.DataFrame({"k": range(k), "total": list(total), "mass": mass, "likelihood": [likelihood] + [0.0] * (k - 1)})

        stats = rows.mapInPandas(expect, "k int, total array<double>, mass double, likelihood double")
        each = stats.select("k", "mass", "likelihood", F.posexplode("total").alias("i", "x"))
        got = each.groupBy("k", "i").agg(F.sum("x").alias("x"), F.sum("mass").alias("mass"), F.sum("likelihood").alias("l")).collect()
        total, mass, likelihood = np.zeros((k, dim)), np.zeros(k), 0.0
        for r in got:
            total[r["k"], r["i"]], mass[r["k"]] = r["x"], r["mass"]
            likelihood += r["l"] if r["i"] == 0 else 0.0
        length = np.linalg.norm(total, axis=1)
        r_bar = np.clip(length / np.maximum(mass, 1e-12), 1e-6, 1 - 1e-6)
        kappas = np.minimum((r_bar * dim - r_bar**3) / (1 - r_bar**2), most_kappa)
        centers = np.where(length[:, None] > 1e-12, total / np.maximum(length, 1e-12)[:, None], mixture.centers)
        mixture = Mixture(centers, mass / mass.sum(), kappas)
        if before is not None and abs(likelihood - before) <= tolerance * abs(before):
            break
        before = likelihood
    rows.unpersist()
    return mixture


def posteriors(vectors: DataFrame, mixture: Mixture) -> DataFrame:
    """(term, cluster, p) for every term with a vector."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            p = mixture.posterior(_matrix(frame["vec"])) if len(frame) else np.empty((0, len(mixture.weights)))
            yield pd.DataFrame({"term": frame["term"], "p": list(p)})

    kind = vectors.schema["term"].dataType.simpleString()
    rows = vectors.select("term", doubles(F.col("vec")).alias("vec")).mapInPandas(apply, f"term {kind}, p array<double>")
    return rows.select("term", F.posexplode("p").alias("cluster", "p"))


def hard_labels(posterior: DataFrame) -> DataFrame:
    return posterior.groupBy("term").agg(F.max_by("cluster", F.struct("p", -F.col("cluster"))).alias("label"))


def fixed_posteriors(vectors: DataFrame, centers: DataFrame, kappa: float) -> DataFrame:
    """(term, cluster, p) under given centers (cluster, mu) of equal weight and one kappa, whose normalizer cancels."""
    scored = vectors.crossJoin(F.broadcast(centers)).select("term", "cluster", F.exp(F.lit(kappa) * dot(F.col("vec"), F.col("mu"))).alias("e"))
    total = scored.groupBy("term").agg(F.sum("e").alias("all"))
    return scored.join(total, "term").select("term", "cluster", (F.col("e") / F.col("all")).alias("p"))


def cluster_terms(labels: DataFrame, cluster: int) -> DataFrame:
    return labels.where(F.col("label") == cluster).select("term")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, jaccard) of the clusters of two labelings (term, label): k x k rows."""
    na = a.groupBy(F.col("label").alias("a")).agg(F.count("*").alias("na"))
    nb = b.groupBy(F.col("label").alias("b")).agg(F.count("*").alias("nb"))
    met = a.select("term", F.col("label").alias("a")).join(b.select("term", F.col("label").alias("b")), "term")
    both = met.groupBy("a", "b").agg(F.count("*").alias("n"))
    share = F.coalesce(F.col("n"), F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce(F.col("n"), F.lit(0)))
    return na.crossJoin(nb).join(both, ["a", "b"], "left").select("a", "b", share.alias("jaccard"))


def aligned(a: DataFrame, b: DataFrame) -> dict[int, int]:
    """Labels of ``a`` -> labels of ``b``; the k x k table is on the driver.

    The labels of ``a`` choose in their order, each the one of the greatest overlap that is left, the smaller of equals.
    """
    best: dict[int, list[tuple[float, int]]] = {}
    for r in overlaps(a, b).collect():
        best.setdefault(r["a"], []).append((-round(r["jaccard"], 9), r["b"]))
    match: dict[int, int] = {}
    for label in sorted(best):
        left = sorted(x for x in best[label] if x[1] not in match.values())
        if left:
            match[label] = left[0][1]
    return match


def agreed(a: DataFrame, b: DataFrame, match: dict[int, int]) -> DataFrame:
    """(term, label): terms that both labelings put into matching clusters, by ``a``'s label."""
    pairs = F.create_map(*[F.lit(x) for p in match.items() for x in p])
    met = a.join(b.select("term", F.col("label").alias("other")), "term")
    return met.where(F.element_at(pairs, F.col("label")) == F.col("other")).select("term", "label")


def cluster_documents(labels: DataFrame, term_docs: DataFrame) -> DataFrame:
    """(label, doc, weight): documents of each cluster's terms, weighted by the sum of the links (term, doc, w)."""
    return labels.join(term_docs, "term").groupBy("label", "doc").agg(F.sum("w").alias("weight"))
