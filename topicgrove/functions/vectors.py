"""Vector expressions over ARRAY<DOUBLE> and the log-normalizer of the von Mises-Fisher density."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def difference_norm(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def log_bessel(order: float, x: np.ndarray) -> np.ndarray:
    """ln I_order(x): the power series up to 1000, beyond it the uniform asymptotic expansion to the second term."""
    x = np.asarray(x, float)
    small = np.minimum(x, 1000.0)
    k = np.arange(1, 64 + 2 * int(np.ceil(small.max(initial=1.0))))
    steps = 2 * np.log(small / 2)[..., None] - np.log(k) - np.log(order + k)
    terms = np.concatenate([np.zeros((*x.shape, 1)), np.cumsum(steps, axis=-1)], axis=-1)
    top = terms.max(axis=-1, keepdims=True)
    series = order * np.log(small / 2) - math.lgamma(order + 1) + top[..., 0] + np.log(np.exp(terms - top).sum(axis=-1))
    z = x / order
    root = np.sqrt(1 + z * z)
    t = 1 / root
    wide = order * (root + np.log(z / (1 + root))) - 0.5 * np.log(2 * math.pi * order) - 0.5 * np.log(root) + np.log1p((3 * t - 5 * t**3) / 24 / order)
    return np.where(x <= 1000, series, wide)


def vmf_log_normalizer(kappa: np.ndarray, dim: int) -> np.ndarray:
    order = dim / 2 - 1
    return order * np.log(kappa) - dim / 2 * math.log(2 * math.pi) - log_bessel(order, kappa)
