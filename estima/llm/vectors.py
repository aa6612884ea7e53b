"""Helpers for vector columns: what counts as a vector, samples and centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estima.llm.common import least_hashes


def usable(c: Column) -> Column:
    """True for a vector that is not null, empty or zero and has only finite components."""
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``dim`` numbers, in double precision."""
    values = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return np.asarray(values.to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by the largest component first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sampled(rows: DataFrame, key: str, column: str, dim: int, most: int) -> np.ndarray:
    """At most ``most`` unit vectors, chosen by a hash of the key, on the driver."""
    got = least_hashes(rows.select(key, column), most, key, column).select(column).collect()
    return unit(np.array([r[0] for r in got], np.float64).reshape(-1, dim)) if got else np.zeros((0, dim))


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from rows spread over the sample; the same on every run."""
    k = min(k, len(x))
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy() if k else x[:0]
    for _ in range(rounds):
        at = nearest(x, centroids)
        size = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        centroids = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray, n: int = 0) -> np.ndarray:
    """The nearest centroid of each row, or its ``n`` nearest in order."""
    near = x @ centroids.T - 0.5 * (centroids**2).sum(axis=1)
    return np.argsort(-near, axis=1, kind="stable")[:, :n] if n else np.argmax(near, axis=1)
