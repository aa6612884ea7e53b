"""Ridge by sufficient statistics, the widest one-hot block eliminated.

Least squares with a penalty ``alpha * ||w||^2`` and a free intercept needs only sums: of the
narrow slots R (the intercept, numbers, the other one-hot blocks) their cross sums, and for each
category k of the widest block its count n_k, its sum of targets s_k and its sums c_k of R. A row
has one category of a block at most, so the block's own part of the normal equations is diagonal and goes:

    (A - sum_k c_k c_k' / (n_k + alpha)) w = A_y - sum_k c_k s_k / (n_k + alpha),
    w_k = (s_k - c_k' w) / (n_k + alpha)

Only the narrow system reaches the driver. The statistics are gathered once and serve every
``alpha``; targets are taken from their mean, so no digits are lost to a large offset.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories whose sums travel as one row.
BLOCK = 1024
#: Slots up to which a vector is handed to Python as a plain array.
MOST_DENSE = 256


def handed(features: str, slots: int) -> Column:
    """A vector column as it goes to Python: a narrow one as a plain array, since Spark hands over the
    fields of a vector row by row at some ten times the cost; a wide one as it is, so that it stays sparse."""
    return F.when(F.col(features).isNotNull(), vector_to_array(features)) if slots <= MOST_DENSE else F.col(features)


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of the entries of a column from :func:`handed`: arrays, or ML vectors, dense rows and sparse ones."""
    plain = pa.types.is_list(column.type)
    kind, indices, values = (None, None, column) if plain else (column.field(i) for i in (0, 2, 3))
    size = np.diff(values.offsets.to_numpy()) if len(values) else np.zeros(0, np.int64)
    size = np.where(values.is_valid().to_numpy(zero_copy_only=False), size, 0)
    row = np.repeat(np.arange(len(column)), size)
    value = np.asarray(values.flatten().to_numpy(zero_copy_only=False), float)
    slot = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    if plain:
        return row, slot, value
    sparse = (kind.to_numpy(zero_copy_only=False) == 0)[row]
    slot[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    return row, slot, value


def linear_model(intercept: float, weights, features_col: str, label_col: str,
                 prediction_col: str = "prediction") -> LinearRegressionModel:
    """A linear model of given weights as Spark ML's own model (scores, saves and loads as one)."""
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.util import _jvm
    uid = LinearRegression().uid
    vector = _py2java(SparkContext._active_spark_context, Vectors.dense(weights))
    made = LinearRegressionModel(_jvm().org.apache.spark.ml.regression.LinearRegressionModel(uid, vector, float(intercept)))
    made._resetUid(uid)
    made._set(featuresCol=features_col, labelCol=label_col, predictionCol=prediction_col)
    made._transfer_params_to_java()
    return made


def vector_width(df: DataFrame, col: str) -> int:
    """Slots of an assembled vector column, from its ML metadata (no data read)."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    first = df.select(col).first()
    return first[0].size if first is not None else 0


class RidgeStatistics:
    """Sums of one table of (vector, target); ``wide``: first slot and size of the widest block."""

    def __init__(self, df: DataFrame, features: str, label: str, slots: int, wide: tuple[int, int] | None):
        self.slots = slots
        self.first, self.size = wide or (slots, 0)
        self.narrow = np.array([i for i in range(slots) if not self.first <= i < self.first + self.size], np.int64)
        r = df.agg(F.count(label).alias("n"), F.avg(F.col(label).cast("double")).alias("mean")).first()
        self.n, self.mean = r["n"], r["mean"] or 0.0
        sums = df.select(handed(features, slots).alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(self._sums(), "part int, data binary")
        self.sums = sums.groupBy("part").applyInArrow(self._added, "part int, data binary").persist(StorageLevel.MEMORY_AND_DISK)
        own = self.sums.where("part < 0").collect()  # the narrow system
        width = len(self.narrow) + 1
        self.gram = np.frombuffer(own[0]["data"]).reshape(width, width + 1) if own else np.zeros((width, width + 1))

    def _sums(self):
        first, size, narrow, mean = self.first, self.size, self.narrow, self.mean
        place = np.full(self.slots, -1, np.int64)
        place[narrow] = np.arange(1, len(narrow) + 1)
        width = len(narrow) + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gram, block = np.zeros((width, width + 1)), np.zeros((size, width + 1))
            for batch in batches:
                for a in range(0, batch.num_rows, 10_000):
                    rows = batch.slice(a, 10_000)
                    x = np.zeros((rows.num_rows, width + 1))
                    x[:, 0], x[:, width] = 1, rows.column("y").to_numpy(zero_copy_only=False) - mean
                    row, slot, value = entries(pa.concat_arrays([rows.column("x")]))
                    at = place[slot]
                    x[row[at >= 0], at[at >= 0]] = value[at >= 0]
                    gram += x[:, :width].T @ x
                    hit = (at < 0) & (value != 0)
                    r, k = row[hit], slot[hit] - first
                    if len(r):
                        order = np.argsort(k, kind="stable")
                        r, k = r[order], k[order]
                        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                        block[k[new]] += np.add.reduceat(x[r], new, axis=0)
            parts, data = [-1], [gram.tobytes()]
            for b in range(0, size, BLOCK):
                if block[b:b + BLOCK].any():
                    parts.append(b // BLOCK)
                    data.append(block[b:b + BLOCK].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])
        return run

    @staticmethod
    def _added(group: pa.Table) -> pa.Table:
        # in the order of the values, so that a repeated task adds alike
        total = sum(np.frombuffer(x) for x in sorted(group.column("data").to_pylist()))
        return pa.table({"part": group.column("part").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    def fits(self, alphas: Sequence[float]) -> list[tuple[float, np.ndarray]]:
        """(intercept, weights of all slots) for each penalty."""
        width, alphas = len(self.narrow) + 1, [float(a) for a in alphas]
        blocks = self.sums.where("part >= 0")

        def eliminated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    c = np.frombuffer(data).reshape(-1, width + 1)
                    c = c[c[:, 0] > 0]
                    less = [(c[:, :width] / (c[:, :1] + a)).T @ c for a in alphas]
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.stack(less).tobytes()], pa.binary())], ["part", "data"])

        less = np.zeros((len(alphas), width, width + 1))
        if self.size:
            # one narrow system a block of categories
            for r in sorted(blocks.mapInArrow(eliminated, "part int, data binary").collect(), key=lambda r: r["part"]):
                less += np.frombuffer(r["data"]).reshape(less.shape)
        out = []
        for a, minus in zip(alphas, less, strict=True):
            system = self.gram - minus
            system[np.arange(1, width), np.arange(1, width)] += a
            # a narrow slot that never varies makes a zero row without a penalty
            w = np.linalg.lstsq(system[:, :width], system[:, width], rcond=None)[0] if a <= 0 else np.linalg.solve(system[:, :width], system[:, width])
            weights = np.zeros(self.slots)
            weights[self.narrow] = w[1:]
            out.append((w, weights))
        if self.size:
            narrow = [w for w, _ in out]

            def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for part, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                        c = np.frombuffer(data).reshape(-1, width + 1)
                        with np.errstate(divide="ignore", invalid="ignore"):
                            got = [np.where(c[:, 0] > 0, (c[:, width] - c[:, :width] @ w) / (c[:, 0] + a), 0.0) for a, w in zip(alphas, narrow, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.stack(got).tobytes()], pa.binary())], ["part", "data"])

            for r in blocks.mapInArrow(solved, "part int, data binary").collect():  # as many numbers as the model has slots
                got = np.frombuffer(r["data"]).reshape(len(alphas), -1)
                for (_, weights), g in zip(out, got, strict=True):
                    at = self.first + r["part"] * BLOCK
                    weights[at:at + len(g)] = g
        return [(float(w[0]) + self.mean, weights) for w, weights in out]

    def release(self) -> None:
        self.sums.unpersist()


def wide_ridge(df: DataFrame, category: str, numeric: Sequence[str], target: str, alpha: float = 1.0) -> tuple[float, dict[str, float], DataFrame]:
    """Ridge of ``target`` on the one-hot ``category`` and standardised numbers, for any number of
    categories: intercept, weights of the numbers, and a DataFrame (category, n, weight) that never
    reaches the driver. Rows with a missing value are left out."""
    rows = df.select(F.col(category).cast("string").alias("category"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(numeric)],
                     F.col(target).cast("double").alias("y")).na.drop()
    d = len(numeric)
    xs = [f"x{i}" for i in range(d)]
    r = rows.agg(F.avg("y").alias("y"), *[f(c).alias(f"{n}{c}") for c in xs for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if r["y"] is None:
        return 0.0, dict.fromkeys(numeric, 0.0), rows.select("category", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("weight")).limit(0)
    z = [((F.col(c) - r[f"m{c}"]) / (r[f"s{c}"] or 1.0)).alias(c) for c in xs]
    rows = rows.select("category", *z, (F.col("y") - r["y"]).alias("y"))
    # a category's sums of the intercept's ones (its count), the numbers and the target
    per = rows.groupBy("category").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in xs], F.sum("y").alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
    names = ["n", *xs]
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    less = per.agg(*[F.sum(F.col(names[i]) * F.col(names[j]) / (F.col("n") + alpha)).alias(f"a{i}_{j}") for i, j in pairs],
                   *[F.sum(F.col(names[i]) * F.col("y") / (F.col("n") + alpha)).alias(f"b{i}") for i in range(d + 1)]).first()
    ones = [F.lit(1.0), *[F.col(c) for c in xs]]
    full = rows.agg(*[F.sum(ones[i] * ones[j]).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(ones[i] * F.col("y")).alias(f"b{i}") for i in range(d + 1)]).first()
    a, b = np.zeros((d + 1, d + 1)), np.zeros(d + 1)
    for i, j in pairs:
        a[i, j] = a[j, i] = full[f"a{i}_{j}"] - less[f"a{i}_{j}"] + (alpha if i == j > 0 else 0.0)
    for i in range(d + 1):
        b[i] = full[f"b{i}"] - less[f"b{i}"]
    w = np.linalg.lstsq(a, b, rcond=None)[0]
    fit = sum((F.col(n) * float(v) for n, v in zip(names, w, strict=True)), F.lit(0.0))
    weights = per.select("category", "n", ((F.col("y") - fit) / (F.col("n") + alpha)).alias("weight"))
    return float(w[0]) + r["y"], {c: float(v) for c, v in zip(numeric, w[1:], strict=True)}, weights
