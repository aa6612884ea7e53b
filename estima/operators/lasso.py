"""Lasso by coordinate descent on the Gram matrix, with a certificate.

``1/(2n) SSE + alpha ||w||_1`` with a free intercept depends on the rows only through their Gram
matrix, which the rows are read for once (:class:`estima.operators.ridge.RidgeStatistics`); the
descent then runs on slots x slots numbers. It ends when the subgradient conditions hold, not
when steps get small: the mean of x_j times the residual is alpha * sign(w_j) where a weight is,
and at most alpha where none is. :func:`certificate` measures the same conditions of any fitted linear model
on the rows themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.operators.ridge import RidgeStatistics, linear_model, vector_width

#: Largest violation of the conditions, as a share of the largest |mean of x_j y|.
TOLERANCE = 1e-12
MOST_SWEEPS = 100_000


def descent(gram: np.ndarray, target: np.ndarray, alpha: float, tolerance: float = TOLERANCE, sweeps: int = MOST_SWEEPS) -> tuple[np.ndarray, float]:
    """Weights for centred mean products ``gram`` (slots x slots) and ``target``, and their violation."""
    w, left = np.zeros(len(target)), target.copy()  # left: mean of x_j times the residual
    own = np.diag(gram).copy()
    scale = max(np.abs(target).max(initial=0.0), 1e-300)
    for sweep in range(sweeps):
        for j in np.flatnonzero(own > 1e-14 * own.max(initial=0.0)):
            new = left[j] + own[j] * w[j]
            new = np.sign(new) * max(abs(new) - alpha, 0.0) / own[j]
            if new != w[j]:
                left -= gram[:, j] * (new - w[j])
                w[j] = new
        if violation(w, left, alpha) <= tolerance * scale:
            break
        if sweep % 50 == 49:
            left = target - gram @ w  # steps leave rounding behind
    return w, violation(w, target - gram @ w, alpha)


def violation(w: np.ndarray, left: np.ndarray, alpha: float) -> float:
    """How far the subgradient conditions are from holding."""
    off = np.where(w != 0, np.abs(left - alpha * np.sign(w)), np.maximum(np.abs(left) - alpha, 0.0))
    return float(off.max(initial=0.0))


class LassoRegression(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """L1-penalised least squares ``1/(2n) SSE + alpha ||w||_1`` with a free intercept."""

    alpha = Param(Params._dummy(), "alpha", "L1 penalty weight", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, alpha=1.0, featuresCol="features", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(alpha=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        feats, label, alpha = self.getFeaturesCol(), self.getLabelCol(), self.getOrDefault(self.alpha)
        stats = RidgeStatistics(df, feats, label, vector_width(df, feats), None)
        n, sums = max(stats.n, 1), stats.gram  # columns: ones, slots, target from its mean
        stats.release()
        mean = sums[0, 1:-1] / n
        gram = sums[1:, 1:-1] / n - np.outer(mean, mean)
        w, _ = descent(gram, sums[1:, -1] / n - mean * sums[0, -1] / n, alpha)
        return linear_model(stats.mean + sums[0, -1] / n - float(mean @ w), w, feats, label, self.getPredictionCol())


def certificate(df: DataFrame, weights: list[float], intercept: float, alpha: float, features: str = "features", label: str = "label") -> DataFrame:
    """``(slot, weight, gradient, violation)`` of a linear model on rows with an assembled vector: the mean of
    each slot times the residual, both from their means, and how far the condition is from holding."""
    slots = len(weights)
    x = vector_to_array(features)
    fit = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(float(intercept)), lambda a, b: a + b)
    rows = df.select(x.alias("x"), (F.col(label).cast("double") - fit).alias("e"))
    long = rows.select("e", F.posexplode("x").alias("slot", "v"))
    grads = long.groupBy("slot").agg(F.covar_pop("v", "e").alias("gradient"))
    given = df.sparkSession.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "slot int, weight double") if slots else None
    met = grads.join(F.broadcast(given), "slot")  # one row a slot
    off = F.when(F.col("weight") != 0, F.abs(F.col("gradient") - alpha * F.signum("weight"))).otherwise(F.greatest(F.abs("gradient") - alpha, F.lit(0.0)))
    return met.select("slot", "weight", "gradient", off.alias("violation"))
