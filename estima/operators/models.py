"""Regressors and their fitting.

``ridge`` and ``lasso`` are Spark's ``LinearRegression`` with the penalty scaled
to the least-squares objective of the reference (sum of squares + alpha * ||w||);
``xgboost`` boosts on the second order of the loss (:mod:`estima.operators.boosting`),
``random_forest`` to Spark's forest. Fitting is Spark ML's own distributed work
(Gram matrix by tree aggregation for ridge, binned histograms for trees).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.regression import LinearRegressionModel
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.operators.boosting import BoostedTrees
from estima.operators.columns import split_roles, validate_columns
from estima.operators.encode import FEATURES_COL, O_PREFIX, preprocess
from estima.operators.forest import RandomForest
from estima.operators.lasso import LassoRegression
from estima.operators.ridge import RidgeStatistics, linear_model, vector_width

LABEL_COL = "__label"


class RidgeRegression(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol,
                      DefaultParamsReadable, DefaultParamsWritable):
    """Least squares with an L2 penalty ``alpha * ||w||^2`` and a free intercept, solved from
    sufficient statistics with the widest one-hot block eliminated: one way for any width."""

    alpha = Param(Params._dummy(), "alpha", "L2 penalty weight", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, alpha=1.0, featuresCol=FEATURES_COL, labelCol=LABEL_COL,
                 predictionCol="prediction"):
        super().__init__()
        self._setDefault(alpha=1.0, featuresCol=FEATURES_COL, labelCol=LABEL_COL, predictionCol="prediction")
        self._set(**self._input_kwargs)

    def setAlpha(self, v):
        return self._set(alpha=v)

    def getAlpha(self):
        return self.getOrDefault(self.alpha)

    def statistics(self, df: DataFrame) -> RidgeStatistics:
        feats = self.getFeaturesCol()
        return RidgeStatistics(df, feats, self.getLabelCol(), vector_width(df, feats), widest_block(df, feats))

    def model(self, intercept: float, weights) -> LinearRegressionModel:
        return linear_model(intercept, weights, self.getFeaturesCol(), self.getLabelCol(), self.getPredictionCol())

    def _fit(self, df: DataFrame):
        stats = self.statistics(df)
        try:
            return self.model(*stats.fits([self.getAlpha()])[0])
        finally:
            stats.release()


def widest_block(df: DataFrame, col: str) -> tuple[int, int] | None:
    """First slot and size of the widest one-hot block of an assembled vector: its blocks follow each
    other in the order of the one-hot columns beside it. None without them: all slots count as narrow."""
    meta = {c: df.schema[c].metadata.get("ml_attr", {}) for c in df.columns}
    at = min((a["idx"] for a in meta[col].get("attrs", {}).get("binary", [])), default=0)
    sizes = [m["num_attrs"] for c, m in meta.items() if c.startswith(O_PREFIX) and "num_attrs" in m]
    if at + sum(sizes) != vector_width(df, col) or not sizes:
        return None
    widest = max(sizes)
    return at + sum(sizes[:sizes.index(widest)]), widest


# Other names of the algorithms.
ALIASES = {"randomforest": "random_forest", "gbt": "xgboost", "boosted_trees": "xgboost"}


# Execution settings for tree learners (results do not depend on them): node ids
# are cached between levels instead of recomputed, with their lineage cut every
# 10 iterations in the shared checkpoint folder; node statistics get more memory
# so that fewer passes per level are needed.
_TREE_EXEC = {"cacheNodeIds": True, "checkpointInterval": 10, "maxMemoryInMB": 512}


def make_regressor(algorithm: str, **params):
    """Estimator for an algorithm name; unknown names raise ``ValueError``.

    ridge: alpha 1.0. xgboost: 100 rounds, depth 6, step 0.3, leaf penalty 1, squared loss.
    random_forest: 100 trees, seed 0, every feature considered at each split;
    Spark trees need a depth bound (default 8 here; at most 30)."""
    name = ALIASES.get(algorithm, algorithm)
    if name == "ridge":
        return RidgeRegression(alpha=float(params.get("alpha", 1.0)))
    if name == "lasso":
        return LassoRegression(alpha=float(params.get("alpha", 1.0)), featuresCol=FEATURES_COL, labelCol=LABEL_COL)
    if name == "xgboost":
        return BoostedTrees(featuresCol=FEATURES_COL, labelCol=LABEL_COL, rounds=int(params.get("n_estimators", 100)),
                            depth=int(params.get("max_depth", 6)), rate=float(params.get("learning_rate", 0.3)),
                            penalty=float(params.get("reg_lambda", 1.0)), bins=int(params.get("max_bins", 256)))
    if name == "random_forest":
        return RandomForest(featuresCol=FEATURES_COL, labelCol=LABEL_COL,
                            numTrees=int(params.get("n_estimators", 100)), seed=0,
                            featureSubsetStrategy="all", maxDepth=int(params.get("max_depth", 8)),
                            maxBins=int(params.get("max_bins", 64)),
                            subsamplingRate=float(params.get("subsample", 1.0)), **_TREE_EXEC)
    raise ValueError(f"Unknown algorithm: {algorithm}")


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with every given column present (missing rows are left out of fits)."""
    return df.na.drop(subset=list(columns))


def model_pipeline(numeric: Sequence[str], categorical: Sequence[str], target: str,
                   algorithm: str = "ridge", **params) -> Pipeline:
    """Unfitted pipeline: label copy, preprocessing, regressor."""
    from pyspark.ml.feature import SQLTransformer
    label = SQLTransformer(statement=f"SELECT *, CAST(`{target}` AS DOUBLE) AS `{LABEL_COL}` FROM __THIS__")
    return Pipeline(stages=[label, *preprocess(numeric, categorical), make_regressor(algorithm, **params)])


#: Rows from which a fit of many passes deals its table over all cores; rows of a task then.
SPREAD_ROWS = 100_000
ROWS_PER_TASK = 1_000_000


def spread(data: DataFrame) -> DataFrame:
    """Persisted ``data`` with its rows dealt evenly where a few tasks hold most of them, as when a file has
    one row group: every pass of a fit would run on these tasks alone. Few rows stay as they are."""
    from pyspark import StorageLevel
    held = [r["count"] for r in data.groupBy(F.spark_partition_id().alias("part")).count().collect()]  # one row a task
    total, cores = sum(held), data.sparkSession.sparkContext.defaultParallelism
    if total < SPREAD_ROWS or max(held) * cores <= 2 * total:
        return data
    even = data.repartition(max(cores, -(-total // ROWS_PER_TASK))).persist(StorageLevel.MEMORY_AND_DISK)
    even.count()
    data.unpersist()
    return even


def pipeline_fit(df: DataFrame, features: Sequence[str], target: str, algorithm: str = "ridge",
                 persist: bool = True, **params) -> PipelineModel:
    """Fit preprocessing and model as one unit on the complete rows of ``df``.

    The stages read their input several times (indexer, scaler, label statistics,
    solver), so the narrow projection of features and target is persisted
    (memory, spilling to disk; lost blocks are recomputed from lineage) for the
    duration of the fit."""
    from pyspark import StorageLevel
    validate_columns(df, [*features, target])
    num, cat = split_roles(df, features)
    # the boosting learns where missing values go; the others leave such rows out
    boosting = ALIASES.get(algorithm, algorithm) == "xgboost"
    data = complete_rows(df.select(*features, target), [target] if boosting else [*features, target])
    if persist and not df.isStreaming:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
        if ALIASES.get(algorithm, algorithm) in ("random_forest", "xgboost"):
            data = spread(data)
    try:
        return model_pipeline(num, cat, target, algorithm, **params).fit(data)
    finally:
        if persist:
            data.unpersist()


def regressor_stage(model: PipelineModel):
    return model.stages[-1]


def linear_terms(model: PipelineModel, width: int) -> tuple[float, list[float]]:
    """Intercept and per-slot coefficients of a fitted linear pipeline."""
    reg = regressor_stage(model)
    return float(reg.intercept), [float(w) for w in reg.coefficients.toArray()]


def scoring_model(model: PipelineModel) -> PipelineModel:
    """The fitted pipeline without its label stage, if it has one (rows to score
    have no target)."""
    from pyspark.ml.feature import SQLTransformer
    first = model.stages[0] if model.stages else None
    if isinstance(first, SQLTransformer) and f"AS `{LABEL_COL}`" in first.getStatement():
        return PipelineModel(stages=model.stages[1:])
    return model
