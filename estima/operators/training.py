"""Training operators: expert fit (chosen algorithm and features) and auto fit
(features ranked first, top k used)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from estima.operators.columns import split_roles
from estima.operators.importance import named_weights, rank_features
from estima.operators.models import ALIASES, pipeline_fit


def train_expert(train_df: DataFrame, features: Sequence[str], target: str, algorithm: str,
                 **params) -> tuple[PipelineModel, DataFrame]:
    """Fit ``algorithm`` on the given features; return the fitted pipeline and its
    weights per slot (coefficients, or importances for trees) with slot, feature
    and category names, ordered by absolute value."""
    model = pipeline_fit(train_df, list(features), target, ALIASES.get(algorithm, algorithm), **params)
    return model, named_weights(model, train_df.sparkSession)


def train_auto(train_df: DataFrame, target: str, k: int = 2, algorithm: str | None = None,
               candidates: Sequence[str] | None = None, rank_params: dict | None = None,
               **params) -> tuple[PipelineModel, list[str], DataFrame]:
    """Rank candidate features with a forest, keep the top ``k`` (capped by the
    number of candidates) and fit ``algorithm`` (default ``random_forest``) on them.
    Returns the model, the chosen features and the ranking table."""
    if candidates is None:
        num, cat = split_roles(train_df.drop(target))
        candidates = num + cat
    ranking = rank_features(train_df, target, list(candidates), **(rank_params or {}))
    chosen = [r["feature"] for r in ranking.limit(min(k, len(candidates))).collect()]
    algo = ALIASES.get(algorithm or "random_forest", algorithm or "random_forest")
    return pipeline_fit(train_df, chosen, target, algo, **params), chosen, ranking
