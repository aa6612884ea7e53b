"""Scoring plan: load a saved model, guard the input, score, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from estima.operators.score import fitted_roles, score_batch, score_guard
from estima.sources.registry import model_load, score_sink


def score(spark: SparkSession, model_dir: str, df: DataFrame, key_cols: Sequence[str] = (),
          out_path: str | None = None, replace: bool = False, fmt: str = "parquet"):
    """Score ``df`` with the model saved at ``model_dir``.

    Returns ``(scored, problems)``; ``problems`` lists rows with null features or
    unseen categories (empty when the input is clean). If a feature column is missing, nothing is
    scored: ``scored`` is None and ``problems`` names the column. Writes ``scored`` to
    ``out_path`` when given (never in place)."""
    bundle = model_load(spark, model_dir)
    target = bundle.metadata.get("target_feature")
    num, cat = fitted_roles(bundle.model)
    problems = score_guard(bundle.model, df, list(key_cols)) if key_cols else None
    if any(c not in df.columns for c in num + cat):
        return None, score_guard(bundle.model, df, list(key_cols))
    scored = score_batch(bundle.model, df, target, replace=replace)
    if out_path:
        score_sink(scored, out_path, fmt)
    return scored, problems
