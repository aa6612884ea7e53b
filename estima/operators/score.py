"""Scoring: apply a fitted pipeline to rows (batch, inline, streaming), guard
inputs against the model's known features and categories.

``transform`` is narrow (no shuffle); the guard's category check is a left-anti
join against the model's category table, which has one row per one-hot slot and
is therefore broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.operators.columns import append_prediction
from estima.operators.encode import category_labels, fitted_roles, known_categories
from estima.operators.models import scoring_model
from estima.sources.inline import inline_source

# A model may have any number of one-hot slots: up to this bound its categories are broadcast.
_MAX_BROADCAST_CATEGORIES = 200_000


def predict(model: PipelineModel, df: DataFrame, prediction_col: str = "prediction") -> DataFrame:
    """Input columns plus ``prediction`` (the model's own stages, no label needed)."""
    m = scoring_model(model)
    out = m.transform(df)
    return out.select(*df.columns, F.col("prediction").alias(prediction_col))


def score_batch(model: PipelineModel, df: DataFrame, target: str | None = None,
                replace: bool = False) -> DataFrame:
    """Score a table; prediction appended as ``prediction`` or, with
    ``replace=True``, under the target's name (the reference's batch behaviour)."""
    return append_prediction(scoring_model(model).transform(df), df.columns, target, replace=replace)


def model_features(model: PipelineModel, spark, target: str | None = None) -> DataFrame:
    """``(feature, kind)``: Numerical / Categorical per model feature, plus the target."""
    num, cat = fitted_roles(model)
    rows = [(c, "Numerical") for c in num] + [(c, "Categorical") for c in cat]
    if target:
        rows.append((target, "Target"))
    return spark.createDataFrame(rows, "feature string, kind string")


def feature_types(model: PipelineModel) -> dict[str, str]:
    num, cat = fitted_roles(model)
    return {**{c: "double" for c in num}, **{c: "string" for c in cat}}


def score_inline(model: PipelineModel, requests: DataFrame, request_col: str,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Score ``name:value,...`` request strings: parse, cast, predict."""
    parsed = inline_source(requests, request_col, feature_types(model), keep=list(keep))
    return predict(model, parsed)


def score_guard(model: PipelineModel, df: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Rows that cannot be scored faithfully: ``(key..., feature, problem, value)``
    with problem ``missing_column`` (key null), ``null_value`` or
    ``unseen_category``."""
    spark = df.sparkSession
    num, cat = fitted_roles(model)
    missing = [c for c in num + cat if c not in df.columns]
    parts = []
    if missing:
        parts.append(spark.createDataFrame([(c,) for c in missing], "feature string").select(
            *[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in key_cols], "feature",
            F.lit("missing_column").alias("problem"), F.lit(None).cast("string").alias("value")))
    present = [c for c in num + cat if c in df.columns]
    if present:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value"),
                                             F.lit(c in cat).alias("is_cat")) for c in present]))
        long = df.select(*key_cols, cells.alias("__c")).select(*key_cols, "__c.*")
        # a NaN predicts NaN, so it is as good as missing
        nulls = long.where(F.col("value").isNull() | (~F.col("is_cat") & (F.col("value") == "NaN"))).select(
            *key_cols, "feature", F.lit("null_value").alias("problem"), "value")
        parts.append(nulls)
        if cat:
            known = known_categories(model, spark).select("feature", F.col("category").alias("value"))
            n_known = sum(len(v) for v in category_labels(model).values())
            if n_known <= _MAX_BROADCAST_CATEGORIES:
                known = F.broadcast(known)
            unseen = long.where(F.col("is_cat") & F.col("value").isNotNull()).join(
                known, ["feature", "value"], "left_anti").select(
                *key_cols, "feature", F.lit("unseen_category").alias("problem"), "value")
            parts.append(unseen)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def format_prediction(df: DataFrame, col: str = "prediction", out_col: str = "prediction_text") -> DataFrame:
    """The prediction as text with two decimals (``%.2f``)."""
    return df.withColumn(out_col, F.format_string("%.2f", F.col(col)))
