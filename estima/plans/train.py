"""Training plan: check, screen, choose features, split, fit, evaluate, save.

Each step is a lazy DataFrame plan or a Spark ML fit; the only values brought to
the driver are small (flags, a ranking, metrics, the fitted model)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estima.operators import evaluate as ev
from estima.operators.columns import split_roles, validate_columns
from estima.operators.importance import rank_features
from estima.operators.models import ALIASES, complete_rows
from estima.operators.profile import high_variation, no_variation, profile_numeric
from estima.operators.quality import (QualityError, check_empty, check_header, check_mixed_types, check_readable,
                                      missing_by_column)
from estima.operators.score import predict
from estima.operators.split import split_train_test
from estima.operators.training import train_expert
from estima.sources.csv import na_normalise, read_csv_text, scan_csv, sniff_delimiter
from estima.sources.registry import default_model_dir, model_metadata, model_save


@dataclass
class TrainResult:
    model: PipelineModel
    algorithm: str
    features: list[str]
    target: str
    metrics: DataFrame
    flags: DataFrame
    weights: DataFrame | None = None
    ranking: DataFrame | None = None
    predictions: DataFrame | None = None
    profile: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    def metadata(self) -> DataFrame:
        r2 = self.metrics.first()["r2"]
        return model_metadata(self.metrics.sparkSession, self.algorithm, self.features, self.target, r2)

    def release(self) -> None:
        """Unpersist the split input kept for the lazy tables of this result."""
        data = self.extra.get("data")
        if data is not None:
            data.unpersist()

    def save(self, base_dir: str, path: str | None = None) -> str:
        path = path or default_model_dir(base_dir, self.algorithm, self.target)
        return model_save(self.model, self.metadata(), path)


def train(df: DataFrame, target: str, key_cols: Sequence[str], features: Sequence[str] | None = None,
          algorithm: str | None = None, expert: bool = False, k: int = 2, drop: Sequence[str] = (),
          leaky: bool = False, test_pct: int = 20, persist: bool = True, **params) -> TrainResult:
    """Train a price model.

    * ``features`` given: used as is (validated). Otherwise the features are
      ranked by a forest's importances on the training rows (``leaky=True``: all
      rows, as the reference does) and, in auto mode, the top ``k`` are used.
    * ``algorithm``: ``ridge``, ``xgboost`` or ``random_forest`` (default in auto
      mode); expert mode requires it.
    * Low-information columns are flagged (never dropped implicitly); ``drop``
      removes chosen columns, the target is protected.
    """
    validate_columns(df, [target, *key_cols])
    if expert and not algorithm:
        raise ValueError("expert mode needs an algorithm")
    algorithm = ALIASES.get(algorithm or "random_forest", algorithm or "random_forest")
    check_empty(df, strict=True)
    flags = (no_variation(df.drop(*key_cols)).select("column", F.lit("no_variation").alias("rule"),
                                                   F.lit(None).cast("double").alias("value"))
             .unionByName(high_variation(df.drop(*key_cols))))
    data = df.drop(*[c for c in drop if c != target and c not in key_cols])
    data = split_train_test(data, key_cols, test_pct)
    if persist:
        data = data.persist(StorageLevel.MEMORY_AND_DISK)
    train_df = data.where(~F.col("is_test"))
    ranking = None
    if features is None:
        num, cat = split_roles(data.drop(target, "is_test", *key_cols))
        candidates = num + cat
        ranking = rank_features(data if leaky else train_df, target, candidates,
                                max_depth=params.get("rank_depth", 8), n_estimators=params.get("rank_trees", 100))
        if expert:
            features = candidates
        else:
            features = [r["feature"] for r in ranking.limit(min(k, len(candidates))).collect()]
    features = validate_columns(data, list(features))
    model_params = {p: v for p, v in params.items() if p not in ("rank_depth", "rank_trees")}
    model, weights = train_expert(train_df, features, target, algorithm, **model_params)
    test_df = complete_rows(data.where(F.col("is_test")), [*features, target])
    preds = predict(model, test_df.select(*key_cols, *features, target))
    metrics = ev.significance_notes(ev.metrics(preds, target))
    return TrainResult(model=model, algorithm=algorithm, features=list(features), target=target,
                       metrics=metrics, flags=flags, weights=weights, ranking=ranking, predictions=preds,
                       profile=profile_numeric(data.drop("is_test", *key_cols)) if expert else None, extra={"data": data})


def checked_csv(spark: SparkSession, path: str, sep: str | None = None, multi_line: bool = False,
                allow_missing: bool = False) -> DataFrame:
    """Typed read of a CSV file or folder after all input checks: rows, header cells, malformed
    rows, missing cells, columns that mix numbers and words. The first violated check raises
    :class:`QualityError` and names what it found (``allow_missing`` skips the missing cells)."""
    sep = sep or sniff_delimiter(spark, path)
    blank = check_header(spark, path, sep).limit(5).collect()
    if blank:
        raise QualityError(f"blank header cells: {[(r['file_path'], r['position']) for r in blank]}")
    check_readable(spark, path, sep=sep, strict=True, multi_line=multi_line)
    text = read_csv_text(spark, path, sep, multi_line)
    check_empty(text, strict=True)
    if not allow_missing:
        missing = {r["column"]: r["n_missing"] for r in missing_by_column(text).where("n_missing > 0").collect()}
        if missing:
            raise QualityError(f"missing cells: {missing}")
    check_mixed_types(na_normalise(text), strict=True)
    return scan_csv(spark, path, sep, multi_line=multi_line)


def train_csv(spark: SparkSession, path: str, target: str, key_cols: Sequence[str], sep: str | None = None,
              multi_line: bool = False, allow_missing: bool = False, **options) -> TrainResult:
    """:func:`train` on a CSV file or folder that passes all input checks."""
    return train(checked_csv(spark, path, sep, multi_line, allow_missing), target, key_cols, **options)
