"""Weights, importances, feature ranking and selection.

Model weights are per vector slot; the slot table (``encode.slot_names``) maps
slots to original features by an equi-join on the slot id. Tables here have one
row per slot or feature (small), so single-partition windows are acceptable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estima.operators.columns import split_roles
from estima.operators.encode import slot_names
from estima.operators.models import complete_rows, pipeline_fit, regressor_stage, spread


def model_weights(model: PipelineModel, spark) -> DataFrame:
    """``(slot, weight)``: linear coefficients, or tree importances (sum to 1)."""
    from estima.operators.encode import slot_rows
    from estima.operators.models import linear_terms
    reg = regressor_stage(model)
    if hasattr(reg, "featureImportances"):
        vals = [float(v) for v in reg.featureImportances.toArray()]
    else:
        vals = linear_terms(model, len(slot_rows(model)))[1]
    return spark.createDataFrame(list(enumerate(vals)), "slot int, weight double")


def named_weights(model: PipelineModel, spark) -> DataFrame:
    """Weights joined to the slot table, ordered by |weight| descending."""
    w = model_weights(model, spark)
    return (w.join(slot_names(model, spark), "slot")
            .select("slot", "slot_name", "feature", "category", "weight")
            .orderBy(F.desc(F.abs("weight")), "slot"))


def sort_abs_weight(df: DataFrame, col: str = "weight", tie: str = "slot") -> DataFrame:
    return df.orderBy(F.desc(F.abs(col)), tie)


def importance_by_feature(weights: DataFrame, value_col: str = "weight") -> DataFrame:
    """Sum of slot values per original feature: ``(feature, importance)``."""
    return weights.groupBy("feature").agg(F.sum(value_col).alias("importance"))


def importance_share(df: DataFrame, col: str = "importance", decimals: int = 2) -> DataFrame:
    """``importance_pct`` = importance / total x 100, rounded (one row per feature,
    so the whole-table window is small)."""
    total = F.sum(col).over(Window.partitionBy())
    return df.withColumn("importance_pct", F.round(100 * F.col(col) / total, decimals))


def sort_importance(df: DataFrame, col: str = "importance") -> DataFrame:
    return df.orderBy(F.desc(col), "feature")


def top_k_features(df: DataFrame, k: int = 2, col: str = "importance") -> DataFrame:
    return sort_importance(df, col).limit(k)


def dedupe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropDuplicates(list(cols))


def unique_names(df: DataFrame, col: str = "feature") -> DataFrame:
    return df.select(col).distinct()


def importance_table(df: DataFrame, col: str = "importance", name_col: str = "feature") -> DataFrame:
    """Display form: importance x 100 rounded to 2 places with a ``%`` suffix."""
    return df.select(F.col(name_col).alias("feature"),
                     F.format_string("%s%%", F.round(F.col(col) * 100, 2).cast("string")).alias("importance"))


def rank_features(df: DataFrame, target: str, features: Sequence[str] | None = None,
                  algorithm: str = "random_forest", **params) -> DataFrame:
    """Fit a model on all features, sum slot importances per feature and rank:
    ``(feature, importance, importance_pct)`` strongest first."""
    if features is None:
        num, cat = split_roles(df.drop(target))
        features = num + cat
    model = pipeline_fit(df, features, target, algorithm, **params)
    spark = df.sparkSession
    w = model_weights(model, spark).join(slot_names(model, spark), "slot")
    if algorithm in ("ridge", "lasso"):
        w = w.withColumn("weight", F.abs("weight"))
    imp = importance_by_feature(w)
    return sort_importance(importance_share(imp))


def select_lasso(df: DataFrame, target: str, features: Sequence[str] | None = None,
                 alpha: float = 1.0) -> DataFrame:
    """Features with at least one non-zero lasso coefficient: ``(feature)``."""
    if features is None:
        num, cat = split_roles(df.drop(target))
        features = num + cat
    model = pipeline_fit(df, features, target, "lasso", alpha=alpha)
    spark = df.sparkSession
    w = model_weights(model, spark).join(slot_names(model, spark), "slot")
    return unique_names(w.where(F.col("weight") != 0))


def select_rfe(df: DataFrame, target: str, n_features: int = 10, features: Sequence[str] | None = None,
               algorithm: str = "random_forest", **params) -> DataFrame:
    """Recursive elimination of whole features: refit, drop the least important
    feature, until ``n_features`` remain. The input is persisted once and every
    refit reads it. Result ``(feature, importance)`` of the survivors."""
    from pyspark import StorageLevel
    if features is None:
        num, cat = split_roles(df.drop(target))
        features = num + cat
    feats = list(features)
    data = spread(complete_rows(df.select(*feats, target), [*feats, target]).persist(StorageLevel.MEMORY_AND_DISK))
    spark = df.sparkSession
    try:
        while True:
            model = pipeline_fit(data, feats, target, algorithm, **params)
            w = model_weights(model, spark).join(slot_names(model, spark), "slot")
            if algorithm in ("ridge", "lasso"):
                w = w.withColumn("weight", F.abs("weight"))
            imp = importance_by_feature(w)
            if len(feats) <= n_features:
                return spark.createDataFrame(imp.collect(), "feature string, importance double")
            weakest = imp.orderBy("importance", F.desc("feature")).first()["feature"]
            feats.remove(weakest)
    finally:
        data.unpersist()


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], target: str,
                           key_cols: Sequence[str], repeats: int = 10, seed: int = 0,
                           digits: int | None = None) -> DataFrame:
    """Mean R^2 drop when one feature is shuffled, over ``repeats`` shuffles,
    divided by the sum of those means: ``(feature, importance_mean, importance)``.

    The rows are ranked once, by md5(key). Each (feature, repeat) has a keyed bijection of the ranks
    (:mod:`estima.functions.bijection`): a row sends its value to the rank that the bijection names, and
    only that value travels. Every rank gets one value per (feature, repeat), meets its row in one join, and
    the copies are made, scored by one ``transform`` and reduced by one grouped R^2 aggregate."""
    from pyspark import StorageLevel

    from estima.functions.bijection import keys, permuted_each
    from estima.functions.hashing import hash_hex
    from estima.operators.evaluate import metrics
    from estima.operators.split import hash_rank, prefix_digits
    spark = df.sparkSession
    base = complete_rows(df.select(*key_cols, *features, target), [*features, target])
    n = base.count()
    base = hash_rank(base.withColumn("__ha", hash_hex(key_cols)), "__ha", tie_cols=key_cols, rank_col="__ra",
                     digits=prefix_digits(n) if digits is None else digits).drop("__ha")
    # read three times below (receivers, donors, baseline): persist the ranked rows, dealt over all cores
    base = spread(base.persist(StorageLevel.MEMORY_AND_DISK))
    try:
        num, _ = split_roles(df, features)
        # one key for each (feature, repeat): a fixed, small replication factor applied by explode
        each = [keys(f"{f}|{seed}|{r}") for f in features for r in range(repeats)]
        sent = base.select(*features, permuted_each(F.col("__ra") - 1, n, each).alias("__at"))
        sent = sent.select(*features, F.posexplode("__at").alias("__p", "__to"))
        number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
        for i, f in enumerate(features):
            at = F.floor(F.col("__p") / repeats) == i
            number = F.when(at, F.col(f).cast("double")).otherwise(number) if f in num else number
            text = text if f in num else F.when(at, F.col(f).cast("string")).otherwise(text)
        sent = sent.select("__to", F.struct(F.col("__p").alias("p"), number.alias("number"), text.alias("text")).alias("__got"))
        # as many values as there are (feature, repeat) pairs
        sent = sent.groupBy("__to").agg(F.collect_list("__got").alias("__got"))
        met = base.select("__ra", *features, target).join(sent, F.col("__ra") - 1 == F.col("__to")).select(*features, target, F.explode("__got").alias("__g"))
        met = met.select(*features, target, "__g.*").withColumn("__f", F.floor(F.col("p") / repeats).cast("int")).withColumn("__r", F.col("p") % repeats)
        cols = [F.when(F.col("__f") == i, F.col("number") if f in num else F.col("text")).otherwise(
            F.col(f).cast("double" if f in num else "string")).alias(f) for i, f in enumerate(features)]
        copies = met.select("__f", "__r", *cols, target)
        drops = metrics(model.transform(copies), target, "prediction", ["__f", "__r"]).select("__f", "__r", "r2")
        baseline = metrics(model.transform(base), target).select("r2").scalar()
        mean_drop = (drops.withColumn("__drop", baseline - F.col("r2"))
                     .groupBy("__f").agg(F.avg("__drop").alias("importance_mean")))
        total = F.sum("importance_mean").over(Window.partitionBy())
        name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("__f") + 1)
        result = mean_drop.select(name.alias("feature"), "importance_mean", (F.col("importance_mean") / total).alias("importance"))
        rows = result.collect()  # one row per feature
    finally:
        base.unpersist()
    return spark.createDataFrame(rows, "feature string, importance_mean double, importance double")
