"""Standard frames over the test tables used by the registered queries.

``lineitem_frame``: lineitem with the derived price target
``charge = l_extendedprice * (1 - l_discount) * (1 + l_tax)`` and the hashed
80/20 split on the unique key (l_orderkey, l_partkey, l_suppkey, l_linenumber).
``doc_labels``: documents left-joined to their labels; unlabelled documents
carry real missing values (null quality, ``#N/A`` toxicity).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estima.operators.models import pipeline_fit
from estima.operators.split import split_train_test
from estima.sources.tables import scan_table

LI_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LI_COLS = LI_KEY + ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

_MODELS: dict = {}


def lineitem_frame(spark: SparkSession, base: str) -> DataFrame:
    li = scan_table(spark, base, "lineitem", LI_COLS)
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return split_train_test(li.withColumn("charge", charge), LI_KEY)


def orders_frame(spark: SparkSession, base: str) -> DataFrame:
    o = scan_table(spark, base, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    return split_train_test(o, ["o_orderkey"])


def doc_labels(spark: SparkSession, base: str) -> DataFrame:
    d = scan_table(spark, base, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    lab = scan_table(spark, base, "labels", ["doc_id", "quality", "toxic"])
    j = d.join(lab, "doc_id", "left")
    return j.select("doc_id", "text", "lang", "source", "n_chars", F.col("quality").cast("string").alias("quality"),
                    F.coalesce(F.col("toxic").cast("string"), F.lit("#N/A")).alias("toxic"))


def fitted(name: str, spark: SparkSession, base: str, build) -> PipelineModel:
    """Fit once per (session, data, name); fits are deterministic."""
    key = (spark.sparkContext.applicationId, base, name)
    if key not in _MODELS:
        _MODELS[key] = build()
    return _MODELS[key]


def ridge_lineitem(spark: SparkSession, base: str) -> PipelineModel:
    """Ridge (alpha 1) of charge on standardised l_extendedprice, training rows."""
    def build():
        tr = lineitem_frame(spark, base).where(~F.col("is_test"))
        return pipeline_fit(tr, ["l_extendedprice"], "charge", "ridge")
    return fitted("ridge_lineitem", spark, base, build)


def ridge_orders(spark: SparkSession, base: str) -> PipelineModel:
    """Ridge (alpha 1) of o_totalprice on one-hot o_orderpriority, training rows."""
    def build():
        tr = orders_frame(spark, base).where(~F.col("is_test"))
        return pipeline_fit(tr, ["o_orderpriority"], "o_totalprice", "ridge")
    return fitted("ridge_orders", spark, base, build)


def lineitem_predictions(spark: SparkSession, base: str) -> DataFrame:
    """Every lineitem row with its prediction: what a scoring run or a report covers."""
    from estima.operators.score import predict
    rows = lineitem_frame(spark, base).select(*LI_KEY, "l_extendedprice", "charge", "l_returnflag", "l_linestatus", "is_test")
    return predict(ridge_lineitem(spark, base), rows)


def lineitem_test_predictions(spark: SparkSession, base: str) -> DataFrame:
    """The test rows only: what an evaluation covers."""
    return lineitem_predictions(spark, base).where(F.col("is_test")).drop("is_test")
