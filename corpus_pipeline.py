"""The corpus pipeline: documents through five stages, each calling one operator of ``estima.llm``.

Every stage is a function of (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``docs``. Labels come from the table ``labels``; held-out ids are never learned from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from estima.llm.common import drop_folder, drop_written, folders_so_far, release, shared_folder, small_batches
from estima.llm.minhash import keep_one
from estima.llm.packing import pack_documents
from estima.llm.pii import redact
from estima.llm.quality import reject_poor
from estima.llm.quality import train as train_quality
from estima.llm.toxicity import reject_toxic
from estima.llm.toxicity import train as train_toxicity
from estima.session import ensure_checkpoint_dir


def _ready(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    small_batches(spark)
    release()  # what the stage before has left in the driver


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic."""
    _ready(spark)
    return reject_toxic(docs, train_toxicity(docs.select("doc_id", "text"), _labels(spark, sf_dir)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as poor."""
    _ready(spark)
    return reject_poor(docs, *train_quality(docs.select("doc_id", "text"), _labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    _ready(spark)
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    _ready(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 1024 ids."""
    _ready(spark)
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates),
          ("personal_data", personal_data), ("packing", packing)]

#: Trained models and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's input and what it has written on its way go when its output is written."""
    ensure_checkpoint_dir(spark)
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        before = folders_so_far()
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        here = shared_folder(spark, f"stage-{name}")
        out.write.parquet(here)
        drop_written(spark, before)
        if folder:
            drop_folder(spark, folder)
        docs, folder = spark.read.schema(out.schema).parquet(here), here
    raise ValueError("STAGES is empty")
