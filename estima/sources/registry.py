"""Model registry: a fitted pipeline plus a one-row metadata record.

Layout of a saved model ``<dir>``, one version a save::

    <dir>/versions/<time>-<id>/model/      PipelineModel (Spark ML's own format)
    <dir>/versions/<time>-<id>/metadata/   one JSON row: model_name, features, target_feature, r2,
                                           training_date, spark_version, engine_version
    <dir>/versions/<time>-<id>/_complete   written last: model and metadata belong together

Readers take the newest complete version, so a save that dies half-way leaves the former one in
place. Old versions stay until :func:`prune_versions`.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENGINE_VERSION = "0.1.0"


@dataclass
class ModelBundle:
    model: PipelineModel
    metadata: dict
    path: str | None = None


def model_metadata(spark: SparkSession, algorithm: str, features: list[str],
                   target: str, r2: float | None) -> DataFrame:
    """The metadata record as a one-row DataFrame (``r2`` kept as text)."""
    row = spark.range(1).select(
        F.lit(algorithm).alias("model_name"),
        F.array(*[F.lit(f) for f in features]).cast("array<string>").alias("features"),
        F.lit(target).alias("target_feature"),
        F.lit(None if r2 is None else repr(float(r2))).cast("string").alias("r2"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("training_date"),
        F.lit(spark.version).alias("spark_version"),
        F.lit(ENGINE_VERSION).alias("engine_version"),
    )
    return row


def default_model_dir(base: str, algorithm: str, target: str) -> str:
    """``{base}/{algorithm}_{target}_{yyyymmddHHMMSSffffff}``: unique, sortable."""
    stamp = datetime.datetime.now().strftime("%Y%m%d%H%M%S%f")
    return f"{base.rstrip('/')}/{algorithm}_{target}_{stamp}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def complete_versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the complete versions of a saved model, oldest first."""
    fs, p = _file_system(spark, f"{path.rstrip('/')}/versions/*/_complete")
    found = fs.globStatus(p)
    return sorted(f.getPath().getParent().toString() for f in found) if found is not None else []


def model_save(model: PipelineModel, metadata: DataFrame, path: str) -> str:
    """Write model and metadata as a new version under ``path``."""
    stamp = datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%d%H%M%S%f")
    version = f"{path.rstrip('/')}/versions/{stamp}-{uuid.uuid4().hex[:8]}"
    model.write().save(f"{version}/model")
    metadata.coalesce(1).write.json(f"{version}/metadata")
    fs, mark = _file_system(metadata.sparkSession, f"{version}/_complete")
    fs.create(mark).close()
    return path


def prune_versions(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove all complete versions but the newest ``keep``."""
    old = complete_versions(spark, path)
    for version in old[:max(0, len(old) - max(1, keep))]:
        fs, p = _file_system(spark, version)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{version}/_complete"), False)  # no reader takes it from here on
        fs.delete(p, True)


def model_load(spark: SparkSession, path: str) -> ModelBundle:
    """Load the newest complete version; a missing or broken model raises ``FileNotFoundError``."""
    try:
        version = complete_versions(spark, path)[-1]
        model = PipelineModel.load(f"{version}/model")
        meta_rows = spark.read.json(f"{version}/metadata").collect()
    except IndexError:
        raise FileNotFoundError(f"no complete model at {path}") from None
    except Exception as exc:  # AnalysisException, Py4JJavaError
        raise FileNotFoundError(f"no usable model at {path}: {exc}") from exc
    if not meta_rows:
        raise FileNotFoundError(f"model at {path} has no metadata")
    return ModelBundle(model=model, metadata=meta_rows[0].asDict(), path=path)


def _place(spark: SparkSession, path: str) -> str:
    fs, p = _file_system(spark, path)
    at = fs.makeQualified(p).toUri().normalize()
    return f"{at.getScheme()}://{at.getAuthority() or ''}{at.getPath()}".rstrip("/") + "/"


def score_sink(df: DataFrame, path: str, fmt: str = "parquet", source_path: str | None = None) -> str:
    """Write scored rows to ``path``. Never the input itself, however it is written, nor a folder
    that holds it or lies in it: writing a Spark source in place would truncate it before it is read."""
    if source_path is not None:
        source, sink = _place(df.sparkSession, source_path), _place(df.sparkSession, path)
        if source.startswith(sink) or sink.startswith(source):
            raise ValueError(f"score_sink: the output {path} and the input {source_path} are one place")
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
    return path
