"""Structured Streaming scorer.

Every fitted stage of a model pipeline is a per-row projection, so a model
scores a streaming DataFrame exactly as it scores a batch one; no state, no
watermark. The sink's progress lives in a folder that follows from the output path, so a
restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from estima.operators.score import predict


def score_stream(model: PipelineModel, stream: DataFrame) -> DataFrame:
    """Streaming rows plus ``prediction``."""
    if not stream.isStreaming:
        raise ValueError("score_stream expects a streaming DataFrame")
    return predict(model, stream)


def start_scoring(model: PipelineModel, stream: DataFrame, out_path: str, fmt: str = "parquet",
                  checkpoint: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Start writing scored rows to ``out_path`` (append). Progress is kept beside the rows
    (readers skip names that start with ``_``) unless ``checkpoint`` names a folder, so the
    same call after a stop goes on with the rows that came since."""
    checkpoint = checkpoint or f"{out_path.rstrip('/')}/_progress"
    w = (score_stream(model, stream).writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", out_path))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
