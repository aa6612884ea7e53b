"""Scoring a stream with a fitted model (the model's stages are per-row)."""

from estima.streaming.scoring import score_stream, start_scoring  # noqa: F401
