"""Structured Streaming entry points (incremental staging of landing raw files)."""

from clickfold.streaming.staging_stream import read_landing, stage_stream

__all__ = ["read_landing", "stage_stream"]
