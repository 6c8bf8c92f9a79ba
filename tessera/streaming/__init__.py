"""Structured Streaming over NDJSON."""

from tessera.streaming.ndjson import run_stream, stream_results

__all__ = ["run_stream", "stream_results"]
