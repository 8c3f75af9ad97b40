"""Incremental file ingestion with Structured Streaming."""

from .ingest import ingest_new_files

__all__ = ["ingest_new_files"]
