"""Incremental ingestion of statement files (Structured Streaming file source)."""

from adega.streaming.statements import ingest_statement_files, stream_statements  # noqa: F401
