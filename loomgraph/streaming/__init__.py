"""Incremental ingestion with Structured Streaming, and retention."""
