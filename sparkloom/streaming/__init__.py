"""Structured Streaming: incremental transcript ingestion."""
