"""Structured Streaming: resumable ingestion, and windows over event streams."""
