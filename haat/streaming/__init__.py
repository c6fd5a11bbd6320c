"""Structured Streaming form of the periodic ingestion."""
