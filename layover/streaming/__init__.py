"""Structured Streaming forms of the trigger and of ingestion."""
