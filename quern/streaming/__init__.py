"""Continuous ingestion of documents."""
