"""Continuous re-ingestion of feed files."""
