"""Readers and writers: feed caches, filing documents, question files and the stored tables."""
