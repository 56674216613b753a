"""Structured Streaming forms of the enrichment run."""
