"""Streaming forms of catalogue operators."""
