"""Structured Streaming faces of the batch operators."""
