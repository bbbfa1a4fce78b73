"""Structured Streaming forms of the decision and monitoring operators."""
