"""Structured Streaming forms of the log and window operators."""
