"""Structured Streaming forms of two batch rules."""
