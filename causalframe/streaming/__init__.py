"""Streaming of the key-path engine."""
