"""Operators of the key-path engine."""
