"""Functions of the key-path engine."""
