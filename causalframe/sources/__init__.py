"""Sources of the key-path engine."""
