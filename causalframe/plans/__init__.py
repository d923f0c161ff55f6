"""Plans of the key-path engine."""
