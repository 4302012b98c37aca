"""Fixed values and column expressions."""
