"""Column builders: pure expressions, no data access."""
