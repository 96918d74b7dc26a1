"""Column expressions: vectors, strings, numerics."""
