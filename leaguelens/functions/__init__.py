"""Column functions: text, casts, statistics and hashes."""
