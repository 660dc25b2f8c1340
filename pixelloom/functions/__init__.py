"""Scalar column functions: lookups, text and number parsing, pixel arithmetic, display values."""
