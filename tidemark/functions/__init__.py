"""Scalar functions as Column expressions, and the one that needs Python: global alignment."""
