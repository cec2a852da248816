"""Scalar functions as Column expressions, and the few text algorithms that need Python."""
