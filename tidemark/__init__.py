"""Versioned vector collections on Spark: an append-only log, and all its views as DataFrames."""
