"""Operators on DataFrames of texts, labels and vectors."""
