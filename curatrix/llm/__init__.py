"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage. Each module holds one operator and, at
its end, the query ``opN_<name>`` built on it; ``registry`` gathers queries and oracle SQL.
"""
