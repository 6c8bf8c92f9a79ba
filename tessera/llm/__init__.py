"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; ``queries`` holds the
queries that ``__spark_entry__`` registers when the subpackage is present.
"""
