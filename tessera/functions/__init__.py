"""Scalar functions as column expressions, and their registration for SQL."""

from tessera.functions.names import clean_name, extract_id, strip
from tessera.functions.results import best_score, confidence_tier, first_nonempty, flat_assignments, grouped_codes, ids_for, join_ids
from tessera.functions.sql import register_functions

__all__ = [
    "best_score",
    "clean_name",
    "confidence_tier",
    "extract_id",
    "first_nonempty",
    "flat_assignments",
    "grouped_codes",
    "ids_for",
    "join_ids",
    "register_functions",
    "strip",
]
