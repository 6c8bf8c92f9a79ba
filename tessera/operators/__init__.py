"""Relational operators of name harmonization."""

from tessera.operators.catalog import annotators, entity_types, resolve_offline, vocabularies
from tessera.operators.chunks import correlate, number_chunks, request_bodies, requests
from tessera.operators.export import flatten
from tessera.operators.queue import as_requests, build_queue, join_back
from tessera.operators.results import from_batch_entry, from_envelope, from_ndjson
from tessera.operators.summary import summarize, tier_counts, vocabulary_coverage, with_tier

__all__ = [
    "annotators",
    "as_requests",
    "build_queue",
    "correlate",
    "entity_types",
    "flatten",
    "from_batch_entry",
    "from_envelope",
    "from_ndjson",
    "join_back",
    "number_chunks",
    "request_bodies",
    "requests",
    "resolve_offline",
    "summarize",
    "tier_counts",
    "vocabularies",
    "vocabulary_coverage",
    "with_tier",
]
