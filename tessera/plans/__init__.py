"""Whole runs: from records, features or files to results."""

from tessera.control import StopHandle
from tessera.plans.mapping import DatasetRun, list_catalog, map_dataset_file, map_entities, map_entity, map_features, send_chunks, warn_of_mismatches

__all__ = ["DatasetRun", "StopHandle", "list_catalog", "map_dataset_file", "map_entities", "map_entity", "map_features", "send_chunks", "warn_of_mismatches"]
