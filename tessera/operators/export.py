"""Flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import confidence_tier, first_nonempty, ids_for, join_ids

FLAT_COLUMNS = ["query_name", "hmdb_hint", "resolved", "primary_curie", "chosen_kg_id", "confidence_score", "confidence_tier", "hmdb_ids", "pubchem_ids", "chebi_ids", "refmet_ids", "error"]


def flatten(results: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """FLAT_COLUMNS of each result, after the columns to keep; nulls become empty texts, the score stays a number."""

    def text(name: str):
        return F.coalesce(name, F.lit("")).alias(name)

    pubchem = first_nonempty(ids_for("identifiers", "PUBCHEM.COMPOUND"), ids_for("identifiers", "PUBCHEM"))
    return results.select(
        *(keep or []),
        "query_name",
        text("hmdb_hint"),
        "resolved",
        text("primary_curie"),
        text("chosen_kg_id"),
        "confidence_score",
        confidence_tier("confidence_score").alias("confidence_tier"),
        join_ids(ids_for("identifiers", "HMDB")).alias("hmdb_ids"),
        join_ids(pubchem).alias("pubchem_ids"),
        join_ids(ids_for("identifiers", "CHEBI")).alias("chebi_ids"),
        join_ids(ids_for("identifiers", "refmet_id")).alias("refmet_ids"),
        text("error"),
    )
