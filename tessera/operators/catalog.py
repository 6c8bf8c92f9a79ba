"""Discovery catalogs and the offline resolver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.schemas import ANNOTATORS, ENTITY_TYPES, VOCABULARIES


def entity_types(payload: DataFrame, json_col: str = "payload") -> DataFrame:
    """pos, type and sorted aliases from {"entity_types", "aliases": {alias: type}}; aliases of other types are dropped."""
    parsed = payload.select(F.from_json(json_col, ENTITY_TYPES).alias("p"))
    types = parsed.select(F.posexplode("p.entity_types").alias("pos", "type"))
    pairs = parsed.select(F.explode("p.aliases").alias("alias", "type"))
    return invert_aliases(types, pairs)


def invert_aliases(types: DataFrame, pairs: DataFrame) -> DataFrame:
    """types (pos, type) with the sorted aliases of pairs (alias, type); empty where there are none."""
    grouped = pairs.groupBy("type").agg(F.sort_array(F.collect_list("alias")).alias("aliases"))
    return types.join(grouped, "type", "left").select("pos", "type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def annotators(payload: DataFrame, json_col: str = "payload") -> DataFrame:
    return payload.select(F.from_json(json_col, ANNOTATORS).alias("p")).select(F.inline("p.annotators"))


def vocabularies(payload: DataFrame, json_col: str = "payload") -> DataFrame:
    rows = payload.select(F.from_json(json_col, VOCABULARIES).alias("p")).select(F.inline("p.vocabularies"))
    return rows.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def resolve_offline(requests: DataFrame, recorded: DataFrame, *, on: list[str] | None = None) -> DataFrame:
    """Requests with recorded entries looked up by name (and more keys); ``raw`` is null where none is recorded.

    A plain left join: Spark broadcasts the catalog if its size allows, else
    shuffles both sides by key and splits skewed keys.
    """
    return requests.join(recorded, on or ["name"], "left")
