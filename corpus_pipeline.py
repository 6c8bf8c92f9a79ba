"""From raw documents to packed sequences, one operator a stage.

Each stage takes the documents that the one before kept, whole, and its
decisions take effect: rows that language identification or the quality rules
reject are gone, of near duplicates one document stays, and the last stage packs
what is left. ORACLE_SQL is None: trained models, MinHash and packing aren't
SQL; tests/llm hold the stages against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import language_id, near_dedup, packing, quality_rules
from tessera.llm.common import materialize, tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language (operator 6)."""
    return language_id.filter_documents(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, from hosts that do (operator 10)."""
    return quality_rules.filter_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near duplicates (operator 1)."""
    return near_dedup.filter_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences (operator 4)."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_dedup", dedup_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
