"""Scans: records in memory, feature tables, dataset files and NDJSON."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import PurePosixPath
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import REQUEST

CONTENT_TYPES = {".tsv": "text/tab-separated-values", ".csv": "text/csv"}


def content_type(path: str) -> str:
    return CONTENT_TYPES.get(PurePosixPath(str(path)).suffix.lower(), "application/octet-stream")


def from_records(spark: SparkSession, records: Iterable[dict[str, Any]]) -> DataFrame:
    """ord, name and identifiers of records {"name", "identifiers"?}; generators are fine.

    A missing name is empty, a null name stays null, and an identifier that is
    no text fails here, before anything is sent.
    """
    rows = []
    for i, r in enumerate(records):
        name, identifiers = r.get("name", ""), r.get("identifiers") or {}
        if any(not isinstance(x, str) for kv in identifiers.items() for x in kv):
            raise ValueError(f"record {i}: identifiers must be texts")
        rows.append((i, None if name is None else str(name), identifiers))
    return spark.createDataFrame(rows, REQUEST)


def number_rows(df: DataFrame, ord_col: str) -> DataFrame:
    """Gapless ordinals in the order that the rows have now: rows are written once, each partition's offset is the sum of the counts before it, one number a partition."""
    from tessera.plans.scratch import write_once

    placed = write_once(df.withColumn("__at", F.monotonically_increasing_id()), "ordered").withColumn("__part", F.shiftright("__at", 33).cast("int"))
    offsets, total = [], 0
    for part, n in sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect()):
        offsets.append((part, total))
        total += n
    first = df.sparkSession.createDataFrame(offsets, "__part int, __first long")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(first), "__part").withColumn(ord_col, F.col("__first") + inside).drop("__at", "__part", "__first")


def with_ord(df: DataFrame, *order: str, ord_col: str = "ord") -> DataFrame:
    """Gapless ordinals in the order given, without gathering rows in one task."""
    return number_rows(df.repartitionByRange(*order).sortWithinPartitions(*order), ord_col)


def feature_table(spark: SparkSession, table: Any) -> DataFrame:
    """A pandas feature table as a frame with ``ord``; missing values of any kind become null."""
    import pandas as pd

    rows = table.astype(object).where(pd.notna(table), None)
    columns = [str(c) for c in rows.columns]
    data = [(i, *(None if v is None else str(v) for v in r)) for i, r in enumerate(rows.itertuples(index=False, name=None))]
    return spark.createDataFrame(data, ", ".join(["ord long", *(f"`{c}` string" for c in columns)]))


def read_dataset(spark: SparkSession, path: str, *, sep: str | None = None) -> DataFrame:
    """A TSV or CSV file with a header, all columns as text; the suffix tells which unless ``sep`` does."""
    if sep is None:
        sep = "," if content_type(path) == "text/csv" else "\t"
    return spark.read.options(header=True, sep=sep, quote='"', escape='"', mode="PERMISSIVE").csv(path)


def reject_commas(name: str, values: list[str]) -> None:
    for value in values:
        if "," in value:
            raise ValueError(f"{name}: no commas are allowed in {value!r}")


def in_file_order(df: DataFrame, *, ord_col: str = "ord") -> DataFrame:
    """A frame that was read from files, with gapless ordinals by file, place of the split and row, whatever order Spark reads splits in."""
    place = {"__file": "_metadata.file_path", "__split": "_metadata.file_block_start", "__row": None}
    chosen = df.select("*", *[(F.col(c) if c else F.monotonically_increasing_id()).alias(k) for k, c in place.items()])
    return with_ord(chosen, *place, ord_col=ord_col).drop(*place)


def dataset_records(df: DataFrame, *, name_column: str, provided_id_columns: list[str], ord_col: str | None = None) -> DataFrame:
    """ord (gapless from 0), name and identifiers of a dataset's rows; empty identifiers are left out.

    In order of the ordinal column, or, without one, of the files that the frame
    was read from; a frame from elsewhere keeps the order its partitions have.
    """
    reject_commas("provided_id_columns", provided_id_columns)
    pairs = [x for c in provided_id_columns for x in (F.lit(c), F.col(c).cast("string"))]
    identifiers = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    filled = F.map_filter(identifiers, lambda k, v: F.coalesce(v != "", F.lit(False)))
    fields = [F.col(name_column).cast("string").alias("name"), filled.alias("identifiers")]
    if ord_col:
        return with_ord(df.select(F.col(ord_col).alias("__by"), *fields), "__by").select("ord", "name", "identifiers")
    try:
        return in_file_order(df.select("*", *[f.alias(f"__{k}") for k, f in zip(("name", "identifiers"), fields)])).select("ord", F.col("__name").alias("name"), F.col("__identifiers").alias("identifiers"))
    except AnalysisException:  # not a scan of files
        return number_rows(df.select(*fields), "ord").select("ord", "name", "identifiers")


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """The lines of NDJSON files, for ``from_ndjson``."""
    return spark.read.text(path)
