"""The queue: one row for each distinct clean name of a feature table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import clean_name, extract_id
from tessera.schemas import HINT_VOCABULARY, LEVEL_PRIORITY


def _column(df: DataFrame, name: str) -> Column:
    """The column as a string, NaN numbers as null; nulls where the table has none of that name."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    value = F.col(name)
    if dict(df.dtypes)[name] in ("float", "double"):
        value = F.when(~F.isnan(value), value)
    return value.cast("string")


def prepare(df: DataFrame, *, name_col: str, hint_col: str, feature_id_col: str, match_level_col: str, ord_col: str, compat: bool = False) -> DataFrame:
    """The columns that the queue folds, rows without a name dropped. compat: a null feature id is the text "None"."""
    feature = _column(df, feature_id_col)
    if compat and feature_id_col in df.columns:
        feature = F.coalesce(feature, F.lit("None"))
    rows = df.select(
        F.col(ord_col).cast("long").alias("ord"),
        clean_name(_column(df, name_col)).alias("name"),
        extract_id(_column(df, hint_col)).alias("hint"),
        feature.alias("feature_id"),
        _column(df, match_level_col).alias("level"),
    )
    return rows.where(F.col("name").isNotNull())


def build_queue(
    df: DataFrame,
    *,
    name_col: str = "matched_name",
    hint_col: str = "ms1_compound_name",
    feature_id_col: str = "feature_id",
    match_level_col: str = "match_level",
    ord_col: str = "ord",
    limit: int | None = None,
    compat: bool = False,
) -> DataFrame:
    """name, hmdb_hint, feature_ids, match_level, ord in first-seen order of ``ord_col``.

    The first hint by order wins, feature ids are kept in order with repeats,
    and a match level gives way only to one of higher priority. One shuffle by
    name, after a map-side aggregation.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    rows = prepare(df, name_col=name_col, hint_col=hint_col, feature_id_col=feature_id_col, match_level_col=match_level_col, ord_col=ord_col, compat=compat)
    priority = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVEL_PRIORITY.items() for x in kv]), F.col("level")), F.lit(0))
    hint_ord = F.when(F.col("hint").isNotNull(), F.col("ord"))
    features = F.collect_list(F.when(F.col("feature_id") != "", F.struct("ord", "feature_id")))
    queue = rows.groupBy("name").agg(
        F.min_by("hint", hint_ord).alias("hmdb_hint"),
        F.transform(F.array_sort(features), lambda x: x["feature_id"]).alias("feature_ids"),
        F.max_by("level", F.struct(priority, -F.col("ord"))).alias("match_level"),
        F.min("ord").alias("ord"),
    )
    return queue if limit is None else queue.orderBy("ord").limit(limit)


def as_requests(queue: DataFrame) -> DataFrame:
    """ord, name and identifiers; identifiers are null without a hint."""
    hint = F.when(F.col("hmdb_hint") != "", F.create_map(F.lit(HINT_VOCABULARY), F.col("hmdb_hint")))
    return queue.select("ord", "name", hint.alias("identifiers"))


def join_back(results: DataFrame, queue: DataFrame) -> DataFrame:
    """The result of each feature: results by ``ord``, one row for each feature id."""
    ids = queue.select("ord", F.explode("feature_ids").alias("feature_id"), "match_level")
    return ids.join(results, "ord")
