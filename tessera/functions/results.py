"""Expressions on the nested parts of mapping results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schemas import HIGH, MEDIUM


def flat_assignments(assigned: Column) -> Column:
    """annotator -> vocabulary -> code -> metadata as an array of (vocab, code, meta), in order."""

    def of_vocabulary(v: Column) -> Column:
        return F.transform(F.map_entries(v["value"]), lambda c: F.struct(v["key"].alias("vocab"), c["key"].alias("code"), c["value"].alias("meta")))

    def of_annotator(vocabularies: Column) -> Column:
        return F.flatten(F.transform(F.map_entries(vocabularies), of_vocabulary))

    return F.flatten(F.transform(F.map_values(assigned), of_annotator))


def grouped_codes(flat: Column) -> Column:
    """vocabulary -> its codes over all annotators, none dropped; a vocabulary without codes is absent."""
    names = F.array_distinct(F.transform(flat, lambda x: x["vocab"]))
    codes = F.transform(names, lambda v: F.transform(F.filter(flat, lambda x: x["vocab"] == v), lambda x: x["code"]))
    return F.map_from_arrays(names, codes)


def score_of(meta: Column) -> Column:
    """The score in a piece of metadata as a number; true and false count 1 and 0; null if there is none."""
    text = F.get_json_object(meta, "$.score")
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))


def best_score(flat: Column) -> Column:
    """The largest score; a NaN stays if it comes first and is passed over later."""

    def better(best: Column, x: Column) -> Column:
        above = (x > best) & ~F.isnan(x) & ~F.isnan(best)
        return F.when(x.isNull(), best).when(best.isNull() | above, x).otherwise(best)

    return F.aggregate(F.transform(flat, lambda x: score_of(x["meta"])), F.lit(None).cast("double"), better)


def confidence_tier(score: Column | str) -> Column:
    """high, medium, low, or unknown where there is no score; NaN is low."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c.isNull(), "unknown").when(F.isnan(c), "low").when(c >= HIGH, "high").when(c >= MEDIUM, "medium").otherwise("low")


def ids_for(identifiers: Column | str, vocabulary: str) -> Column:
    """The codes of one vocabulary; empty if there are none."""
    c = F.col(identifiers) if isinstance(identifiers, str) else identifiers
    return F.coalesce(F.try_element_at(c, F.lit(vocabulary)), F.array().cast("array<string>"))


def first_nonempty(first: Column, second: Column) -> Column:
    return F.when(F.size(first) > 0, first).otherwise(second)


def join_ids(ids: Column) -> Column:
    return F.array_join(ids, ";")
