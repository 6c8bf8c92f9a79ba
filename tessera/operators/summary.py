"""Counts over results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import confidence_tier


def with_tier(results: DataFrame) -> DataFrame:
    return results.withColumn("confidence_tier", confidence_tier("confidence_score"))


def summarize(results: DataFrame) -> DataFrame:
    """One row: total_queried, resolved, unresolved, errors, resolution_rate (0 for no rows)."""
    total, resolved = F.count("*"), F.count_if("resolved")
    errors = F.count_if((F.col("error") != "") & ~F.col("resolved"))
    return results.agg(total.alias("total_queried"), resolved.alias("resolved"), errors.alias("errors")).select(
        "total_queried",
        "resolved",
        (F.col("total_queried") - F.col("resolved")).alias("unresolved"),
        "errors",
        F.coalesce(F.try_divide("resolved", "total_queried"), F.lit(0.0)).alias("resolution_rate"),
    )


def vocabulary_coverage(results: DataFrame) -> DataFrame:
    """vocab and n: results with at least one identifier of it, resolved or not."""
    return results.select(F.explode(F.map_keys("identifiers")).alias("vocab")).groupBy("vocab").agg(F.count("*").alias("n"))


def tier_counts(results: DataFrame) -> DataFrame:
    """confidence_tier, n and percent of all rows; the total is one row."""
    counts = with_tier(results).groupBy("confidence_tier").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("confidence_tier", "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"))
