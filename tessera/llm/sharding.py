"""Reproducible shuffle into shards by a Feistel permutation, in DataFrame expressions only.

Rows get global row numbers in ascending key order, a keyed Feistel network
over a * b >= n row numbers permutes them, and numbers that leave [0, n) walk
the cycle until they are back. The permuted number alone gives shard
(remainder) and slot (quotient): counts differ by one at most, slots have no
gaps, and any row's place can be computed without moving data.

Defined results: a null text has no bytes (size 1, checksum 0); null keys come
first; rows with equal keys are ordered by size and checksum, so equal rows are
interchangeable; an empty table gives an empty result; further columns of the
input aren't read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

ROUNDS = 6
#: Steps of the cycle walk; the domain exceeds n by less than 2 * sqrt(n) + 2, so a longer walk is practically impossible, and it raises an error.
WALK = 64
PRIME = (1 << 31) - 1


def domain(n: int) -> tuple[int, int]:
    """a, b with a * b >= n, as near to n as a near-square allows."""
    a = max(1, math.isqrt(max(n, 1)))
    return a, -(-max(n, 1) // a)


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Multipliers and offsets below PRIME, from a linear congruential stream."""
    keys, x = [], (seed * 2 + 1) % PRIME
    for _ in range(ROUNDS):
        row = []
        for _ in range(3):
            x = (x * 48271 + 11) % PRIME
            row.append(x)
        keys.append(tuple(row))
    return keys


def permute(y: int, n: int, seed: int) -> int:
    """The same permutation for one row number, in Python."""
    a, b = domain(n)
    while True:
        left, right = divmod(y, b)
        for k, (m1, m2, c) in enumerate(round_keys(seed)):
            x = right if k % 2 == 0 else left
            f = ((x * m1 + c) % PRIME) * ((x * m2 + m1) % PRIME) % PRIME
            if k % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        y = left * b + right
        if y < n:
            return y


def permute_sql(number: str, n: int, seed: int) -> str:
    """Spark SQL for ``permute``; the lambdas bind each state once."""
    a, b = domain(n)
    keys = ", ".join(f"named_struct('k', {k}, 'm', {m1}L, 'q', {m2}L, 'c', {c}L)" for k, (m1, m2, c) in enumerate(round_keys(seed)))

    def mixed(x: str) -> str:
        return f"((({x} * k.m + k.c) % {PRIME}L) * (({x} * k.q + k.m) % {PRIME}L) % {PRIME}L)"

    def once(y: str) -> str:
        return (
            f"aggregate(array({keys}), named_struct('l', {y} div {b}L, 'r', {y} % {b}L), (s, k) -> "
            f"CASE WHEN k.k % 2 = 0 THEN named_struct('l', (s.l + {mixed('s.r')}) % {a}L, 'r', s.r) "
            f"ELSE named_struct('l', s.l, 'r', (s.r + {mixed('s.l')}) % {b}L) END, s -> s.l * {b}L + s.r)"
        )

    return f"aggregate(sequence(1, {WALK}), {once(number)}, (y, i) -> CASE WHEN y < {n}L THEN y ELSE {once('y')} END)"


def number_rows(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Adds ``row_no`` (from 0, in the given order) and returns the row count.

    Rows are dealt by range and sorted, so a row's place is its partition's
    offset plus its place in the partition; the offsets are one number for
    each partition, which the number of partitions bounds.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "numbered").withColumn("__part", F.shiftright("__at", 33).cast("int"))
    sizes = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())
    offsets, total = [], 0
    for part, count in sizes:
        offsets.append((part, total))
        total += count
    table = df.sparkSession.createDataFrame(offsets, "__part int, __first long")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.join(F.broadcast(table), "__part").withColumn("row_no", F.col("__first") + inside)
    return numbered.drop("__at", "__part", "__first"), total


def assign_shards(df: DataFrame, *, key: str = "doc_id", text_col: str = "text", shards: int = 8, seed: int = 20240817) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard (null: this law moves rows when it grows)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = materialize(df.select(F.col(key), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "sizes")
    rows, n = number_rows(small, key, "size", "text_crc32")
    out = rows.withColumn("__to", F.expr(permute_sql("row_no", max(n, 1), seed)))
    out = out.withColumn("__to", F.when(F.col("__to") < n, F.col("__to")).otherwise(F.raise_error(F.lit("the cycle walk did not end"))))
    return out.select(
        key,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("__to") % shards).cast("int").alias("shard"),
        F.expr(f"__to div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs)
