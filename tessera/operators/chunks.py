"""Requests in chunks, and responses matched with them by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.results import _project
from tessera.schemas import BATCH, CORRUPT, DEFAULT_ANNOTATION_MODE, DEFAULT_ENTITY_TYPE, HINT_VOCABULARY, MAX_CHUNK


def requests(records: DataFrame, *, entity_type: str = DEFAULT_ENTITY_TYPE, annotation_mode: str = DEFAULT_ANNOTATION_MODE, annotators: list[str] | None = None, compat: bool = False) -> DataFrame:
    """ord and the request of each record (ord, name, identifiers). compat: a null name is the text "None"."""
    name = F.coalesce(F.col("name").cast("string"), F.lit("None" if compat else ""))
    options = [F.lit(annotation_mode).alias("annotation_mode")]
    if annotators is not None:
        options.append(F.array(*[F.lit(a) for a in annotators]).cast("array<string>").alias("annotators"))
    identifiers = F.col("identifiers").cast("map<string,string>") if "identifiers" in records.columns else F.lit(None).cast("map<string,string>")
    body = F.struct(name.alias("name"), F.lit(entity_type).alias("entity_type"), F.coalesce(identifiers, F.create_map().cast("map<string,string>")).alias("identifiers"), F.struct(*options).alias("options"))
    return records.select(F.col("ord").cast("long").alias("ord"), body.alias("request"))


def number_chunks(df: DataFrame, *, ord_col: str = "ord", size: int = MAX_CHUNK) -> DataFrame:
    """chunk_id and pos from gapless ordinals: no shuffle, and never more chunks than needed."""
    return df.withColumns({"chunk_id": F.floor(F.col(ord_col) / size).cast("long"), "pos": F.pmod(F.col(ord_col), F.lit(size)).cast("int")})


def request_bodies(chunked: DataFrame) -> DataFrame:
    """chunk_id, n and the JSON body of each chunk; a chunk is at most ``MAX_CHUNK`` requests."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "request")), lambda a, b: a["pos"] - b["pos"]), lambda x: x["request"])
    return chunked.groupBy("chunk_id").agg(F.count("*").alias("n"), F.to_json(F.struct(ordered.alias("entities")), {"ignoreNullFields": "false"}).alias("body"))


def correlate(chunked: DataFrame, responses: DataFrame) -> DataFrame:
    """One result for each request: response entries by (chunk_id, pos).

    ``responses`` has chunk_id, response (JSON) and error. A transport error, a
    malformed envelope, an entry that isn't one, or another number of entries
    than requests makes error rows of exactly the chunk's requests. order_mismatch
    marks entries that name another entity than was sent.
    """
    sizes = chunked.groupBy("chunk_id").agg(F.count("*").alias("n"))
    parsed = responses.withColumn("__env", F.from_json("response", BATCH, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})).join(sizes, "chunk_id")
    got = F.coalesce(F.size("__env.results"), F.lit(-1))
    bad = F.col("__env").isNull() | F.col(f"__env.{CORRUPT}").isNotNull() | F.col("__env.results").isNull()
    hole = F.coalesce(F.exists("__env.results", lambda x: x.isNull()), F.lit(False))
    failure = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(bad | hole, "Malformed batch response")
        .when(got != F.col("n"), F.concat(F.lit("Expected "), F.col("n"), F.lit(" results, got "), got))
    )
    checked = parsed.select("chunk_id", failure.alias("__failure"), F.col("__env.results").alias("__results"))
    # entry by entry, so that no row carries its whole chunk
    entries = checked.where("__failure IS NULL").select("chunk_id", F.posexplode("__results").alias("pos", "__entry"))
    failed = checked.where("__failure IS NOT NULL").select("chunk_id", "__failure")
    joined = chunked.join(entries, ["chunk_id", "pos"], "left").join(failed, "chunk_id", "left")
    name, hint = F.col("request.name"), F.try_element_at(F.col("request.identifiers"), F.lit(HINT_VOCABULARY))
    failure = F.when(F.col("__entry").isNull(), F.coalesce("__failure", F.lit("No response")))
    joined = joined.withColumn("order_mismatch", F.coalesce((F.col("__entry.name") != "") & (F.col("__entry.name") != name), F.lit(False)))
    out = _project(joined, F.col("__entry"), query_name=name, hint=hint, also_error=failure)
    return out.drop("chunk_id", "pos", "request", "__entry", "__failure")
