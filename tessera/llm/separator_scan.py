"""Token counts of flat token files by a scan for end-of-document ids.

Flat files hold nothing but little-endian ids; documents may run across blocks
and across the files of a stream. Each block is searched for the end id with one
vector comparison and yields the places found. A prefix scan over the blocks of
a stream (sum of the ids, sum and running maximum of the places) stitches what
blocks cut apart: a document's count is the distance between two neighbouring
end ids, wherever they lie.

Defined results: the end id counts as a token of its document; ids after the
last end id of a stream are a document without end, reported with
``ended = false``; a document with no ids but the end has count 1; empty files
and folders give no rows; null and empty texts are written as the end id alone.
A text that yields the end id, an id wider than the files' ids, and a stream
whose documents and segments differ in number are errors, not other counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import library_codec
from tessera.llm.common import materialize, slices, tokenizer_path
from tessera.llm.files import new_folder, put, read_folder
from tessera.llm.token_files import WORDS

#: Ids of one block of the scan, and of one flat file.
BLOCK_IDS = 1 << 20
FILE_IDS = 1 << 22
#: The first id after the vocabulary: its own 50256 is also what a spelled-out <|endoftext|> becomes.
END_ID = 50257


def write_flat(df: DataFrame, path: str, folder: str, *, key: str = "doc_id", text_col: str = "text", end_id: int, width: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode each partition into a stream of flat files, cut at ``file_ids`` ids wherever that falls.

    Returns, written once, which key is the n-th document of which stream; the
    texts aren't shuffled. width: bytes of an id. end_id: one that no text yields.
    """
    if end_id >> 8 * width:
        raise ValueError(f"the end id {end_id} has more than {width} bytes")

    def write(batches):
        own, stream = library_codec(path, WORDS), TaskContext.get().partitionId()
        dtype, held, n, seq, ordinal = f"<u{width}", [], 0, 0, 0
        for batch in batches:
            for part in slices(batch):
                keys = part.column(0).to_pylist()
                for ids in own.encode_many(part.column(1).to_pylist()):
                    if len(ids) and ((ids == end_id).any() or int(ids.max()) >> 8 * width):
                        raise ValueError(f"a text yields the end id {end_id} or an id of more than {width} bytes")
                    ids = np.append(ids, np.uint32(end_id))
                    held.append(ids.astype(dtype))
                    n += len(ids)
                    if n >= file_ids:
                        flat, at = np.concatenate(held), 0
                        while n - at >= file_ids:
                            put(f"{folder}/{stream:06d}-{seq:06d}.bin", flat[at : at + file_ids].tobytes())
                            at, seq = at + file_ids, seq + 1
                        held, n = [flat[at:]], n - at
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([stream] * len(keys), pa.int32()), pa.array(range(ordinal, ordinal + len(keys)), pa.int64())], names=["key", "stream", "ordinal"])
                ordinal += len(keys)
        if n:
            put(f"{folder}/{stream:06d}-{seq:06d}.bin", np.concatenate(held).tobytes())

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(write, "key long, stream int, ordinal long"), "streams")


def scan_blocks(spark: SparkSession, folder: str, *, end_id: int, width: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row for each block: stream, file, block, its ids and the places of end ids in it."""

    def scan(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(data.as_buffer(), f"<u{width}")
                stream, seq = (int(x) for x in name.rpartition("/")[2].removesuffix(".bin").split("-"))
                for block, at in enumerate(range(0, len(ids), block_ids)):
                    part = ids[at : at + block_ids]
                    places = np.flatnonzero(part == end_id).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([stream], pa.int32()), pa.array([seq], pa.int32()), pa.array([block], pa.int32()), pa.array([len(part)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), pa.array(places))],
                        names=["stream", "file", "block", "n", "places"],
                    )

    return read_folder(spark, folder).mapInArrow(scan, "stream int, file int, block int, n long, places array<int>")


def count_tokens(blocks: DataFrame) -> DataFrame:
    """stream, ordinal, start, n_tokens and ended of each document, stitched by a prefix scan over the blocks."""
    before = Window.partitionBy("stream").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    found = blocks.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = found.withColumn("last", F.col("first") + F.element_at(F.when(F.size("places") > 0, F.col("places")), -1))
    found = found.withColumn("ordinal", F.coalesce(F.sum(F.size("places").cast("long")).over(before), F.lit(0)))
    found = found.withColumn("open", F.coalesce(F.max("last").over(before) + 1, F.lit(0)))
    ends = found.select(
        "stream",
        F.col("ordinal").alias("base"),
        "open",
        "first",
        "places",
        F.posexplode(F.transform("places", lambda p: p + F.col("first"))).alias("k", "end"),
    )
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("first") + F.get("places", F.col("k") - 1) + 1)
    docs = ends.select("stream", (F.col("base") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") + 1 - start).alias("n_tokens"), F.lit(True).alias("ended"))
    tails = found.groupBy("stream").agg(
        F.sum(F.size("places").cast("long")).alias("ordinal"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("start"), F.sum("n").alias("n")
    )
    tails = tails.where("n > start").select("stream", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return docs.unionByName(tails)


def match(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """Each written document and its count; an error where a stream has a document without a segment or the reverse."""
    both = keys.withColumn("__key", F.lit(True)).join(counts.withColumn("__count", F.col("ended")), ["stream", "ordinal"], "full")
    odd = F.concat(F.lit("documents and segments differ in stream "), F.col("stream"), F.lit(" at "), F.col("ordinal"))
    whole = F.coalesce(F.col("__key") & F.col("__count"), F.lit(False))
    return both.withColumn("n_tokens", F.when(whole, F.col("n_tokens")).otherwise(F.raise_error(odd).cast("long"))).drop("__key", "__count")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, stream, ordinal, start in the stream and n_tokens with the end id, from the flat files of all documents."""
    path = tokenizer_path("byte_bpe_50k.json")
    folder = new_folder(spark, "flat-tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    keys = write_flat(docs, path, folder, end_id=END_ID)
    blocks = materialize(scan_blocks(spark, folder, end_id=END_ID), "blocks")
    counts = count_tokens(blocks)
    return match(keys, counts).select(F.col("key").alias("doc_id"), "stream", "ordinal", "start", "n_tokens")
