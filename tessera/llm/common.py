"""Scratch tables in the shared folder, and joins that broadcast only what was measured.

Every operator that needs a value twice writes it as Parquet below
``spark.checkpoint.dir`` (the folder all executors share) and reads it back:
lineage is cut, a lost executor costs a re-read, and the planner knows the
size of what it joins.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast only if it takes at most this many bytes by its rows and by its files.
BROADCAST_BYTES = 16 << 20
#: Bytes of a row of a hash table besides its columns; times that Parquet may have made values smaller.
ROW_BYTES, COMPRESSED = 32, 4
#: Buckets over which the rows of one hot key are spread in a salted join.
SALTS = 32

_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder; a local one only where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tessera-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_scratch() -> None:
    """Delete every scratch table this process wrote and may still delete."""
    while _written:
        spark, path = _written.pop()
        try:
            p, fs = hadoop_path(spark, path)
            fs.delete(p, True)
        except Exception:  # the session is gone: nothing is left to ask
            return


atexit.register(drop_scratch)


def table_bytes(df: DataFrame) -> int:
    """Bytes that a table read from files may take in memory: by its rows, and by its files as if they were compressed well."""
    spark, total = df.sparkSession, 0
    for name in df.inputFiles():
        p, fs = hadoop_path(spark, name)
        total += fs.getFileStatus(p).getLen()
    total *= COMPRESSED
    return total if total > BROADCAST_BYTES else max(total, df.count() * (ROW_BYTES + 8 * len(df.columns)))


def join_lookup(big: DataFrame, small: DataFrame, key: str, salt: Column | None = None) -> DataFrame:
    """Left-join ``small`` (materialized, unique ``key``) onto ``big``.

    Small enough by its rows and files: broadcast, and ``big`` isn't shuffled.
    Else both sides are shuffled, and adaptive execution splits the partition of
    a key that a third of all rows share; with ``salt`` both are dealt by (key,
    salt) over SALTS tasks a key, for plans whose partitions Spark can't split.
    Null keys find nothing and stay.
    """
    if table_bytes(small) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), key, "left")
    if salt is None:
        return big.join(small, key, "left")
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], "left").drop("__salt")


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; the folder is a parameter."""
    folder = os.environ.get("TESSERA_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, name)


#: Rows and bytes of text that one call of a batch function gets at most (a longer single text goes alone).
SLICE_ROWS, SLICE_BYTES = 512, 8 << 20


#: Rows of an Arrow batch where the session leaves Spark's default: texts of ten thousand rows are much for one worker.
BATCH_SETTING, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1024"


def smaller_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def slices(batch: pa.RecordBatch):
    """Parts of a batch within SLICE_ROWS and about SLICE_BYTES, in order."""
    step = max(1, min(SLICE_ROWS, int(SLICE_ROWS * SLICE_BYTES / max(batch.nbytes, 1)) or 1) if batch.nbytes > SLICE_BYTES else SLICE_ROWS)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def text_slices(batch: pa.RecordBatch, column: int):
    """Parts of a batch whose texts have SLICE_BYTES at most, in order, however many rows; a longer text goes alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def give_back() -> None:
    """Hands the memory that a worker has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(
    df: DataFrame,
    carry: list[str],
    inputs: list[Column],
    run: Callable[[list[pa.Array]], list[pa.Array]],
    out: dict[str, str],
) -> DataFrame:
    """``carry`` columns as they are, then ``out`` columns that ``run`` makes of the inputs, row for row."""
    smaller_batches(df.sparkSession)
    chosen = df.select(*carry, *[c.alias(f"__in{i}") for i, c in enumerate(inputs)])
    n, taken = len(carry), len(inputs)
    names = [*carry, *out]
    types = [pa_type(t) for t in out.values()]

    def go(batches):
        for batch in batches:
            for part in slices(batch):
                made = run([whole(part.column(n + i)) for i in range(taken)])
                made = [a if a.type == t else a.cast(t) for a, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(n)], *made], names=names)
        give_back()

    fields = [f for f in chosen.schema.fields[:n]]
    schema = T.StructType([*fields, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in out.items()]])
    return chosen.mapInArrow(go, schema)


def whole(array: pa.Array) -> pa.Array:
    """A sliced list column with offsets that start at 0."""
    return pa.concat_arrays([array]) if array.offset else array


def pa_type(ddl: str) -> pa.DataType:
    simple = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}
    if ddl.startswith("array<"):
        return pa.list_(pa_type(ddl[6:-1]))
    return simple[ddl]
