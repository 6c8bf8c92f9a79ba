"""NDJSON files as a stream of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.results import from_ndjson
from tessera.plans.mapping import DatasetRun


def stream_results(spark: SparkSession, folder: str, *, strict: bool = False, max_files: int | None = None) -> DataFrame:
    """A streaming frame of results; a bad line is a row of its own, blank lines are skipped."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return from_ndjson(reader.text(folder), strict=strict)


def run_stream(results: DataFrame, out: str, checkpoint: str, *, on_batch: Callable[[DataFrame, int], None] | None = None) -> DatasetRun:
    """Processes what is there, writes Parquet to ``out`` and stops.

    Fails only if nothing was written; else the run holds what was, and the error.
    A new run with the same checkpoint goes on where this one stopped.
    """
    spark = results.sparkSession
    writer = results.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if on_batch is None:
        query = writer.format("parquet").option("path", out).start()
    else:

        def each(batch: DataFrame, number: int) -> None:
            batch.write.mode("append").parquet(out)
            on_batch(batch, number)

        query = writer.foreachBatch(each).start()
    error = None
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        error = str(e)
    finally:
        query.stop()
    try:
        rows = spark.read.schema(results.schema).parquet(out)
        if error and rows.isEmpty():
            raise RuntimeError(error)
    except Exception as e:
        if error:
            raise RuntimeError(error) from e
        rows = spark.createDataFrame([], results.schema)
    return DatasetRun(rows, error)
