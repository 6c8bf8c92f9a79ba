"""Files of bytes in the shared folder, written by executors and read by Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import hadoop_path, scratch_path


def new_folder(spark: SparkSession, label: str) -> str:
    """An empty folder below the shared scratch folder."""
    folder = scratch_path(spark, label)
    p, fs = hadoop_path(spark, folder)
    fs.mkdirs(p)
    return folder


def put(uri: str, data: bytes) -> None:
    """Write under a name of its own, then move: a task that runs twice leaves one whole file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, path)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of each file; names that begin with a dot are drafts and stay unread."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")
