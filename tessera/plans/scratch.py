"""Tables written once, so that side effects and sorts aren't repeated."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
#: Local folders of applications whose session names no shared one.
_local: dict[str, str] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir (a local folder only where none is set); what is there goes when this process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        root = _local.get(app) or _local.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tessera-scratch-"))
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def write_once(df: DataFrame, label: str) -> DataFrame:
    """Parquet in the scratch folder, read back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch() -> None:
    """Deletes what this process wrote and may still delete."""
    while _written:
        spark, path = _written.pop()
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session is gone: nothing is left to ask
            return


atexit.register(drop_scratch)
