"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the session's checkpoint folder; nothing is created yet."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    base = re.sub(r"^file:/+", "file:///", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def file_system(folder: str):
    """(pyarrow file system, path) of a folder; any store that pyarrow reads."""
    from pyarrow import fs

    if "://" not in folder:
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and any executor may be lost."""
    return stored_at(df, purpose)[0]


def stored_at(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """``stored``, and the folder for a later ``discard``."""
    spark = df.sparkSession
    folder = shared_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a stored table that nothing reads any more, in whatever store the shared folder is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
