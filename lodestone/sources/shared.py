"""The folder that driver and executors share, and tables on the way that are written to it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; in a temporary one on a local master, where that is unset. On a cluster it must be set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, worked out once and read from the shared folder from then on."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Removes what written() wrote for frames that nothing reads any more."""
    for df in frames:
        folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._lodestone_path)
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def store(path: str):
    """(filesystem, path in it) for a task that reads or writes files of the shared folder by itself."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)
