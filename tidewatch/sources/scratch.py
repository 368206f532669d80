"""The folder that driver and executors share, for tables and files written between steps."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tidewatch-checkpoint-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application in the one that driver and executors share: spark.checkpoint.dir,
    else the context's own checkpoint folder. Without either a master within this process, as in tests,
    gets a new temporary one; on a cluster that is an error, as executors would not see it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not re.fullmatch(r"local(\[[\w*,]+\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(folder or _own_folder()).rstrip('/')}/tidewatch-{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and return the table read back: it is worked out once, and an executor
    that is lost costs a read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession) -> None:
    """Delete what was written for this application. Frames that were returned may read it, so call this
    when their results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
