"""Tables written between steps, so that what follows starts at files that all machines see."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="traceloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SEEN: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the application may have ended by itself
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in a part of the shared folder that goes when the driver ends."""
    root = f"{shared_folder(spark)}/scratch/{spark.sparkContext.applicationId}"
    if root not in _SEEN:
        _SEEN.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
