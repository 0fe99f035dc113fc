"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors share (spark.checkpoint.dir).

    Where the session names none, a local session gets a temporary folder, as in
    a test; on a cluster, whose machines do not share one, it is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        try:
            conf = spark.conf.get("spark.checkpoint.dir")
        except Exception:
            conf = None
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="traceloom-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


_SEEN: set[str] = set()
#: Scratch tables by the scopes that are open.
_SCOPES: list[list[str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the application may have ended by itself
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in a part of it that goes when the driver ends."""
    root = f"{shared_folder(spark)}/llm-scratch/{spark.sparkContext.applicationId}"
    if root not in _SEEN:
        _SEEN.add(root)
        atexit.register(_remove, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def release(spark: SparkSession, path: str | None) -> None:
    """Remove a scratch table that nothing reads any more."""
    if path:
        _remove(spark, path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables that are made within it; what is wanted of them is written before it ends."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again.

    The result no longer depends on executors that may go: its lineage starts
    at files that all of them see.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch at most, beyond its first row.
BATCH_BYTES = 2 << 20


def _returned() -> None:
    """Give the memory that this worker has freed back to the system, for the tasks beside it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches of bounded bytes, so that long texts do not add up in a worker.

    The plan is made when the query runs, so the setting must still hold then: it
    sets the session's spark.sql.execution.arrow.maxBytesPerBatch to BATCH_BYTES.
    Workers live on after a task, without the memory that it has taken.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches):
        try:
            yield from run(batches)
        finally:
            _returned()

    return df.mapInArrow(task, schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def min_components(
    spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60
) -> DataFrame:
    """Connected components of an edge list: (node, component), the smallest node of each.

    Each round maps every node to the smallest neighbour of its smallest
    neighbour and contracts the edges by that map, until none is left. The image
    of a connected set under the map is connected and its smallest node stays, so
    nothing is lost. Neighbours are aggregated by min, never collected; nodes
    without an edge to another node do not appear.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    e = cut(spark, e, "edges")
    total = None
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        near = cut(spark, near, "near")
        far = near.select(F.col("v").alias("m"), F.col("m").alias("f"))
        step = cut(spark, near.join(far, "m").select("v", "f"), "step")
        total = step if total is None else total.join(
            step.select(F.col("v").alias("f"), F.col("f").alias("g")), "f", "left"
        ).select("v", F.coalesce("g", "f").alias("f"))
        fa = step.select(F.col("v").alias("a"), F.col("f").alias("fa"))
        fb = step.select(F.col("v").alias("b"), F.col("f").alias("fb"))
        e = cut(
            spark,
            e.join(fa, "a").join(fb, "b").select(F.col("fa").alias("a"), F.col("fb").alias("b")).where("a <> b").distinct(),
            "edges",
        )
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if total is None:
        total = e.select(F.col("a").alias("v"), F.col("b").alias("f"))
    return total.select(F.col("v").alias("node"), F.col("f").alias("component"))
