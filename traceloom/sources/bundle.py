"""Feature bundles: TSV matrices with a JSON sidecar, and partitioned Parquet.

A bundle is a folder with values, coverage and, if there, support as tab-separated
matrices (`n/a` for missing) and a sidecar that lists features with their hashed
metadata. It is written to a staging folder beside the target and renamed, so a
reader never sees half of one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.dims import canonical_json
from traceloom.operators.table import stack_rows, to_wide

ROW = ("recording", "epoch", "event")
NULL = "n/a"
VERSION = 1


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def meta_hash(meta: dict) -> str:
    return hashlib.sha256(canonical_json(meta).encode()).hexdigest()


def write_bundle(cells: DataFrame, meta: Sequence[dict], path: str, keys: Sequence[str] = ROW, overwrite: bool = False) -> None:
    """Write cells of the features in meta (dicts with the key feature) as a bundle."""
    spark = cells.sparkSession
    fs, hadoop = _filesystem(spark, path)
    if fs.exists(hadoop(path)) and not overwrite:
        raise FileExistsError(path)
    names = [m["feature"] for m in meta]
    if len(set(names)) != len(names):
        raise ValueError("features repeat")
    staging = f"{path.rstrip('/')}.staging"
    fs.delete(hadoop(staging), True)
    parts = ["value", "coverage"] + (["support"] if "support" in cells.columns else [])
    for part in parts:
        wide = to_wide(cells.select(*keys, "feature", F.col(part).alias("value")), names, keys)
        wide.write.options(sep="\t", header=True, nullValue=NULL, emptyValue="").csv(f"{staging}/{part}")
    sidecar = {"version": VERSION, "keys": [[k, dict(cells.dtypes)[k]] for k in keys], "parts": parts, "features": [m | {"sha256": meta_hash(m)} for m in meta]}
    spark.createDataFrame([(json.dumps(sidecar, sort_keys=True),)], "value string").coalesce(1).write.text(f"{staging}/sidecar")
    if fs.exists(hadoop(path)):
        fs.delete(hadoop(path), True)
    if not fs.rename(hadoop(staging), hadoop(path)):
        raise OSError(f"{staging} could not be renamed")


def read_sidecar(spark: SparkSession, path: str) -> dict:
    """The sidecar, its features' hashes checked."""
    sidecar = json.loads(spark.read.text(f"{path}/sidecar").first()["value"])
    if sidecar["version"] != VERSION:
        raise ValueError(f"unknown bundle version {sidecar['version']}")
    for m in sidecar["features"]:
        if meta_hash({k: v for k, v in m.items() if k != "sha256"}) != m["sha256"]:
            raise ValueError(f"the metadata of {m['feature']} do not fit their hash")
    return sidecar


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Long cells: keys, feature, value, coverage and support (1 if not kept)."""
    sidecar = read_sidecar(spark, path)
    names, keys = [m["feature"] for m in sidecar["features"]], sidecar["keys"]
    schema = ", ".join([f"`{k}` {t}" for k, t in keys] + [f"`{n}` double" for n in names])
    key_names = [k for k, _ in keys]

    def part(name: str) -> DataFrame:
        wide = spark.read.schema(schema).options(sep="\t", header=True, nullValue=NULL).csv(f"{path}/{name}")
        cells = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("v")) for n in names)))
        return wide.select(*key_names, cells.alias("c")).select(*key_names, "c.feature", F.col("c.v").alias(name))

    out = part("value").join(part("coverage"), [*key_names, "feature"])
    if "support" in sidecar["parts"]:
        return out.join(part("support"), [*key_names, "feature"])
    return out.withColumn("support", F.lit(1.0))


def read_dataset(spark: SparkSession, paths: Sequence[str], columns: str = "union") -> DataFrame:
    """Several bundles, rows bound."""
    return stack_rows([read_bundle(spark, p) for p in paths], columns)


def read_group_dataset(spark: SparkSession, paths: Sequence[str], columns: str = "union", validate: bool = True) -> DataFrame:
    """Bundles of trial groups, keyed by (recording, group); n_trials must be a positive number."""
    out = stack_rows([read_bundle(spark, p) for p in paths], columns, keys=("recording", "group"), validate=validate)
    if validate and "n_trials" in out.columns and not out.where("n_trials is null or n_trials < 1").isEmpty():
        raise ValueError("n_trials must be positive")
    return out


def write_cells(cells: DataFrame, path: str) -> None:
    """Long cells as Parquet, a folder for each recording, replaced recording by recording."""
    cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording").parquet(path)


def read_sidecar_table(spark: SparkSession, path: str, numeric: Sequence[str] = ()) -> DataFrame:
    """A TSV sidecar as strings, the named columns as numbers where they are."""
    out = spark.read.options(sep="\t", header=True, nullValue=NULL).csv(path)
    return out.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in numeric})


def discover(spark: SparkSession, root: str, pattern: str = "*.parquet", entity: str = r"([^/]+)\.parquet$", validate: bool = True) -> DataFrame:
    """(path, entity) of the files under root, hidden ones left out; two with one entity are an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    out = files.where(~F.col("path").rlike(r"/[._][^/]*$")).withColumn("entity", F.regexp_extract("path", entity, 1))
    if validate:
        twice = out.groupBy("entity").count().where("count > 1").limit(3).collect()
        if twice:
            raise ValueError(f"several inputs for {[r['entity'] for r in twice]}")
    return out


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def quality_report(quality: DataFrame, ledger: DataFrame, descriptors: DataFrame, keys: Sequence[str] = ROW, most: int = 1000) -> str:
    """An HTML report of feature quality and the exclusion ledger beside its descriptors; `most` ledger rows are shown."""
    listed = ledger.join(descriptors, list(keys), "left").orderBy(*keys).limit(most).toPandas()
    return f"<html><body><h1>Quality</h1>{quality.toPandas().to_html(index=False)}<h1>Exclusions</h1>{listed.to_html(index=False)}</body></html>"
