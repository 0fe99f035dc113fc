"""Driver tables as the engine's inputs: traces, spectra, long features, predictions.

All are narrow projections of one Parquet scan, so column pruning reaches the
files and no view shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SFREQ = 64.0
STEP_HZ = 0.75
ROW = ("recording", "epoch", "event")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keys(df: DataFrame) -> DataFrame:
    epoch = F.expr("vec_id div 4")
    return df.select(
        F.concat(F.lit("r"), (epoch % 5).cast("string")).alias("recording"),
        epoch.alias("epoch"),
        F.when(epoch % 2 == 0, "left").otherwise("right").alias("event"),
        F.expr("(vec_id div 20) % 3").alias("run"),
        F.concat(F.lit("c"), (F.col("vec_id") % 4).cast("string")).alias("channel"),
        "vec_id",
        F.transform("embedding", lambda v: v.cast("double")).alias("v"),
    )


def traces(spark: SparkSession, sf_dir: str, gaps: bool = True) -> DataFrame:
    """A row for each (recording, epoch, event, channel): t0, sfreq and the samples x.

    With gaps, sample i of vector v is NaN where v + 3 i divides by 101.
    """
    df = _keys(table(spark, sf_dir, "embeddings"))
    x = F.transform("v", lambda v, i: F.when((F.col("vec_id") + 3 * i) % 101 == 0, F.lit(float("nan"))).otherwise(v)) if gaps else F.col("v")
    return df.select(*ROW, "run", "channel", F.lit(0.0).alias("t0"), F.lit(SFREQ).alias("sfreq"), x.alias("x"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power over 64 bins of 0.75 Hz in two windows: x^2 of the vector, and its reverse as the baseline.

    Row: keys, channel, window, p (array). Bins are numbered from 0; coverage is
    the share of bins of the vector that are finite.
    """
    df = _keys(table(spark, sf_dir, "embeddings")).withColumn("vec_at", F.col("vec_id"))
    p = F.transform("v", lambda v: v * v)
    both = F.explode(F.array(F.struct(F.lit("stim").alias("window"), p.alias("p")), F.struct(F.lit("base").alias("window"), F.reverse(p).alias("p"))))
    return df.select(*ROW, "channel", both.alias("w")).select(*ROW, "channel", "w.window", "w.p")


def analytic(spark: SparkSession, sf_dir: str, band: str = "alpha", first: int = 0) -> DataFrame:
    """A complex trace of each epoch and node: channels (c0, c1) and (c2, c3) as real and imaginary parts."""
    df = _keys(table(spark, sf_dir, "embeddings")).withColumn("pair", F.expr("(vec_id % 4) div 2"))
    part = F.struct((F.col("channel").isin("c1", "c3")).alias("im"), "v")
    packed = df.groupBy(*ROW, "run", "pair").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return packed.where(F.size("parts") == 2).select(
        *ROW, "run", F.concat(F.lit("n"), F.col("pair").cast("string")).alias("channel"), F.lit(band).alias("band"), F.lit(SFREQ).alias("sfreq"),
        F.col("parts")[0]["v"].alias("re"), F.col("parts")[1]["v"].alias("im"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long feature cells of the order lines: (recording, epoch, event, feature, value, coverage, support, flagged).

    The value is null where order and line add up to a multiple of seven; coverage
    and support are fixed fractions of the line number; flagged marks discounts
    of nine per cent or more.
    """
    li = table(spark, sf_dir, "lineitem")
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    cells = F.explode(F.array(*(F.struct(F.lit(n[2:]).alias("feature"), F.col(n).cast("double").alias("value")) for n in names)))
    base = li.select(
        F.concat(F.lit("r"), (F.col("l_suppkey") % 7).cast("string")).alias("recording"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("epoch"),
        F.col("l_returnflag").alias("event"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 7 == 0).alias("gap"),
        (F.lit(1.0) - F.col("l_linenumber").cast("double") / 20).alias("coverage"),
        (F.lit(1.0) - F.col("l_linenumber").cast("double") / 40).alias("support"),
        (F.col("l_discount").cast("double") >= 0.09).alias("flagged"),
        *(F.col(n) for n in names),
    )
    long = base.select("recording", "epoch", "event", "gap", "coverage", "support", "flagged", cells.alias("c"))
    value = F.when(~(F.col("gap") & (F.col("c.feature") == "tax")), F.col("c.value"))
    return long.select(*ROW, F.col("c.feature").alias("feature"), value.alias("value"), "coverage", "support", "flagged")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed and predicted prices of order lines with subject, condition and fold."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("row"),
        F.col("l_linenumber").cast("int").alias("fold"),
        F.col("l_suppkey").cast("bigint").alias("subject"),
        F.col("l_returnflag").alias("condition"),
        F.col("l_extendedprice").cast("double").alias("y"),
        (F.col("l_quantity").cast("double") * 1500).alias("p"),
        (F.lit(30000.0) + F.col("l_discount").cast("double") * 1000).alias("nuisance"),
    )


#: The same views in DuckDB SQL, as common table expressions.
SQL = {
    "keyed": """keyed AS (
        SELECT 'r' || CAST((vec_id // 4) % 5 AS VARCHAR) AS recording, vec_id // 4 AS epoch, CASE WHEN (vec_id // 4) % 2 = 0 THEN 'left' ELSE 'right' END AS event,
               (vec_id // 20) % 3 AS run, 'c' || CAST(vec_id % 4 AS VARCHAR) AS channel, vec_id, embedding FROM embeddings)""",
    "samples": """samples AS (
        SELECT recording, epoch, event, run, channel, CAST(i AS BIGINT) AS i, i / 64.0e0 AS t,
               CASE WHEN (vec_id + 3 * i) % 101 = 0 THEN NULL ELSE CAST(embedding[CAST(i AS INT) + 1] AS DOUBLE) END AS x
        FROM keyed, generate_series(0, 63) AS g(i))""",
    "solid": """solid AS (
        SELECT recording, epoch, event, run, channel, CAST(i AS BIGINT) AS i, i / 64.0e0 AS t, CAST(embedding[CAST(i AS INT) + 1] AS DOUBLE) AS x
        FROM keyed, generate_series(0, 63) AS g(i))""",
    "bins": """bins AS (
        SELECT recording, epoch, event, channel, w AS "window", CAST(i AS INT) AS bin, 0.75e0 * i AS f,
               pow(CAST(embedding[CAST(CASE WHEN w = 'stim' THEN i ELSE 63 - i END AS INT) + 1] AS DOUBLE), 2) AS p
        FROM keyed, generate_series(0, 63) AS g(i), (VALUES ('stim'), ('base')) AS v(w))""",
    "analytic": """analytic AS (
        SELECT recording, epoch, event, run, 'n' || CAST((vec_id % 4) // 2 AS VARCHAR) AS channel, CAST(i AS BIGINT) AS i, i / 64.0e0 AS t,
               max(CASE WHEN vec_id % 2 = 0 THEN CAST(embedding[CAST(i AS INT) + 1] AS DOUBLE) END) AS re,
               max(CASE WHEN vec_id % 2 = 1 THEN CAST(embedding[CAST(i AS INT) + 1] AS DOUBLE) END) AS im
        FROM keyed, generate_series(0, 63) AS g(i) GROUP BY ALL HAVING count(*) = 2)""",
    "cells": """cells AS (
        SELECT 'r' || CAST(l_suppkey % 7 AS VARCHAR) AS recording, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS epoch, l_returnflag AS event, n AS feature,
               CASE WHEN n = 'tax' AND (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE CAST(
                    CASE n WHEN 'quantity' THEN l_quantity WHEN 'extendedprice' THEN l_extendedprice WHEN 'discount' THEN l_discount ELSE l_tax END AS DOUBLE) END AS value,
               1.0e0 - CAST(l_linenumber AS DOUBLE) / 20 AS coverage, 1.0e0 - CAST(l_linenumber AS DOUBLE) / 40 AS support, CAST(l_discount AS DOUBLE) >= 0.09e0 AS flagged
        FROM lineitem, (VALUES ('quantity'), ('extendedprice'), ('discount'), ('tax')) AS v(n))""",
    "predictions": """predictions AS (
        SELECT CAST(l_orderkey AS BIGINT) AS "row", CAST(l_linenumber AS INT) AS fold, CAST(l_suppkey AS BIGINT) AS subject, l_returnflag AS condition,
               CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) * 1500 AS p, 30000.0e0 + CAST(l_discount AS DOUBLE) * 1000 AS nuisance
        FROM lineitem)""",
}


def with_views(*names: str) -> str:
    """WITH clause of the named views and of those that they read."""
    need = list(names)
    if any(n in ("samples", "solid", "bins", "analytic") for n in need) and "keyed" not in need:
        need.insert(0, "keyed")
    return "WITH " + ",\n".join(SQL[n] for n in need)
