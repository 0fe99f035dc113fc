"""Complexity measures of traces: one value for each row and window.

Ordinal patterns are built-in array functions; measures that compare all pairs of
templates or parse sequences run as vectorised kernels on Arrow batches of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions import kernels
from traceloom.functions.dims import Window
from traceloom.functions.numeric import blank
from traceloom.operators.spatial import aggregate_space
from traceloom.operators.temporal import cut_windows

KEYS = ("recording", "epoch", "event")


def signal_measure(
    traces: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], float], measure: str, windows: Sequence[Window], groups=None, include_global: bool = True
) -> DataFrame:
    """A user's kernel (samples, times) -> value over rows, windows and spatial units.

    Samples that are missing are NaN; results that are not finite are null.
    """

    @F.pandas_udf("double")
    def run(w: pd.Series, first: pd.Series, t0: pd.Series, sfreq: pd.Series) -> pd.Series:
        out = []
        for v, i, t, s in zip(w, first, t0, sfreq):
            x = np.array([np.nan if q is None else q for q in v], dtype=float)
            out.append(float(kernel(x, t + (i + np.arange(len(x))) / s)))
        return pd.Series(out)

    rows = cut_windows(traces, windows).where(F.size("w") > 0)
    cells = rows.select(*KEYS, "channel", "window", "coverage", F.lit(measure).alias("measure"), run("w", "first", "t0", "sfreq").alias("value"))
    return aggregate_space(cells.withColumn("value", blank("value")), [*KEYS, "window", "measure"], groups, include_global)


def sample_entropy(traces: DataFrame, windows: Sequence[Window], order: int = 2, r: float = 0.2, **kw) -> DataFrame:
    _check(order, r)
    return signal_measure(traces, lambda x, t: kernels.sample_entropy(x, order, r), "sampen", windows, **kw)


def multiscale_entropy(traces: DataFrame, windows: Sequence[Window], scale: int, order: int = 2, r: float = 0.2, original: bool = True, **kw) -> DataFrame:
    """Sample entropy of block means; the tolerance is the original trace's, or the scale's own."""
    _check(order, r)
    if scale < 1:
        raise ValueError("scale must be one at least")

    def kernel(x: np.ndarray, t: np.ndarray) -> float:
        return kernels.sample_entropy(kernels.coarse_grain(x, scale), order, r, kernels.tolerance_of(x, r) if original else None)

    return signal_measure(traces, kernel, f"mse{scale:02d}", windows, **kw)


def _check(order: int, r: float) -> None:
    if order < 1 or not r > 0:
        raise ValueError("order must be a positive number and r positive")


def higuchi_fd(traces: DataFrame, windows: Sequence[Window], k_max: int = 10, **kw) -> DataFrame:
    return signal_measure(traces, lambda x, t: kernels.higuchi(x, k_max), "higuchi_fd", windows, **kw)


def lempel_ziv(traces: DataFrame, windows: Sequence[Window], symbolization: str = "median", **kw) -> DataFrame:
    if symbolization not in ("median", "mean"):
        raise ValueError(f"unknown symbolization {symbolization!r}")
    return signal_measure(traces, lambda x, t: kernels.lempel_ziv(x, symbolization), "lempel_ziv_complexity", windows, **kw)


def detrended_fluctuation(traces: DataFrame, windows: Sequence[Window], **kw) -> DataFrame:
    return signal_measure(traces, lambda x, t: kernels.detrended_fluctuation(x), "dfa_exponent", windows, **kw)


def permutation_entropy(traces: DataFrame, windows: Sequence[Window], order: int = 3, delay: int = 1, groups=None, include_global: bool = True) -> DataFrame:
    """Entropy of ordinal patterns in bits, by that of all patterns being equal; null if a sample is missing.

    A pattern is the order of positions that sorts its samples, ties by position.
    """
    if order < 2 or delay < 1:
        raise ValueError("order must be two and delay one at least")
    rows = cut_windows(traces, windows).where((F.col("coverage") == 1) & (F.size("w") >= (order - 1) * delay + 1))
    starts = F.sequence(F.lit(0), F.size("w") - (order - 1) * delay - 1)
    pattern = lambda i: F.transform(
        F.array_sort(F.array(*(F.struct(F.get("w", i + k * delay).alias("v"), F.lit(k).alias("k")) for k in range(order)))), lambda s: s["k"]
    )
    cells = rows.select(*KEYS, "channel", "window", "coverage", F.explode(F.transform(starts, pattern)).alias("pattern"))
    counts = cells.groupBy(*KEYS, "channel", "window", "pattern").agg(F.count("*").cast("double").alias("n"), F.first("coverage").alias("coverage"))
    n = F.sum("n")
    entropy = (F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n) / F.log2(F.lit(float(factorial(order))))
    out = counts.groupBy(*KEYS, "channel", "window").agg(entropy.alias("value"), F.first("coverage").alias("coverage"))
    return aggregate_space(out.withColumn("measure", F.lit("permutation_entropy")), [*KEYS, "window", "measure"], groups, include_global)
