"""Time-domain measures of traces, all from one scan.

Differences of neighbours are taken inside the row's array, so no window function
and no shuffle of samples is needed; the reductions are built-in aggregates whose
partial results are complete within a task, as a trace is one row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.dims import Window
from traceloom.functions.numeric import array_blank, divide
from traceloom.operators.spatial import aggregate_space

KEYS = ("recording", "epoch", "event")


def cut_windows(traces: DataFrame, windows: Sequence[Window]) -> DataFrame:
    """A row for each trace and window: window, first (sample), w (its samples, non-finite as null), coverage."""
    parts = []
    for w in windows:
        lo, n = w.bounds(F.col("t0"), F.col("sfreq"), F.size("x"))
        parts.append(F.struct(F.lit(w.name).alias("window"), lo.alias("first"), n.alias("n")))
    rows = traces.withColumn("_w", F.explode(F.array(*parts)))
    part = F.slice("x", F.col("_w.first") + 1, F.greatest(F.col("_w.n"), F.lit(0)))
    rows = rows.withColumns({"window": F.col("_w.window"), "first": F.col("_w.first"), "w": array_blank(part)}).drop("_w", "x")
    return rows.withColumn("coverage", divide(F.size(F.filter("w", lambda v: v.isNotNull())).cast("double"), F.size("w").cast("double")))


def zero_crossings(w: Column) -> Column:
    """Sign changes within finite runs; a zero continues the sign before it, a gap forgets it."""
    state = F.aggregate(
        w,
        F.struct(F.lit(0.0).alias("last"), F.lit(0).alias("n")),
        lambda acc, v: F.when(v.isNull(), F.struct(F.lit(0.0).alias("last"), acc["n"].alias("n"))).otherwise(
            F.struct(
                F.when(v != 0, F.signum(v)).otherwise(acc["last"]).alias("last"),
                (acc["n"] + ((v != 0) & (acc["last"] != 0) & (F.signum(v) != acc["last"])).cast("int")).alias("n"),
            )
        ),
    )
    return state["n"]


def _enough(count: Column, least: int, value: Column) -> Column:
    return F.when(count >= least, value)


def _aggregates(q: float, polarity: str) -> dict[str, Column]:
    """Measure -> aggregate over the samples v, first differences d and second differences d2 at i."""
    v, d, d2, i, sf = (F.col(c) for c in ("v", "d", "d2", "i", "sfreq"))
    n, nd, nd2 = F.count(v), F.count(d), F.count(d2)
    var, vd, vd2 = F.var_pop(v), F.var_pop(d), F.var_pop(d2)
    search = {"positive": v, "negative": -v}.get(polarity, F.abs(v))
    first_best = F.struct(search, -i)
    mobility = F.sqrt(divide(_enough(nd, 2, F.var_pop(d * sf)), F.when(var > 0, _enough(n, 2, var)))) / (2 * math.pi)
    complexity = F.when((var > 0) & (vd > 0) & (n >= 3) & (nd >= 2) & (nd2 >= 2), divide(F.sqrt(vd2 * var), vd))
    return {
        "variance": var,
        "ptp": F.max(v) - F.min(v),
        "mean_amplitude": F.avg(v),
        "rms": F.sqrt(F.avg(v * v)),
        "skewness": _enough(n, 3, F.skewness(v)),
        "kurtosis": _enough(n, 4, F.kurtosis(v)),
        "amplitude_quantile": F.percentile(v, q),
        "line_length": F.avg(F.abs(d) * sf),
        "hjorth_mobility": mobility,
        "hjorth_complexity": complexity,
        "auc": F.sum((v + v + d) / 2 / sf),
        "peak_amplitude": F.max_by(v, F.when(v.isNotNull(), first_best)),
        "peak_latency": F.max_by(F.col("t0") + i / sf, F.when(v.isNotNull(), first_best)),
        "zero_crossing_rate": F.when(n > 0, F.max("crossings") / (F.count("*") / F.first("sfreq"))),
    }


MEASURES = (
    "variance", "ptp", "mean_amplitude", "rms", "skewness", "kurtosis", "amplitude_quantile", "line_length", "hjorth_mobility", "hjorth_complexity",
    "auc", "peak_amplitude", "peak_latency", "zero_crossing_rate",
)


def temporal_channels(traces: DataFrame, windows: Sequence[Window], measures: Sequence[str] = MEASURES, q: float = 0.5, polarity: str = "absolute") -> DataFrame:
    """A column for each measure of each (row, channel, window), with coverage."""
    if not 0 <= q <= 1:
        raise ValueError("q must lie between 0 and 1")
    if polarity not in ("positive", "negative", "absolute"):
        raise ValueError(f"unknown polarity {polarity!r}")
    unknown = set(measures) - set(MEASURES)
    if unknown:
        raise ValueError(f"unknown measures {sorted(unknown)}")
    rows = cut_windows(traces, windows)
    n = F.size("w")
    d = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", i + 1) - F.get("w", i))
    rows = rows.where(n > 0).withColumn("d", d)
    d2 = F.transform(F.sequence(F.lit(0), F.size("d") - 1), lambda i: F.get("d", i + 1) - F.get("d", i))
    rows = rows.withColumn("d2", d2)
    if "zero_crossing_rate" in measures:
        rows = rows.withColumn("crossings", zero_crossings(F.col("w")))
    cells = rows.select(
        *KEYS, "channel", "window", "t0", "sfreq", "coverage", *(["crossings"] if "zero_crossing_rate" in measures else []),
        F.explode(F.transform(F.arrays_zip("w", "d", "d2"), lambda z, i: F.struct((i + F.col("first")).alias("i"), z["w"].alias("v"), z["d"].alias("d"), z["d2"].alias("d2")))).alias("z"),
    ).select("*", "z.*").drop("z")
    made = _aggregates(q, polarity)
    return cells.groupBy(*KEYS, "channel", "window").agg(F.first("coverage").alias("coverage"), *(made[m].alias(m) for m in measures))


def long_measures(wide: DataFrame, measures: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row for each measure: keep, measure, value."""
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures)))
    return wide.select(*keep, cells.alias("c")).select(*keep, "c.measure", "c.value")


def temporal_features(
    traces: DataFrame, windows: Sequence[Window], measures: Sequence[str] = MEASURES, groups: Mapping[str, Sequence[str]] | None = None,
    include_global: bool = True, q: float = 0.5, polarity: str = "absolute",
) -> DataFrame:
    """Long cells of the measures: keys, window, measure, space, space_kind, value, coverage."""
    wide = temporal_channels(traces, windows, measures, q, polarity)
    long = long_measures(wide, measures, [*KEYS, "channel", "window", "coverage"])
    return aggregate_space(long, [*KEYS, "window", "measure"], groups, include_global)
