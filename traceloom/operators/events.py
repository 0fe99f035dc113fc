"""Bursts and event-related power changes: runs and latencies within a trace's row.

An envelope or power trace is one row, so runs are found by array functions inside
the row: no window function, no shuffle of samples. Thresholds and references are
aggregates of the same array.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.dims import Band, Window, minimum_samples
from traceloom.functions.numeric import array_blank, divide, pinned, runs
from traceloom.operators.spatial import aggregate_space
from traceloom.operators.temporal import long_measures

KEYS = ("recording", "epoch", "event")
BURSTS = ("count", "rate", "duration_mean", "amp_mean", "fraction_above")
ERDS = (
    "erds_mean", "erds_slope", "erd_magnitude", "erd_duration", "ers_magnitude", "ers_duration", "erds_peak_latency", "erds_onset_latency", "erds_rebound_latency",
)
#: A baseline at or under this share of the epoch's mean power anchors no ratio (fixed value).
DEGENERATE = 1e-6
#: Power over this many times the baseline is flagged (fixed value).
EXTREME = 1e4


def _slice(values: Column, window: Window) -> Column:
    lo, n = window.bounds(F.col("t0"), F.col("sfreq"), F.size(values))
    return F.slice(values, lo + 1, n)


def _first(window: Window, values: Column) -> Column:
    return window.bounds(F.col("t0"), F.col("sfreq"), F.size(values))[0]


def _sum(values: Column) -> Column:
    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)


def _count(values: Column) -> Column:
    return F.size(F.filter(values, lambda v: v.isNotNull()))


def _mean(values: Column) -> Column:
    return divide(_sum(values), _count(values).cast("double"))


def quantile(values: Column, q: float) -> Column:
    """Linear quantile of an array's elements that are not null."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    at = (F.size(v) - 1) * F.lit(float(q))
    lo = F.floor(at).cast("int")
    a, b = F.get(v, lo), F.get(v, F.least(lo + 1, F.size(v) - 1))
    return F.when(F.size(v) > 0, a + (b - a) * (at - lo))


def burst_channels(envelopes: DataFrame, windows: Sequence[Window], baseline: Window | None = None, threshold: float = 0.75, min_ms: float = 100.0, sfreq: float = 64.0) -> DataFrame:
    """The five burst measures of each row, channel and window, with coverage.

    The threshold is the quantile of the row's own envelope over the baseline, or
    over the union of the windows.
    """
    rows = envelopes.withColumn("x", array_blank("x"))
    if baseline is not None:
        calibration = _slice(F.col("x"), baseline)
    else:
        time = lambda i: F.col("t0") + i / F.col("sfreq")
        inside = lambda i: _any([w.holds(time(i)) for w in windows])
        calibration = F.transform("x", lambda v, i: F.when(inside(i), v))
    rows = pinned(rows, threshold=quantile(calibration, threshold))
    parts = F.explode(F.array(*(F.struct(F.lit(w.name).alias("window"), _slice(F.col("x"), w).alias("w")) for w in windows)))
    rows = rows.select(*KEYS, "channel", "sfreq", "threshold", parts.alias("_p")).select("*", "_p.*").drop("_p")
    rows = rows.withColumns({"n": F.size("w"), "finite": _count(F.col("w")), "above": F.transform("w", lambda v: v > F.col("threshold"))})
    least = minimum_samples(min_ms / 1000, sfreq)
    rows = rows.withColumns({"kept": F.filter(runs("above"), lambda r: r["length"] >= least), "n_above": F.size(F.filter("above", lambda a: F.coalesce(a, F.lit(False))))})
    peaks = F.transform("kept", lambda r: F.array_max(F.slice("w", r["start"] + 1, r["length"])))
    usable = F.col("threshold").isNotNull() & (F.col("finite") > 0)
    k, seconds = F.size("kept"), F.col("n") / F.col("sfreq")
    return rows.select(
        *KEYS, "channel", "window", divide(F.col("finite").cast("double"), F.col("n").cast("double")).alias("coverage"),
        F.when(usable, k.cast("double")).alias("count"),
        F.when(usable, divide(k.cast("double"), seconds)).alias("rate"),
        F.when(usable & (k > 0), _sum(F.transform("kept", lambda r: r["length"].cast("double"))) / k / F.col("sfreq")).alias("duration_mean"),
        F.when(usable & (k > 0), _sum(peaks) / k).alias("amp_mean"),
        F.when(usable, F.col("n_above") / F.col("finite")).alias("fraction_above"),
    )


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def burst_features(envelopes: DataFrame, windows: Sequence[Window], measures: Sequence[str] = BURSTS, groups: Mapping[str, Sequence[str]] | None = None, include_global: bool = True, **kw) -> DataFrame:
    """Long cells of burst measures over channels, regions and all."""
    long = long_measures(burst_channels(envelopes, windows, **kw), measures, [*KEYS, "channel", "window", "coverage"])
    return aggregate_space(long, [*KEYS, "window", "measure"], groups, include_global)


def erds_channels(
    power: DataFrame, baseline: Window, windows: Sequence[Window], mode: str = "db", onset_samples: int | None = None, band: Band | None = None, sfreq: float = 64.0,
) -> DataFrame:
    """Event-related measures of power traces (array x), with coverage and baseline flags.

    The trace is 10 log10(p / r) or 100 (p - r) / r of the row's mean power r over
    the baseline. A degenerate r makes the trace null and is flagged.
    """
    if mode not in ("db", "percent"):
        raise ValueError(f"unknown normalisation {mode!r}")
    if onset_samples is None:
        onset_samples = minimum_samples(6.0 / (band.fmin if band else 8.0), sfreq)
    rows = power.withColumn("x", array_blank("x"))
    rows = rows.withColumn("base", _slice(F.col("x"), baseline))
    rows = rows.withColumns({"raw": _mean(F.col("base")), "scale": _mean(F.col("x")), "top": F.array_max(F.filter("x", lambda v: v.isNotNull())), "base_share": _count(F.col("base")) / F.size("base")})
    rows = pinned(rows, raw=F.col("raw")).withColumn("deviation", F.sqrt(_mean(F.transform("base", lambda v: F.pow(v - F.col("raw"), 2)))))
    degenerate = F.coalesce((F.col("raw") <= 0) | (F.col("raw") <= DEGENERATE * F.col("scale")), F.lit(True))
    rows = rows.withColumns({"baseline_degenerate": degenerate, "r": F.when(~degenerate, F.col("raw"))})
    rows = rows.withColumn("baseline_extreme_ratio", F.coalesce(F.col("top") > EXTREME * F.col("r"), F.lit(False)))
    parts = F.explode(F.array(*(F.struct(F.lit(w.name).alias("window"), _first(w, F.col("x")).alias("first"), _slice(F.col("x"), w).alias("p")) for w in windows)))
    rows = rows.select(*KEYS, "channel", "t0", "sfreq", "r", "deviation", "base_share", "baseline_degenerate", "baseline_extreme_ratio", parts.alias("_p")).select("*", "_p.*").drop("_p")
    r = F.col("r")
    trace = {
        "db": lambda v: 10 * F.log10(F.when(v > 0, divide(v, r))),
        "percent": lambda v: 100 * divide(v - r, r),
    }[mode]
    rows = rows.withColumn("y", F.transform("p", trace))
    place = lambda i: F.col("t0") + (F.col("first") + i) / F.col("sfreq")
    points = F.filter(F.transform("y", lambda v, i: F.struct(v.alias("y"), i.alias("i"))), lambda s: s["y"].isNotNull())
    rows = rows.withColumns({"points": points})
    # Least-squares sums around the first sample of the window.
    s = F.aggregate(
        "points",
        F.struct(*(F.lit(0.0).alias(c) for c in ("n", "t", "y", "tt", "ty"))),
        lambda a, q: F.struct((a["n"] + 1).alias("n"), (a["t"] + q["i"]).alias("t"), (a["y"] + q["y"]).alias("y"), (a["tt"] + q["i"] * q["i"]).alias("tt"), (a["ty"] + q["i"] * q["y"]).alias("ty")),
    )
    rows = rows.withColumns({
        "s": s,
        "peak": F.array_max(F.transform("points", lambda q: F.struct(F.abs(q["y"]).alias("a"), (-q["i"]).alias("i")))),
        "low": F.filter("y", lambda v: v < 0),
        "high": F.filter("y", lambda v: v > 0),
        "onsets": F.filter(runs(F.transform("p", lambda v: F.abs(v - r) > F.col("deviation"))), lambda q: q["length"] >= onset_samples),
    })
    rows = rows.withColumn("after", F.array_max(F.transform(F.filter("points", lambda q: q["i"] > -F.col("peak.i")), lambda q: F.struct(q["y"].alias("y"), (-q["i"]).alias("i")))))
    n = F.col("s.n")
    usable = n > 0
    slope = divide(F.col("s.ty") - F.col("s.t") * F.col("s.y") / n, F.col("s.tt") - F.col("s.t") * F.col("s.t") / n) * F.col("sfreq")
    return rows.select(
        *KEYS, "channel", "window", F.least(divide(_count(F.col("p")).cast("double"), F.size("p").cast("double")), F.col("base_share")).alias("coverage"),
        "baseline_degenerate", "baseline_extreme_ratio",
        F.when(usable, F.col("s.y") / n).alias("erds_mean"),
        F.when(n > 2, slope).alias("erds_slope"),
        F.when(usable, F.coalesce(-_mean(F.col("low")), F.lit(0.0))).alias("erd_magnitude"),
        F.when(usable, F.size("low") / F.col("sfreq")).alias("erd_duration"),
        F.when(usable, F.coalesce(_mean(F.col("high")), F.lit(0.0))).alias("ers_magnitude"),
        F.when(usable, F.size("high") / F.col("sfreq")).alias("ers_duration"),
        F.when(usable, place(-F.col("peak.i"))).alias("erds_peak_latency"),
        F.when(usable, place(F.get("onsets", F.lit(0))["start"])).alias("erds_onset_latency"),
        F.when(usable, place(-F.col("after.i"))).alias("erds_rebound_latency"),
    )


def erds_features(power: DataFrame, baseline: Window, windows: Sequence[Window], measures: Sequence[str] = ERDS, groups=None, include_global: bool = True, **kw) -> DataFrame:
    """Long cells of event-related measures with their flags."""
    flags = ("baseline_degenerate", "baseline_extreme_ratio")
    long = long_measures(erds_channels(power, baseline, windows, **kw), measures, [*KEYS, "channel", "window", "coverage", *flags])
    return aggregate_space(long, [*KEYS, "window", "measure"], groups, include_global, flags=flags)


def power_traces(signals: DataFrame) -> DataFrame:
    """Traces of squared samples: instantaneous power of a real band signal."""
    return signals.withColumn("x", F.transform("x", lambda v: v * v))


def envelope_traces(signals: DataFrame) -> DataFrame:
    return signals.withColumn("x", F.transform("x", lambda v: F.abs(v)))


