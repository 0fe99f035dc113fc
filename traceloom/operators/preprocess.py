"""Continuous recordings to clean epochs.

Recordings are sample rows (recording, channel, i, x) or epoch rows with arrays;
spans and events are small tables of intervals. Steps that look at neighbours in
time work inside a row's array where the samples of an epoch are one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import kernels
from traceloom.functions.numeric import array_blank, blank, pinned, runs

KEYS = ("recording", "epoch", "event")


def prepare_channels(traces: DataFrame, rename: Mapping[str, str] | None = None, bipolar: Mapping[str, tuple[str, str]] | None = None, drop: Sequence[str] = (), keys: Sequence[str] = KEYS) -> DataFrame:
    """Rename, derive differences (their sources stay), then drop channels."""
    out = traces
    if rename:
        out = out.replace(dict(rename), subset=["channel"])
    for name, (a, b) in (bipolar or {}).items():
        left, right = out.where(F.col("channel") == a), out.where(F.col("channel") == b).select(*keys, F.col("x").alias("_y"))
        made = left.join(right, list(keys)).withColumns({"channel": F.lit(name), "x": F.zip_with("x", "_y", lambda p, q: p - q)}).drop("_y")
        out = out.unionByName(made)
    return out.where(~F.col("channel").isin(list(drop))) if drop else out


def stimulus_events(samples: DataFrame, value: str = "x", within: Sequence[str] = ("recording",), order: str = "i", shortest: int = 1) -> DataFrame:
    """(within, i, code): onsets of runs of one code other than zero that last `shortest` samples at least."""
    w = Window.partitionBy(*within).orderBy(order)
    code = F.coalesce(F.col(value).cast("int"), F.lit(0))
    edges = samples.withColumns({"code": code, "before": F.coalesce(F.lag(code).over(w), F.lit(0)), "next_i": F.lead(order).over(w)})
    changes = edges.where("code <> before")
    c = Window.partitionBy(*within).orderBy(order)
    last = samples.groupBy(*within).agg((F.max(order) + 1).alias("_end"))
    spans = changes.withColumn("_next", F.lead(order).over(c)).join(last, list(within)).withColumn("n", F.coalesce("_next", "_end") - F.col(order))
    return spans.where((F.col("code") != 0) & (F.col("n") >= shortest)).select(*within, F.col(order).alias("i"), "code", "n")


def shift_events(events: DataFrame, delay: float, sfreq: float) -> DataFrame:
    """Events moved back by a delay in seconds, with their original sample."""
    return events.withColumns({"original_i": F.col("i"), "i": F.col("i") - round(delay * sfreq)})


def fixed_bounds(duration: float, overlap: float, sfreq: float) -> tuple[int, int]:
    """Samples and stride of fixed epochs, both of which must be whole."""
    samples, stride = duration * sfreq, (duration - overlap) * sfreq
    if round(samples) < 2 or abs(samples - round(samples)) > 1e-9 or abs(stride - round(stride)) > 1e-9 or round(stride) < 1:
        raise ValueError("duration and stride must be whole numbers of samples")
    return round(samples), round(stride)


def fixed_events(recordings: DataFrame, samples: int, stride: int) -> DataFrame:
    """(recording, epoch, i): starts of all windows that fit into each recording of n samples."""
    last = F.col("n") - samples
    starts = F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(stride).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return recordings.select("recording", F.posexplode(starts).alias("epoch", "i"))


def attach_metadata(events: DataFrame, sidecar: DataFrame, sfreq: float, label: str = "label") -> DataFrame:
    """Events with sidecar columns of the row at their sample that has their label, or of the only row there."""
    rows = sidecar.withColumn("i", F.round(F.col("onset") * sfreq).cast("bigint")).withColumnRenamed(label, "_label")
    alone = F.count("*").over(Window.partitionBy("recording", "i")) == 1
    both = events.join(rows.withColumn("_alone", alone), ["recording", "i"], "left")
    return both.where(F.col("_alone").isNull() | F.col("_alone") | (F.col("_label") == F.col(label))).drop("_alone", "_label")


def clip_spans(spans: DataFrame, recordings: DataFrame) -> DataFrame:
    """Spans [start, stop) cut to the part of the recording that is kept; those outside go."""
    both = spans.join(recordings.select("recording", "first", "last"), "recording")
    out = both.withColumns({"start": F.greatest("start", "first"), "stop": F.least("stop", "last")})
    return out.where("start < stop").drop("first", "last")


def cut_epochs(samples: DataFrame, events: DataFrame, before: int, after: int, bad_spans: DataFrame | None = None) -> DataFrame:
    """Samples of each event from i - before to i + after as arrays: recording, epoch, event, channel, x, n.

    Each sample is sent only to the events that it can belong to: both sides are
    keyed by buckets of the epoch's length, an event to those that it touches.
    Epochs that overlap a bad span, or miss samples, go.
    """
    size = before + after + 1
    own = events.withColumns({"lo": F.col("i") - before, "hi": F.col("i") + after})
    if bad_spans is not None:
        hit = own.alias("e").join(bad_spans.alias("b"), (F.col("e.recording") == F.col("b.recording")) & (F.col("b.start") <= F.col("e.hi")) & (F.col("b.stop") > F.col("e.lo")), "left_semi")
        own = own.join(hit.select("recording", "epoch"), ["recording", "epoch"], "left_anti")
    bucket = F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor(F.col("hi") / size))).alias("bucket")
    keyed = own.select("recording", "epoch", "event", "lo", "hi", bucket)
    rows = samples.withColumn("bucket", F.floor(F.col("i") / size)).join(keyed, ["recording", "bucket"]).where("i between lo and hi")
    packed = rows.groupBy("recording", "epoch", "event", "channel").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    return packed.where(F.size("s") == size).select("recording", "epoch", "event", "channel", F.col("s.x").alias("x"))


def baseline_epochs(traces: DataFrame, first: int, n: int) -> DataFrame:
    """x less the mean of its n samples from first on."""
    part = F.filter(F.slice("x", first + 1, n), lambda v: blank(v).isNotNull())
    mean = F.try_divide(F.aggregate(part, F.lit(0.0), lambda a, v: a + v), F.size(part).cast("double"))
    return pinned(traces, _m=mean).withColumn("x", F.transform("x", lambda v: v - F.col("_m"))).drop("_m")


def detrend_epochs(traces: DataFrame, method: str = "linear") -> DataFrame:
    """x less its mean, or less its least-squares line, over finite samples."""
    if method not in ("constant", "linear"):
        raise ValueError(f"unknown method {method!r}")
    s = F.aggregate(
        F.filter(F.transform("x", lambda v, i: F.struct(blank(v).alias("v"), i.cast("double").alias("i"))), lambda p: p["v"].isNotNull()),
        F.struct(*(F.lit(0.0).alias(c) for c in ("n", "t", "y", "tt", "ty"))),
        lambda a, p: F.struct((a["n"] + 1).alias("n"), (a["t"] + p["i"]).alias("t"), (a["y"] + p["v"]).alias("y"), (a["tt"] + p["i"] * p["i"]).alias("tt"), (a["ty"] + p["i"] * p["v"]).alias("ty")),
    )
    rows = pinned(traces, _s=s)
    n = F.col("_s.n")
    slope = F.coalesce(F.try_divide(F.col("_s.ty") - F.try_divide(F.col("_s.t") * F.col("_s.y"), n), F.col("_s.tt") - F.try_divide(F.col("_s.t") * F.col("_s.t"), n)), F.lit(0.0)) if method == "linear" else F.lit(0.0)
    rows = pinned(pinned(rows, _b=slope), _a=F.try_divide(F.col("_s.y") - F.col("_b") * F.col("_s.t"), n))
    return rows.withColumn("x", F.transform("x", lambda v, i: v - F.col("_a") - F.col("_b") * i)).drop("_s", "_a", "_b")


def reference_epochs(traces: DataFrame, reference: Sequence[str] | None = None) -> DataFrame:
    """x less the mean over all channels, or over the reference channels, at each sample."""
    own = traces if reference is None else traces.where(F.col("channel").isin(list(reference)))
    # An epoch's channels are collected as arrays, one row for each of them: samples are not shuffled one by one.
    held = own.groupBy(*KEYS).agg(F.collect_list(F.struct("channel", array_blank("x").alias("x"))).alias("_c"))
    held = pinned(held, _xs=F.transform(F.array_sort("_c"), lambda c: c["x"])).drop("_c")
    at = lambda i: F.filter(F.transform("_xs", lambda x: F.get(x, i)), lambda v: v.isNotNull())
    longest = F.aggregate("_xs", F.lit(0), lambda a, x: F.greatest(a, F.size(x)))
    mean = F.transform(F.filter(F.sequence(F.lit(0), longest), lambda i: i < longest), lambda i: F.try_divide(F.aggregate(at(i), F.lit(0.0), lambda a, v: a + v), F.size(at(i)).cast("double")))
    means = pinned(held, _m=mean).drop("_xs")
    return traces.join(means, list(KEYS)).withColumn("x", F.zip_with("x", "_m", lambda a, b: a - b)).drop("_m")


def interpolation_weights(places: Mapping[str, Sequence[float]], bad: Sequence[str], order: int = 4, terms: int = 7, ridge: float = 1e-5) -> list[tuple[str, str, float]]:
    """(bad, good, weight) of spherical splines over unit sensor places (Perrin et al., 1989)."""
    good = [c for c in places if c not in bad]
    unit = {c: np.asarray(p, dtype=float) / np.linalg.norm(p) for c, p in places.items()}

    def g(cos: np.ndarray) -> np.ndarray:
        coefficients = [0.0] + [(2 * n + 1) / (n**order * (n + 1) ** order * 4 * np.pi) for n in range(1, terms + 1)]
        return np.polynomial.legendre.legval(cos, coefficients)

    a, b = np.stack([unit[c] for c in good]), np.stack([unit[c] for c in bad])
    k = len(good)
    system = np.ones((k + 1, k + 1))
    system[:k, :k] = g(np.clip(a @ a.T, -1, 1)) + ridge * np.eye(k)
    system[k, k] = 0
    w = np.hstack([g(np.clip(b @ a.T, -1, 1)), np.ones((len(bad), 1))]) @ np.linalg.pinv(system)[:, :k]
    return [(x, y, float(w[i, j])) for i, x in enumerate(bad) for j, y in enumerate(good)]


def interpolate_channels(traces: DataFrame, weights: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Bad channels replaced by weighted sums of good ones; the weights are channels by channels."""
    w = traces.sparkSession.createDataFrame(list(weights), "bad string, channel string, w double")
    bad = sorted({b for b, _, _ in weights})
    rest = [c for c in traces.columns if c not in (*KEYS, "channel", "x")]
    held = traces.join(F.broadcast(w), "channel").groupBy(*KEYS, *rest, "bad").agg(F.array_sort(F.collect_list(F.struct("channel", "w", "x"))).alias("_c"))
    longest = F.aggregate("_c", F.lit(0), lambda a, c: F.greatest(a, F.size(c["x"])))
    at = lambda i: F.filter(F.transform("_c", lambda c: c["w"] * F.get(c["x"], i)), lambda v: v.isNotNull())
    total = F.transform(F.filter(F.sequence(F.lit(0), longest), lambda i: i < longest), lambda i: F.when(F.size(at(i)) > 0, F.aggregate(at(i), F.lit(0.0), lambda a, v: a + v)))
    made = pinned(held, x=total).drop("_c").withColumnRenamed("bad", "channel")
    return traces.where(~F.col("channel").isin(bad)).unionByName(made)


def decimate_epochs(traces: DataFrame, factor: int) -> DataFrame:
    """Every factor-th sample, from the first."""
    if factor < 1:
        raise ValueError("factor must be one at least")
    return traces.withColumns({"x": F.filter("x", lambda v, i: i % factor == 0), "sfreq": F.col("sfreq") / factor})


def crop_epochs(traces: DataFrame, tmin: float, tmax: float) -> DataFrame:
    """Samples from tmin to tmax, with the new start."""
    lo = F.greatest(F.lit(0), F.ceil((F.lit(tmin) - F.col("t0")) * F.col("sfreq") - 1e-9)).cast("int")
    hi = F.least(F.size("x") - 1, F.floor((F.lit(tmax) - F.col("t0")) * F.col("sfreq") + 1e-9)).cast("int")
    out = traces.withColumns({"_lo": lo, "_hi": hi}).where("_lo <= _hi")
    return out.withColumns({"x": F.slice("x", F.col("_lo") + 1, F.col("_hi") - F.col("_lo") + 1), "t0": F.col("t0") + F.col("_lo") / F.col("sfreq")}).drop("_lo", "_hi")


def peak_to_peak(x: Column) -> Column:
    v = F.filter(x, lambda q: blank(q).isNotNull())
    return F.array_max(v) - F.array_min(v)


def reject_epochs(traces: DataFrame, reject: float | None = None, flat: float | None = None) -> DataFrame:
    """Epochs without a channel whose peak-to-peak is over reject or under flat."""
    p = peak_to_peak(F.col("x"))
    bad = F.lit(False)
    if reject is not None:
        bad = bad | (p > reject)
    if flat is not None:
        bad = bad | (p < flat)
    return traces.join(traces.where(bad).select(*KEYS).distinct(), list(KEYS), "left_anti")


def review_epochs(traces: DataFrame, dropped: DataFrame) -> DataFrame:
    return traces.join(dropped.select(*KEYS).distinct(), list(KEYS), "left_anti")


def amplitude_spans(traces: DataFrame, limit: float, least: int = 1) -> DataFrame:
    """(keys, channel, start, stop): runs of samples whose size is over the limit, `least` samples long at least."""
    found = F.filter(runs(F.transform("x", lambda v: F.abs(v) > limit)), lambda q: q["length"] >= least)
    return traces.select(*KEYS, "channel", F.explode(found).alias("q")).select(*KEYS, "channel", F.col("q.start").alias("start"), (F.col("q.start") + F.col("q.length")).alias("stop"))


def break_spans(events: DataFrame, least: float, before: float = 0.0, after: float = 0.0, by: Sequence[str] = ("recording",), time: str = "t") -> DataFrame:
    """(by, start, stop): gaps between events of at least `least` seconds, less a margin at both ends."""
    w = Window.partitionBy(*by).orderBy(time)
    gaps = events.select(*by, F.col(time).alias("start"), F.lead(time).over(w).alias("stop")).where(F.col("stop") - F.col("start") >= least)
    return gaps.withColumns({"start": F.col("start") + after, "stop": F.col("stop") - before}).where("stop > start")


def bad_channels(traces: DataFrame, z: float = 5.0, flat: float = 1e-9) -> DataFrame:
    """(recording, channel, deviation_z, is_flat, bad): robust z of each channel's spread among its recording's."""
    spread = traces.select("recording", "channel", F.explode(array_blank("x")).alias("v")).groupBy("recording", "channel").agg(F.stddev_pop("v").alias("sd"))
    middle = spread.groupBy("recording").agg(F.percentile("sd", 0.5).alias("med"))
    away = spread.join(middle, "recording").withColumn("away", F.abs(F.col("sd") - F.col("med")))
    scale = away.groupBy("recording").agg((F.percentile("away", 0.5) / 0.6744897501960817).alias("mad"))
    out = away.join(scale, "recording").withColumn("deviation_z", F.try_divide(F.col("sd") - F.col("med"), F.col("mad")))
    return out.select("recording", "channel", "deviation_z", (F.col("sd") < flat).alias("is_flat"), (F.coalesce(F.abs("deviation_z") > z, F.lit(False)) | (F.col("sd") < flat)).alias("bad"))


def bridged_pairs(traces: DataFrame) -> DataFrame:
    """(recording, a, b, distance): variance of the difference of two channels, mean over epochs."""
    left, right = traces.select(*KEYS, F.col("channel").alias("a"), F.col("x").alias("xa")), traces.select(*KEYS, F.col("channel").alias("b"), F.col("x").alias("xb"))
    cells = left.join(right, list(KEYS)).where("a < b").select(*KEYS, "a", "b", F.explode(F.zip_with(array_blank("xa"), array_blank("xb"), lambda p, q: p - q)).alias("d"))
    return cells.groupBy(*KEYS, "a", "b").agg(F.var_pop("d").alias("v")).groupBy("recording", "a", "b").agg(F.avg("v").alias("distance"))


def repair_interval(traces: DataFrame, first: int, last: int, mode: str = "linear") -> DataFrame:
    """Samples from first to last replaced: by the line between their neighbours, or by the first neighbour."""
    a, b = F.get("x", F.lit(first - 1)), F.get("x", F.lit(last + 1))
    share = lambda i: (i - (first - 1)) / float(last - first + 2)
    value = {"linear": lambda i: a + (b - a) * share(i), "constant": lambda i: a}[mode]
    return traces.withColumn("x", F.transform("x", lambda v, i: F.when(i.between(first, last), value(i)).otherwise(v)))


def filter_traces(traces: DataFrame, sfreq: float, fmin: float, fmax: float) -> DataFrame:
    """Zero-phase band-pass of each row; a row with a bad sample is all null."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([kernels.band_analytic(np.asarray(v, dtype=float), sfreq, fmin, fmax)[0].real for v in x])

    return traces.withColumn("x", array_blank(run("x")))


def notch_traces(traces: DataFrame, sfreq: float, centres: Sequence[float], width: float = 2.0) -> DataFrame:
    """Each row less its narrow bands around the centres."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        out = []
        for v in x:
            v = np.asarray(v, dtype=float)
            out.append(v - sum(kernels.band_analytic(v, sfreq, c - width / 2, c + width / 2)[0].real for c in centres))
        return pd.Series(out)

    return traces.withColumn("x", array_blank(run("x")))


def regress_channel(traces: DataFrame, reference: str) -> DataFrame:
    """Other channels less their least-squares part of the reference channel, over each recording."""
    ref = traces.where(F.col("channel") == reference).select(*KEYS, F.col("x").alias("_r"))
    both = traces.where(F.col("channel") != reference).join(ref, list(KEYS))
    cells = both.select("recording", "channel", F.explode(F.arrays_zip(array_blank("x").alias("v"), array_blank("_r").alias("r"))).alias("z"))
    beta = cells.groupBy("recording", "channel").agg(F.coalesce(F.regr_slope("z.v", "z.r"), F.lit(0.0)).alias("_b"))
    return both.join(beta, ["recording", "channel"]).withColumn("x", F.zip_with("x", "_r", lambda v, r: v - F.col("_b") * r)).drop("_r", "_b")
