"""Spectral measures of power over frequency bins.

A spectrum is one row: keys, channel, window and the array p over a shared axis.
The bins are exploded next to the scan, weights come from a small dimension of
bins by bands, and every measure is a built-in weighted aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.dims import STANDARD_BANDS, Band, weights_table
from traceloom.functions.numeric import blank, divide, is_finite
from traceloom.operators.spatial import aggregate_space

KEYS = ("recording", "epoch", "event")
#: Share of a row's greatest power that log scales and ratios stop at (fixed value).
FLOOR = 1e-12
MAD_SCALE = 0.6744897501960817


def bin_rows(spectra: DataFrame) -> DataFrame:
    """keys, channel, window, bin and p (null if not finite)."""
    return spectra.select(*KEYS, "channel", "window", F.posexplode("p").alias("bin", "p")).withColumn("p", blank("p"))


def band_rows(spectra: DataFrame, freqs: Sequence[float], bands: Sequence[Band], kind: str) -> DataFrame:
    """Bins with band, f and weight w; the weights are broadcast, being one axis by the bands."""
    weights = weights_table(spectra.sparkSession, freqs, bands, kind)
    return bin_rows(spectra).join(F.broadcast(weights), "bin")


def normalised(rows: DataFrame, baseline: str | None, mode: str, value: str = "value", by: Sequence[str] = ("measure", "band")) -> DataFrame:
    """Values relative to the baseline window, which is consumed.

    Modes: raw, log10, log_ratio, db, percent. Values of a row and channel are
    floored at FLOOR of the greatest among all its windows, but not the numerator
    of percent; without positive power they are null.
    """
    if mode not in ("raw", "log10", "log_ratio", "db", "percent"):
        raise ValueError(f"unknown normalisation {mode!r}")
    if (baseline is None) != (mode in ("raw", "log10")):
        raise ValueError(f"{mode} {'needs' if baseline is None else 'takes no'} baseline window")
    if mode == "raw":
        return rows
    part = Window.partitionBy(*KEYS, "channel", *by)
    v = blank(value)
    peak = F.max(v).over(part)
    floor = F.when(peak > 0, peak * FLOOR)
    # greatest() skips nulls, which must stay.
    floored = F.when(v.isNotNull() & floor.isNotNull(), F.greatest(v, floor))
    if mode == "log10":
        return rows.withColumn(value, F.log10(floored))
    at_base = F.col("window") == baseline
    base = F.max(F.when(at_base, floored)).over(part)
    base_coverage = F.max(F.when(at_base, F.col("coverage"))).over(part)
    out = {
        "log_ratio": F.log10(divide(floored, base)),
        "db": 10 * F.log10(divide(floored, base)),
        "percent": 100 * divide(v - base, base),
    }[mode]
    rows = rows.withColumns({value: out, "coverage": F.least("coverage", base_coverage)})
    return rows.where(~at_base)


def _coverage() -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum(F.when(F.col("p").isNotNull(), F.col("w")).otherwise(0.0)) / F.sum("w")))


def band_measure(
    spectra: DataFrame, freqs: Sequence[float], measure: str, value: Column, kind: str, bands: Sequence[Band] = STANDARD_BANDS,
    groups: Mapping[str, Sequence[str]] | None = None, include_global: bool = True, baseline: str | None = None, normalize: str = "raw",
) -> DataFrame:
    """keys, window, band, measure, space, space_kind, value, coverage of an aggregate over p, f and w."""
    cells = band_rows(spectra, freqs, bands, kind).groupBy(*KEYS, "channel", "window", "band").agg(value.alias("value"), _coverage().alias("coverage"))
    cells = normalised(cells.withColumn("measure", F.lit(measure)), baseline, normalize)
    return aggregate_space(cells, [*KEYS, "window", "band", "measure"], groups, include_global)


def _columns() -> tuple[Column, Column, Column]:
    return F.col("p"), F.col("f"), F.col("w")


def mean_psd(spectra: DataFrame, freqs: Sequence[float], measure: str = "mean_psd", **kw) -> DataFrame:
    """Weighted mean over the band of the bins that are finite."""
    p, f, w = _columns()
    return band_measure(spectra, freqs, measure, divide(F.sum(w * p), F.sum(F.when(p.isNotNull(), w))), "band", **kw)


def mean_tfr_power(spectra: DataFrame, freqs: Sequence[float], **kw) -> DataFrame:
    return mean_psd(spectra, freqs, "mean_tfr_power", **kw)


def band_power(spectra: DataFrame, freqs: Sequence[float], **kw) -> DataFrame:
    """Integral over the band; null if any of its bins is missing or there is but one."""
    p, f, w = _columns()
    whole = (F.count(p) == F.count("*")) & (F.count("*") >= 2)
    return band_measure(spectra, freqs, "band_power", F.when(whole, F.sum(w * p)), "band", **kw)


def spectral_centroid(spectra: DataFrame, freqs: Sequence[float], **kw) -> DataFrame:
    p, f, w = _columns()
    return band_measure(spectra, freqs, "spectral_centroid", divide(F.sum(f * w * p), F.sum(F.when(p.isNotNull(), w) * p)), "gradient", **kw)


def spectral_bandwidth(spectra: DataFrame, freqs: Sequence[float], **kw) -> DataFrame:
    """Spread around the centroid; one pass, moments about the band's first bin."""
    p, f, w = _columns()
    rows_f = f - F.col("f0")
    m0, m1, m2 = F.sum(w * p), F.sum(rows_f * w * p), F.sum(rows_f * rows_f * w * p)
    value = F.sqrt(F.greatest(divide(m2, m0) - divide(m1, m0) * divide(m1, m0), F.lit(0.0)))
    bands = kw.pop("bands", STANDARD_BANDS)
    groups, include_global = kw.pop("groups", None), kw.pop("include_global", True)
    start = F.create_map(*(F.lit(x) for b in bands for x in (b.name, float((b.fmin + b.fmax) / 2))))
    rows = band_rows(spectra, freqs, bands, "gradient").withColumn("f0", F.element_at(start, F.col("band")))
    cells = rows.groupBy(*KEYS, "channel", "window", "band").agg(value.alias("value"), _coverage().alias("coverage"))
    return aggregate_space(cells.withColumn("measure", F.lit("spectral_bandwidth")), [*KEYS, "window", "band", "measure"], groups, include_global)


def spectral_entropy(spectra: DataFrame, freqs: Sequence[float], **kw) -> DataFrame:
    """Entropy of the bins' shares over that of as many equal ones; the grid must be uniform.

    From sums alone: with s the total, the entropy is ln s - sum(p ln p) / s.
    """
    p, f, w = _columns()
    step = np.diff(np.asarray(freqs, dtype=float))
    if len(step) and not np.allclose(step, step[0], rtol=1e-6):
        raise ValueError("spectral entropy needs a uniform frequency grid")
    s = F.sum(p)
    xlnx = F.sum(F.when(p > 0, p * F.ln(p)).otherwise(F.when(p.isNotNull(), 0.0)))
    value = F.when((s > 0) & (F.count(p) > 1), divide(F.ln(s) - divide(xlnx, s), F.ln(F.count(p).cast("double"))))
    return band_measure(spectra, freqs, "spectral_entropy", value, "uniform", **kw)


def spectral_edge(spectra: DataFrame, freqs: Sequence[float], percentile: float = 0.95, **kw) -> DataFrame:
    """First bin at which the cumulative share of power reaches the percentile."""
    p, f, w = _columns()
    if not 0 < percentile <= 1:
        raise ValueError("percentile must lie in (0, 1]")
    # The bins of a cell fit in one array: an axis is bounded and shared.
    rows = F.array_sort(F.collect_list(F.when(p.isNotNull(), F.struct(f.alias("f"), (w * p).alias("m")))))
    total = F.sum(w * p)
    found = F.aggregate(
        rows,
        F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("f")),
        lambda acc, x: F.struct((acc["sum"] + x["m"]).alias("sum"), F.coalesce(acc["f"], F.when(acc["sum"] + x["m"] >= percentile * total, x["f"])).alias("f")),
    )["f"]
    return band_measure(spectra, freqs, "spectral_edge", F.when(total > 0, found), "gradient", **kw)


def band_ratio(table: DataFrame, numerator: str, denominator: str, log_scale: bool = False) -> DataFrame:
    """Quotient of two bands' cells, or their difference on log scales; coverage is the lesser."""
    a, b = F.col("band") == numerator, F.col("band") == denominator
    va, vb = F.max(F.when(a, F.col("value"))), F.max(F.when(b, F.col("value")))
    both = table.where(a | b).groupBy(*KEYS, "window", "measure", "space", "space_kind").agg(
        (va - vb if log_scale else divide(va, vb)).alias("value"), F.min("coverage").alias("coverage"), F.count("*").alias("n")
    )
    return both.where("n = 2").drop("n").withColumn("measure", F.lit(f"ratio_{numerator}_{denominator}"))


def asymmetry(table: DataFrame, pairs: Sequence[tuple[str, str]], log_scale: bool = False) -> DataFrame:
    """(R - L) / (R + L) of each (left, right) channel pair, or R - L on log scales."""
    sides = F.array(*(F.struct(F.lit(f"{le}-{r}").alias("pair"), F.lit(le).alias("l"), F.lit(r).alias("r")) for le, r in pairs))
    rows = table.where(F.col("space_kind") == "channel").withColumn("_p", F.explode(sides)).where((F.col("space") == F.col("_p.l")) | (F.col("space") == F.col("_p.r")))
    left, right = F.max(F.when(F.col("space") == F.col("_p.l"), F.col("value"))), F.max(F.when(F.col("space") == F.col("_p.r"), F.col("value")))
    out = rows.groupBy(*KEYS, "window", "band", F.col("_p.pair").alias("space")).agg(
        (right - left if log_scale else divide(right - left, right + left)).alias("value"), F.min("coverage").alias("coverage"), F.count("*").alias("n")
    )
    return out.where("n = 2").drop("n").withColumns({"measure": F.lit("asymmetry"), "space_kind": F.lit("pair")})


def log_log_fit(freqs: np.ndarray, p: np.ndarray, z: float = 2.5, rounds: int = 3, least: int = 5) -> tuple[float, float, float]:
    """Slope, offset and r^2 of log10 p over log10 f, without positive outliers; NaN if it fails.

    In each round points whose residual exceeds z robust deviations (median
    absolute deviation over its normal scale) above the line are left out.
    """
    ok = np.isfinite(p) & (p > 0) & (freqs > 0)
    x, y = np.log10(freqs[ok]), np.log10(p[ok])
    keep = np.ones(len(x), dtype=bool)
    nan = float("nan")
    for k in range(rounds + 1):
        if keep.sum() < least:
            return nan, nan, nan
        cx, cy = x[keep] - x[keep].mean(), y[keep] - y[keep].mean()
        if not (cx @ cx) > 0:
            return nan, nan, nan
        slope = (cx @ cy) / (cx @ cx)
        offset = y[keep].mean() - slope * x[keep].mean()
        rest = y - (offset + slope * x)
        if k == rounds:
            break
        mad = np.median(np.abs(rest[keep] - np.median(rest[keep]))) / MAD_SCALE
        out = keep & (rest > z * mad) if mad > 0 else np.zeros_like(keep)
        if not out.any() or (keep & ~out).sum() < least:
            break
        keep &= ~out
    r = rest[keep]
    total = cy @ cy
    return float(slope), float(offset), float(1 - (r @ r) / total) if total > 0 else nan


def default_fit_range(band) -> tuple[float, float]:
    """Range of a background fit for a band: from 2 to 40 Hz, wider where the band is."""
    return min(2.0, float(band.fmin)), max(40.0, float(band.fmax))


def aperiodic_fits(spectra: DataFrame, freqs: Sequence[float], fit_range: tuple[float, float] = (2.0, 40.0), z: float = 2.5, rounds: int = 3) -> DataFrame:
    """spectra with slope, offset and r_squared; the fit is done on Arrow batches, row by row of a batch."""
    f = np.asarray(freqs, dtype=float)
    own = np.flatnonzero((f >= fit_range[0]) & (f <= fit_range[1]))

    @F.pandas_udf("slope double, offset double, r_squared double")
    def fit(p: pd.Series) -> pd.DataFrame:
        rows = [log_log_fit(f[own], np.asarray(v, dtype=float)[own], z, rounds) if v is not None else (np.nan,) * 3 for v in p]
        return pd.DataFrame(rows, columns=["slope", "offset", "r_squared"])

    out = spectra.withColumn("_fit", fit("p"))
    return out.withColumns({c: blank(f"_fit.{c}") for c in ("slope", "offset", "r_squared")}).drop("_fit")


def aperiodic(spectra: DataFrame, freqs: Sequence[float], groups=None, include_global: bool = True, **kw) -> DataFrame:
    """Slope, offset and r_squared as measures over channels, regions and all."""
    fits = aperiodic_fits(spectra, freqs, **kw)
    share = F.size(F.filter("p", lambda v: is_finite(v))) / F.size("p")
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("slope", "offset", "r_squared"))))
    long = fits.select(*KEYS, "channel", "window", share.alias("coverage"), cells.alias("c")).select(*KEYS, "channel", "window", "coverage", "c.*")
    return aggregate_space(long, [*KEYS, "window", "measure"], groups, include_global)


def ols_fit(spectra: DataFrame, freqs: Sequence[float], fit_range: tuple[float, float] = (2.0, 40.0)) -> DataFrame:
    """First round of the aperiodic fit by built-in regression aggregates: keys, channel, window, slope, offset, r_squared."""
    f = F.array(*(F.lit(float(v)) for v in freqs))
    rows = bin_rows(spectra).withColumn("f", F.get(f, F.col("bin"))).where((F.col("f") >= fit_range[0]) & (F.col("f") <= fit_range[1]) & (F.col("p") > 0))
    x, y = F.log10("f"), F.log10("p")
    fit = rows.groupBy(*KEYS, "channel", "window").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("offset"), F.regr_r2(y, x).alias("r_squared"), F.count("*").alias("n"))
    return fit.where("n >= 5").drop("n")


def aperiodic_ratio(spectra: DataFrame, freqs: Sequence[float], **kw) -> DataFrame:
    """spectra whose p is divided by its aperiodic fit, with the flag aperiodic_fit_failed."""
    fits = aperiodic_fits(spectra, freqs, **kw)
    f = F.array(*(F.lit(float(v)) for v in freqs))
    ratio = F.transform("p", lambda v, i: F.when(F.get(f, i) > 0, v / F.pow(F.lit(10.0), F.col("offset") + F.col("slope") * F.log10(F.get(f, i)))))
    ok = F.col("slope").isNotNull()
    nulls = F.transform("p", lambda v: F.lit(None).cast("double"))
    return fits.withColumns({"p": F.when(ok, ratio).otherwise(nulls), "aperiodic_fit_failed": ~ok}).drop("slope", "offset", "r_squared")


def periodic_power(spectra: DataFrame, freqs: Sequence[float], fit_range: tuple[float, float] = (2.0, 40.0), **kw) -> DataFrame:
    """Mean over the band of the spectrum divided by its aperiodic fit."""
    return mean_psd(aperiodic_ratio(spectra, freqs, fit_range=fit_range), freqs, "periodic_power", **kw)


def find_peak(freqs: np.ndarray, p: np.ndarray, smoothing_hz: float, min_prominence: float, interpolate: bool) -> tuple[float, bool, bool]:
    """Frequency of the strongest prominent peak, and the flags edge_hit and no_peak."""
    if len(p) < 3 or not np.isfinite(p).all() or (p <= 0).any():
        return float("nan"), False, True
    step = np.median(np.diff(freqs))
    half = int(round(smoothing_hz / 2 / step))
    smooth = np.convolve(np.pad(p, half, mode="edge"), np.ones(2 * half + 1) / (2 * half + 1), mode="valid") if half else p
    y = np.log10(smooth)
    best, height = -1, -math.inf
    for k in range(1, len(y) - 1):
        if not (y[k] > y[k - 1] and y[k] >= y[k + 1]):
            continue
        left, right = y[:k][::-1], y[k + 1 :]
        over_l, over_r = np.flatnonzero(left > y[k]), np.flatnonzero(right > y[k])
        low_l = left[: over_l[0]].min(initial=y[k]) if len(over_l) else left.min(initial=y[k])
        low_r = right[: over_r[0]].min(initial=y[k]) if len(over_r) else right.min(initial=y[k])
        if y[k] - max(low_l, low_r) >= min_prominence and y[k] > height:
            best, height = k, y[k]
    edge = int(np.argmax(y)) in (0, len(y) - 1)
    if best < 0:
        return float("nan"), edge, True
    f = freqs[best]
    if interpolate:
        x0, x1, x2 = freqs[best - 1 : best + 2]
        y0, y1, y2 = smooth[best - 1 : best + 2]
        bottom = (x1 - x0) * (y1 - y2) - (x1 - x2) * (y1 - y0)
        if bottom != 0:
            top = (x1 - x0) ** 2 * (y1 - y2) - (x1 - x2) ** 2 * (y1 - y0)
            f = x1 - 0.5 * top / bottom
            f = min(max(f, x1 - (x1 - x0) / 2), x1 + (x2 - x1) / 2)
    return float(f), edge, False


def peak_frequency(
    spectra: DataFrame, freqs: Sequence[float], band: Band, adjusted: bool = True, smoothing_hz: float = 1.0, min_prominence: float = 0.1,
    interpolate: bool = True, groups=None, include_global: bool = True,
) -> DataFrame:
    """Frequency of the band's strongest peak, of the fit-adjusted spectrum by default, with edge_hit and no_peak."""
    source = aperiodic_ratio(spectra, freqs, fit_range=(min(2.0, band.fmin), max(40.0, band.fmax))) if adjusted else spectra
    f = np.asarray(freqs, dtype=float)
    own = np.flatnonzero((f >= band.fmin) & (f < band.fmax))

    @F.pandas_udf("f double, edge_hit boolean, no_peak boolean")
    def peak(p: pd.Series) -> pd.DataFrame:
        rows = [find_peak(f[own], np.asarray(v, dtype=float)[own], smoothing_hz, min_prominence, interpolate) for v in p]
        return pd.DataFrame(rows, columns=["f", "edge_hit", "no_peak"])

    rows = source.withColumn("_k", peak("p"))
    share = F.size(F.filter("p", lambda v: is_finite(v))) / F.size("p")
    rows = rows.select(*KEYS, "channel", "window", share.alias("coverage"), blank("_k.f").alias("value"), "_k.edge_hit", "_k.no_peak")
    rows = rows.withColumns({"measure": F.lit("peak_freq_adjusted" if adjusted else "peak_freq"), "band": F.lit(band.name)})
    return aggregate_space(rows, [*KEYS, "window", "band", "measure"], groups, include_global, flags=("edge_hit", "no_peak"))
