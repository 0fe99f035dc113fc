"""Spectral estimation of traces by Arrow-batched kernels; one row in, one row out, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions import kernels
from traceloom.functions.dims import Band, Window

KEYS = ("recording", "epoch", "event")


def _rows(w: pd.Series) -> dict[int, np.ndarray]:
    """Places of rows by their length, so that rows of one length are one matrix."""
    sizes = w.map(len).to_numpy()
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def _matrix(w: pd.Series, at: np.ndarray) -> np.ndarray:
    return np.stack([np.asarray(w.iloc[k], dtype=float) for k in at])


def _windowed(traces: DataFrame, windows: Sequence[Window]) -> DataFrame:
    parts = []
    for w in windows:
        lo, n = w.bounds(F.col("t0"), F.col("sfreq"), F.size("x"))
        parts.append(F.struct(F.lit(w.name).alias("window"), F.slice("x", lo + 1, n).alias("w")))
    return traces.select(*KEYS, "channel", "sfreq", F.explode(F.array(*parts)).alias("_p")).select(*KEYS, "channel", "sfreq", "_p.*")


def axis(n: int, sfreq: float, fmin: float, fmax: float) -> tuple[np.ndarray, np.ndarray]:
    """Fourier bins of n samples that span fmin to fmax, and their places: up to one bin beyond either end."""
    f, step = np.fft.rfftfreq(n, 1 / sfreq), sfreq / n
    at = np.flatnonzero((f > fmin - step + 1e-9) & (f < fmax + step - 1e-9))
    return f[at], at


def _density(traces: DataFrame, windows: Sequence[Window], of, places: np.ndarray) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(w: pd.Series) -> pd.Series:
        out = np.empty(len(w), dtype=object)
        for _, at in _rows(w).items():
            p = of(_matrix(w, at))[:, places]
            for k, row in zip(at, p):
                out[k] = row
        return pd.Series(out)

    return _windowed(traces, windows).select(*KEYS, "channel", "window", run("w").alias("p"))


def welch(traces: DataFrame, windows: Sequence[Window], sfreq: float, n_fft: int, fmin: float = 1.0, fmax: float = 45.0, overlap: int | None = None, statistic: str = "mean") -> tuple[DataFrame, list[float]]:
    """Spectra rows (keys, channel, window, p) and their axis; only bins from fmin to fmax leave the kernel."""
    freqs, places = axis(n_fft, sfreq, fmin, fmax)
    return _density(traces, windows, lambda x: kernels.welch(x, sfreq, n_fft, overlap, statistic)[1], places), freqs.tolist()


def multitaper(traces: DataFrame, windows: Sequence[Window], sfreq: float, n: int, bandwidth: float = 2.0, fmin: float = 1.0, fmax: float = 45.0) -> tuple[DataFrame, list[float]]:
    """As welch, by Slepian tapers; all windows must hold n samples."""
    freqs, places = axis(n, sfreq, fmin, fmax)
    return _density(traces, windows, lambda x: kernels.multitaper(x, sfreq, bandwidth)[1], places), freqs.tolist()


def morlet(traces: DataFrame, windows: Sequence[Window], sfreq: float, freqs: Sequence[float], cycles: Sequence[float], statistic: str = "mean") -> DataFrame:
    """Window means or medians of Morlet power, by coefficients whose support lies in the window.

    Row: keys, channel, window, p, and support, the share of the window that such
    coefficients cover; p is null where there is none. The median is divided by
    ln 2, power by the sampling rate.
    """
    f, c = np.asarray(freqs, dtype=float), np.asarray(cycles, dtype=float)
    names = [w.name for w in windows]
    bounds = [(w.tmin, w.tmax) for w in windows]

    @F.pandas_udf("array<struct<window:string,p:array<double>,support:array<double>>>")
    def run(x: pd.Series, t0: pd.Series) -> pd.Series:
        out = []
        for v, start in zip(x, t0):
            v = np.asarray(v, dtype=float)
            power = np.abs(kernels.morlet(v[None], sfreq, f, c)[0]) ** 2 / sfreq
            t = start + np.arange(len(v)) / sfreq
            reach = 5 * c / (2 * np.pi * f)
            cells = []
            for name, (lo, hi) in zip(names, bounds):
                inside = (t >= lo) & (t <= hi)
                p, s = [], []
                for k in range(len(f)):
                    own = (t >= max(lo, t[0]) + reach[k] - 1e-9) & (t <= min(hi, t[-1]) - reach[k] + 1e-9)
                    s.append(float(own.sum() / max(inside.sum(), 1)))
                    values = power[k, own]
                    p.append(None if not own.any() or not np.isfinite(values).all() else float(values.mean() if statistic == "mean" else np.median(values) / np.log(2)))
                cells.append({"window": name, "p": p, "support": s})
            out.append(cells)
        return pd.Series(out)

    return traces.select(*KEYS, "channel", F.explode(run("x", "t0")).alias("c")).select(*KEYS, "channel", "c.*")


def reduce_tfr(tfr: DataFrame, windows: Sequence[Window], freqs: Sequence[float], cycles: Sequence[float], statistic: str = "mean") -> DataFrame:
    """Window means or medians of time-frequency power, by coefficients whose support lies in the window.

    tfr: keys, channel, bin, t0, sfreq and p (array over time). Row: keys, channel,
    window, bin, p, support; built-in array functions within the row. The mean is
    divided by the sampling rate, the median by ln 2 besides.
    """
    reach = F.get(F.array(*(F.lit(5 * float(c) / (2 * np.pi * float(f))) for f, c in zip(freqs, cycles))), F.col("bin"))
    n, last = F.size("p"), F.col("t0") + (F.size("p") - 1) / F.col("sfreq")
    parts = []
    for w in windows:
        first, size = w.bounds(F.col("t0"), F.col("sfreq"), n)
        low = F.greatest(F.lit(w.tmin), F.col("t0")) + reach if np.isfinite(w.tmin) else F.col("t0") + reach
        high = F.least(F.lit(w.tmax), last) - reach if np.isfinite(w.tmax) else last - reach
        lo = F.greatest(F.lit(0), F.ceil((low - F.col("t0")) * F.col("sfreq") - 1e-9)).cast("int")
        hi = F.least(n - 1, F.floor((high - F.col("t0")) * F.col("sfreq") + 1e-9)).cast("int")
        own = F.slice("p", lo + 1, F.greatest(hi - lo + 1, F.lit(0)))
        parts.append(F.struct(F.lit(w.name).alias("window"), own.alias("own"), size.alias("size")))
    rows = tfr.select(*KEYS, "channel", "bin", "sfreq", F.explode(F.array(*parts)).alias("_w")).select(*KEYS, "channel", "bin", "sfreq", "_w.*")
    whole = (F.size("own") > 0) & F.forall("own", lambda v: v.isNotNull() & ~F.isnan(v))
    sums = F.aggregate("own", F.lit(0.0), lambda s, v: s + v) / F.size("own")
    ordered = F.array_sort("own")
    middle = (F.get(ordered, F.floor((F.size("own") - 1) / 2).cast("int")) + F.get(ordered, F.floor(F.size("own") / 2).cast("int"))) / 2
    value = sums if statistic == "mean" else middle / float(np.log(2))
    return rows.select(*KEYS, "channel", "window", "bin", F.when(whole, value / F.col("sfreq")).alias("p"), (F.size("own") / F.greatest("size", F.lit(1))).alias("support"))


def band_signal(traces: DataFrame, band: Band, sfreq: float, pad_seconds: float = 0.5, pad_cycles: float = 3.0) -> DataFrame:
    """Analytic band signals: keys, run if there, channel, band, sfreq, re, im; a trace with a bad sample is all null."""

    @F.pandas_udf("struct<re:array<double>,im:array<double>>")
    def run(x: pd.Series) -> pd.DataFrame:
        re, im = np.empty(len(x), dtype=object), np.empty(len(x), dtype=object)
        for _, at in _rows(x).items():
            z = kernels.band_analytic(_matrix(x, at), sfreq, band.fmin, band.fmax, pad_seconds, pad_cycles)
            for k, row in zip(at, z):
                re[k], im[k] = row.real.copy(), row.imag.copy()
        return pd.DataFrame({"re": re, "im": im})

    extra = ["run"] if "run" in traces.columns else []
    return traces.select(*KEYS, *extra, "channel", F.lit(band.name).alias("band"), "sfreq", run("x").alias("z")).select(*KEYS, *extra, "channel", "band", "sfreq", "z.*")


def cross_inputs(traces: DataFrame, sfreq: float, n: int, bandwidth: float = 2.0) -> tuple[DataFrame, list[float]]:
    """Complex spectra of each taper as rows for spectral_connectivity, with the key taper."""

    @F.pandas_udf("array<struct<taper:int,re:array<double>,im:array<double>>>")
    def run(x: pd.Series) -> pd.Series:
        out = []
        for v in x:
            z = kernels.tapered_spectra(np.asarray(v, dtype=float), sfreq, bandwidth)[0]
            out.append([{"taper": k, "re": row.real.tolist(), "im": row.imag.tolist()} for k, row in enumerate(z)])
        return pd.Series(out)

    rows = traces.select(*KEYS, F.col("channel").alias("node"), "sfreq", F.explode(run("x")).alias("z")).select(*KEYS, "node", "sfreq", "z.*")
    return rows, np.fft.rfftfreq(n, 1 / sfreq).tolist()


def irasa(traces: DataFrame, sfreq: float, n_fft: int, factors: Sequence[float] = (1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9), fmin: float = 1.0, fmax: float = 30.0) -> tuple[DataFrame, list[float]]:
    """Aperiodic and periodic parts of each trace by irregular resampling (Wen and Liu, 2016).

    The aperiodic part is the median, over factors, of the geometric mean of the
    densities of the trace stretched and squeezed by the factor.
    """
    freqs, places = axis(n_fft, sfreq, fmin, fmax)

    @F.pandas_udf("struct<aperiodic:array<double>,periodic:array<double>>")
    def run(x: pd.Series) -> pd.DataFrame:
        rows = []
        for v in x:
            v = np.asarray(v, dtype=float)
            if not np.isfinite(v).all() or np.ptp(v) == 0:
                rows.append({"aperiodic": None, "periodic": None})
                continue
            whole = kernels.welch(v, sfreq, n_fft)[1][0][places]
            means = []
            for h in factors:
                up = np.interp(np.arange(0, len(v) - 1, 1 / h), np.arange(len(v)), v)
                down = np.interp(np.arange(0, len(v) - 1, h), np.arange(len(v)), v)
                a, pa = kernels.welch(up, sfreq * h, min(n_fft, len(up)))
                b, pb = kernels.welch(down, sfreq / h, min(n_fft, len(down)))
                means.append(np.sqrt(np.interp(freqs, a / h, pa[0] * h) * np.interp(freqs, b * h, pb[0] / h)))
            part = np.median(means, axis=0)
            rows.append({"aperiodic": part, "periodic": whole - part})
        return pd.DataFrame(rows)

    return traces.select(*KEYS, "channel", run("x").alias("z")).select(*KEYS, "channel", "z.*"), freqs.tolist()
