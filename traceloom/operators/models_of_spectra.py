"""Peak-and-background models of spectra, cycles of traces, time-resolved connectivity, and users' kernels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import kernels
from traceloom.functions.dims import Band, Window, band_weights, gradient_weights
from traceloom.functions.numeric import blank, is_finite
from traceloom.operators.connectivity import METHODS
from traceloom.operators.spatial import aggregate_space
from traceloom.operators.spectral import normalised
from traceloom.operators.temporal import long_measures

KEYS = ("recording", "epoch", "event")


# Spectral parameterisation ------------------------------------------------------------


def fit_background(f: np.ndarray, y: np.ndarray, knee: bool) -> np.ndarray:
    """offset, exponent[, knee] of y = offset - log10(knee + f^exponent), knee 0 if not asked for."""
    if not knee:
        x = np.log10(f)
        x0, y0 = x - x.mean(), y - y.mean()
        slope = (x0 @ y0) / (x0 @ x0)
        return np.array([y.mean() - slope * x.mean(), -slope])
    start = fit_background(f, y, False)
    p = np.array([start[0], max(start[1], 0.1), 1.0])
    damp = 1e-2
    value = lambda q: q[0] - np.log10(np.maximum(abs(q[2]) + f ** q[1], 1e-300))
    error = ((y - value(p)) ** 2).sum()
    for _ in range(100):
        base = value(p)
        jac = np.stack([(value(p + d) - base) / 1e-5 for d in np.eye(3) * 1e-5], axis=1)
        a = jac.T @ jac
        step = np.linalg.solve(a + damp * np.diag(a.diagonal() + 1e-9), jac.T @ (y - base))
        new = ((y - value(p + step)) ** 2).sum()
        if new < error:
            p, damp, gain, error = p + step, damp / 3, error - new, new
            if gain < 1e-12:
                break
        else:
            damp *= 4
            if damp > 1e8:
                break
    return np.array([p[0], p[1], abs(p[2])])


def background(f: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p[0] - np.log10((p[2] if len(p) > 2 else 0.0) + f ** p[1])


def backgrounds(x: np.ndarray, y: np.ndarray, own: np.ndarray, knee: bool) -> np.ndarray:
    """fit_background of each row of y over its own bins (a mask): rows x parameters; x is log10 f."""
    if knee:
        return np.array([fit_background(10 ** x[o], v[o], True) for v, o in zip(y, own)]).reshape(len(y), 3)
    n = own.sum(axis=1)
    mx, my = np.where(own, x, 0.0).sum(axis=1) / n, np.where(own, y, 0.0).sum(axis=1) / n
    x0 = np.where(own, x - mx[:, None], 0.0)
    slope = (x0 * (y - my[:, None])).sum(axis=1) / (x0 * x0).sum(axis=1)
    return np.stack([my - slope * mx, -slope], axis=1)


def _curves(f: np.ndarray, p: np.ndarray) -> np.ndarray:
    """background of each row of p."""
    return p[:, :1] - np.log10((p[:, 2:3] if p.shape[1] > 2 else 0.0) + f ** p[:, 1:2])


def parameterise(f: np.ndarray, p: np.ndarray, knee: bool = False, **kw) -> dict:
    """parameterise_rows of one spectrum, its peaks as (centre, height, width)."""
    m = parameterise_rows(f, np.asarray(p, dtype=float)[None], knee, **kw)
    return {k: float(v[0]) for k, v in m.items() if k != "peaks"} | {"peaks": [tuple(map(float, q)) for q in m["peaks"][0] if np.isfinite(q[0])]}


#: Spectra that are fitted together: their Jacobians take a few megabytes.
ROWS = 512
#: Over which the peaks' parameters are differenced: a result that stops short of its minimum depends on it.
STEP = 1e-5


def parameterise_rows(
    f: np.ndarray, p: np.ndarray, knee: bool = False, widths: tuple[float, float] = (0.5, 12.0), most: int = 6, least_height: float = 0.0, threshold: float = 2.0
) -> dict:
    """Background and Gaussian peaks of log10 power of each row of p (after Donoghue et al., 2020).

    A robust background is fitted to the points under the 2.5th percentile of the
    first flattened spectrum; peaks over the threshold's deviations are taken off
    one by one, refined together, and the background is refitted without them.
    Every step is one array operation over the rows that still take it. A value
    for each row; peaks: rows x most x (centre, height, width), NaN where there is none.
    """
    out = {k: np.full(len(p), np.nan) for k in ("offset", "exponent", "knee", "r_squared", "error")} | {"peaks": np.full((len(p), most, 3), np.nan)}
    if len(f) < 8 or not (f > 0).all():
        return out
    fine = np.flatnonzero((np.isfinite(p) & (p > 0)).all(axis=1))
    for start in range(0, len(fine), ROWS):
        at = fine[start : start + ROWS]
        for k, v in _parameterise(f, np.log10(p[at]), knee, widths, most, least_height, threshold).items():
            out[k][at] = v
    return out


def _parameterise(f: np.ndarray, y: np.ndarray, knee: bool, widths: tuple[float, float], most: int, least_height: float, threshold: float) -> dict:
    x, n = np.log10(f), len(y)
    whole = np.ones(y.shape, dtype=bool)
    robust = backgrounds(x, y, whole, knee)
    flat = np.maximum(y - _curves(f, robust), 0)
    low = flat <= np.percentile(flat, 2.5, axis=1, keepdims=True)
    some = np.flatnonzero(low.sum(axis=1) > 4)
    if len(some):
        robust[some] = backgrounds(x, y[some], low[some], knee)
    rest = y - _curves(f, robust)
    guesses, work, live = np.full((n, most, 3), np.nan), rest.copy(), np.arange(n)
    for turn in range(most):
        top = work[live].max(axis=1)
        live = live[(top > threshold * work[live].std(axis=1)) & (top > least_height)]
        if not len(live):
            break
        w = work[live]
        k, top = w.argmax(axis=1), w.max(axis=1)
        # Distances to the nearest bins at half the height on either side.
        away = np.where(w <= top[:, None] / 2, np.abs(f - f[k][:, None]), np.inf)
        reach = away.min(axis=1)
        sd = np.clip(2 * np.where(np.isfinite(reach), reach, 1.0) / 2.3548, widths[0] / 2, widths[1] / 2)
        guesses[live, turn] = np.stack([f[k], top, sd], axis=1)
        work[live] = w - top[:, None] * np.exp(-((f - f[k][:, None]) ** 2) / (2 * sd[:, None] ** 2))
    inside = (f[0] + guesses[..., 2] / 2 <= guesses[..., 0]) & (guesses[..., 0] <= f[-1] - guesses[..., 2] / 2)
    count, bumps, peaks = inside.sum(axis=1), np.zeros(y.shape), np.full((n, most, 3), np.nan)
    for c in range(1, most + 1):
        own = np.flatnonzero(count == c)
        if len(own):
            peaks[own, :c] = made = _refine(f, rest[own], guesses[own][inside[own]].reshape(len(own), c, 3), widths)
            bumps[own] = _bumps(f, made)[0]
    last = backgrounds(x, y - bumps, whole, knee)
    gone = y - _curves(f, last) - bumps
    total = ((y - y.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    peaks[~(peaks[..., 1] > 0)] = np.nan
    peaks[..., 2] *= 2
    return {
        "offset": last[:, 0], "exponent": last[:, 1], "knee": last[:, 2] if knee else np.nan, "error": np.abs(gone).mean(axis=1), "peaks": peaks,
        "r_squared": np.where(total > 0, 1 - (gone**2).sum(axis=1) / np.where(total > 0, total, 1.0), np.nan),
    }


def _bumps(f: np.ndarray, peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of rows' Gaussians, each one's shape at height 1, and the distance from its centre."""
    away = f - peaks[..., :1]
    shape = np.exp(-(away**2) / (2 * peaks[..., 2:] ** 2))
    return (peaks[..., 1:2] * shape).sum(axis=1), shape, away


def _refine(f: np.ndarray, y: np.ndarray, peaks: np.ndarray, widths: tuple[float, float]) -> np.ndarray:
    """Least squares of all peaks' centres, heights and widths of each row together, within bounds: rows x peaks x 3."""
    n, c = peaks.shape[:2]
    reach = 2 * peaks[..., 2]
    low = np.stack([peaks[..., 0] - reach, np.zeros((n, c)), np.full((n, c), widths[0] / 2)], axis=2)
    high = np.stack([peaks[..., 0] + reach, np.full((n, c), np.inf), np.full((n, c), widths[1] / 2)], axis=2)
    q, damp, live, best = peaks.copy(), np.full(n, 1e-2), np.arange(n), peaks.copy()
    base, shape, away = _bumps(f, q)
    error = ((y - base) ** 2).sum(axis=1)
    for _ in range(60):
        # Forward differences over STEP, by the first two terms of their series.
        s = q[..., 2:]
        slope, u, t = q[..., 1:2] * shape / s, away / s, STEP / 2 / s
        uu = u * u
        jac = np.stack([slope * (u + t * (uu - 1)), shape, slope * uu * (1 + t * (uu - 3))], axis=2).reshape(len(q), 3 * c, len(f))
        a = jac @ jac.transpose(0, 2, 1)
        d = np.arange(3 * c)
        a[:, d, d] += damp[:, None] * (a[:, d, d] + 1e-9)
        step = np.linalg.solve(a, jac @ (y - base)[..., None])[..., 0]
        new_q = np.clip(q + step.reshape(q.shape), low, high)
        new_base, new_shape, new_away = _bumps(f, new_q)
        new = ((y - new_base) ** 2).sum(axis=1)
        better = new < error
        done = np.where(better, error - new < 1e-12, damp * 4 > 1e8)
        damp = np.where(better, damp / 3, damp * 4)
        q[better], error[better], base[better], shape[better], away[better] = new_q[better], new[better], new_base[better], new_shape[better], new_away[better]
        if done.any():
            best[live[done]] = q[done]
            keep = ~done
            live, q, damp, error, base, shape, away, y, low, high = (v[keep] for v in (live, q, damp, error, base, shape, away, y, low, high))
            if not len(live):
                break
    best[live] = q
    return best


PARAMETERS = ("specparam_offset", "specparam_exponent", "specparam_knee", "specparam_n_peaks", "specparam_r_squared", "specparam_error")


def spectral_parameterization(
    spectra: DataFrame, freqs: Sequence[float], bands: Sequence[Band] = (), fit_range: tuple[float, float] = (2.0, 40.0), mode: str = "fixed", groups=None, include_global: bool = True, **kw
) -> DataFrame:
    """Background parameters, fit quality and, for each band, its highest peak's frequency, height and width."""
    if mode not in ("fixed", "knee"):
        raise ValueError(f"unknown mode {mode!r}")
    f = np.asarray(freqs, dtype=float)
    own = np.flatnonzero((f >= fit_range[0]) & (f <= fit_range[1]))
    names = [*PARAMETERS, *(f"specparam_{b.name}_{m}" for b in bands for m in ("frequency", "power", "bandwidth"))]
    limits = [(b.fmin, b.fmax) for b in bands]

    @F.pandas_udf(", ".join(f"{n} double" for n in names) + ", no_peak boolean")
    def run(p: pd.Series) -> pd.DataFrame:
        x = np.full((len(p), len(f)), np.nan)
        for row, v in zip(x, p):
            if v is not None:
                row[: len(v)] = v[: len(f)]
        m = parameterise_rows(f[own], x[:, own], mode == "knee", **kw)
        centre, height = m["peaks"][..., 0], m["peaks"][..., 1]
        n_peaks = np.where(np.isfinite(m["offset"]), np.isfinite(centre).sum(axis=1), np.nan)
        out, lacking = [m["offset"], m["exponent"], m["knee"], n_peaks, m["r_squared"], m["error"]], np.zeros(len(p), dtype=bool)
        for lo, hi in limits:
            inside = (centre >= lo) & (centre < hi)
            top = m["peaks"][np.arange(len(p)), np.where(inside, height, -np.inf).argmax(axis=1)]
            out += list(np.where(inside.any(axis=1), top.T, np.nan))
            lacking |= ~inside.any(axis=1)
        return pd.DataFrame(dict(zip(names, out)) | {"no_peak": lacking})

    share = F.size(F.filter("p", lambda v: is_finite(v))) / F.size("p")
    rows = spectra.withColumn("_m", run("p")).select(*KEYS, "channel", "window", share.alias("coverage"), "_m.*")
    long = long_measures(rows, names, [*KEYS, "channel", "window", "coverage", "no_peak"]).withColumn("value", blank("value"))
    return aggregate_space(long, [*KEYS, "window", "measure"], groups, include_global, flags=("no_peak",))


# Users' kernels over spectra --------------------------------------------------------------


def spectral_measure(
    spectra: DataFrame, freqs: Sequence[float], kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], measure: str, bands: Sequence[Band],
    groups=None, include_global: bool = True, baseline: str | None = None, normalize: str = "raw", weighting: str = "band",
) -> DataFrame:
    """A user's kernel (power: rows x bins, freqs, weights) -> values, over bands, windows and spatial units."""
    f = np.asarray(freqs, dtype=float)
    picks = []
    for b in bands:
        w = band_weights(f, b.fmin, b.fmax) if weighting == "band" else np.where((f >= b.fmin) & (f < b.fmax), gradient_weights(f), 0.0)
        picks.append((b.name, np.flatnonzero(w > 0), w[w > 0]))

    @F.pandas_udf("array<double>")
    def run(p: pd.Series) -> pd.Series:
        x = np.array([[np.nan if q is None else q for q in v] for v in p], dtype=float)
        out = np.stack([np.asarray(kernel(x[:, at], f[at], w), dtype=float) for _, at, w in picks], axis=1)
        return pd.Series(list(out))

    share = F.size(F.filter("p", lambda v: is_finite(v))) / F.size("p")
    rows = spectra.select(*KEYS, "channel", "window", share.alias("coverage"), F.posexplode(run("p")).alias("k", "value"))
    band = F.get(F.array(*(F.lit(b) for b, _, _ in picks)), F.col("k"))
    cells = rows.withColumns({"band": band, "measure": F.lit(measure), "value": blank("value")}).drop("k")
    return aggregate_space(normalised(cells, baseline, normalize), [*KEYS, "window", "band", "measure"], groups, include_global)


# Cycles --------------------------------------------------------------------------------------


def find_cycles(x: np.ndarray, sfreq: float, band: tuple[float, float], thresholds: dict | None = None) -> list[dict]:
    """Trough-to-trough cycles of a trace (after Cole and Voytek, 2019).

    Zero crossings of the narrow-band trace part rises from decays; extrema are
    those of the trace itself between crossings. A cycle bursts if amplitude,
    period and monotonicity agree with its neighbours'.
    """
    t = {"amp_fraction": 0.0, "amp_consistency": 0.5, "period_consistency": 0.5, "monotonicity": 0.8, "min_cycles": 3} | (thresholds or {})
    narrow = kernels.band_analytic(x, sfreq, *band)[0].real
    if not np.isfinite(narrow).all():
        return []
    up = np.flatnonzero((narrow[:-1] < 0) & (narrow[1:] >= 0)) + 1
    down = np.flatnonzero((narrow[:-1] >= 0) & (narrow[1:] < 0)) + 1
    peaks, troughs = [], []
    for u in up:
        after = down[down > u]
        if len(after):
            peaks.append(u + int(np.argmax(x[u : after[0]])))
    for d in down:
        after = up[up > d]
        if len(after):
            troughs.append(d + int(np.argmin(x[d : after[0]])))
    cycles = []
    for a, b in zip(troughs, troughs[1:]):
        inside = [p for p in peaks if a < p < b]
        if not inside:
            continue
        p = inside[0]
        rise, decay = np.diff(x[a : p + 1]), np.diff(x[p : b + 1])
        cycles.append({
            "start": a, "peak": p, "stop": b, "period": (b - a) / sfreq, "rise": (p - a) / sfreq, "decay": (b - p) / sfreq, "amplitude": (x[p] - x[a] + x[p] - x[b]) / 2,
            "rise_decay_symmetry": (p - a) / (b - a), "monotonic": ((rise > 0).mean() + (decay < 0).mean()) / 2,
        })
    for k, (c, left, right) in enumerate(zip(cycles, [None, *cycles], [*cycles[1:], None])):
        near = [n for n in (left, right) if n is not None]
        ratio = lambda key: min([min(c[key], n[key]) / max(c[key], n[key]) if max(c[key], n[key]) > 0 else 0.0 for n in near], default=0.0)
        ranked = np.searchsorted(np.sort([q["amplitude"] for q in cycles]), c["amplitude"]) / len(cycles)
        c["burst"] = bool(ranked >= t["amp_fraction"] and ratio("amplitude") >= t["amp_consistency"] and ratio("period") >= t["period_consistency"] and c["monotonic"] >= t["monotonicity"] and 0 < k < len(cycles) - 1)
    start = 0
    while start < len(cycles):
        stop = start
        while stop < len(cycles) and cycles[stop]["burst"]:
            stop += 1
        if stop - start < t["min_cycles"]:
            for c in cycles[start:stop]:
                c["burst"] = False
        start = max(stop, start + 1)
    return cycles


def _between(start: Column, stop: Column) -> Callable[[Column], Column]:
    return lambda c: (c["start"] >= start) & (c["stop"] < stop)


CYCLES = ("period", "rise", "decay", "rise_decay_symmetry", "amplitude", "burst_fraction", "n_cycles", "n_burst_cycles")


def cycle_features(traces: DataFrame, windows: Sequence[Window], bands: Sequence[Band], sfreq: float, thresholds: dict | None = None, groups=None, include_global: bool = True) -> DataFrame:
    """Means over bursting cycles whose both troughs lie in the window, and their counts, with flags.

    Cycles are found once a row on the whole trace; the summaries are built-in
    array functions over them.
    """
    limits = [(b.name, b.fmin, b.fmax) for b in bands]
    fields = "start:int,stop:int,period:double,rise:double,decay:double,rise_decay_symmetry:double,amplitude:double,burst:boolean"

    @F.pandas_udf(f"array<struct<band:string,cycles:array<struct<{fields}>>>>")
    def run(x: pd.Series) -> pd.Series:
        names = [n.split(":")[0] for n in fields.split(",")]
        return pd.Series([[{"band": n, "cycles": [{k: c[k] for k in names} for c in find_cycles(np.asarray(v, dtype=float), sfreq, (lo, hi), thresholds)]} for n, lo, hi in limits] for v in x])

    rows = traces.select(*KEYS, "channel", "t0", "sfreq", F.size(F.filter("x", lambda v: is_finite(v))).alias("fine"), F.size("x").alias("n"), F.explode(run("x")).alias("b")).select("*", "b.*").drop("b")
    parts = []
    for w in windows:
        lo, n = w.bounds(F.col("t0"), F.col("sfreq"), F.col("n"))
        inside = _between(lo, lo + n)
        parts.append(F.struct(F.lit(w.name).alias("window"), F.filter("cycles", inside).alias("own")))
    rows = rows.select("*", F.explode(F.array(*parts)).alias("p")).select("*", "p.*").drop("p", "cycles")
    rows = rows.withColumn("hot", F.filter("own", lambda c: c["burst"]))
    mean = lambda key: F.when(F.size("hot") > 0, F.aggregate(F.transform("hot", lambda c: c[key]), F.lit(0.0), lambda s, v: s + v) / F.size("hot"))
    wide = rows.select(
        *KEYS, "channel", "window", "band", (F.col("fine") / F.col("n")).alias("coverage"), *(mean(k).alias(k) for k in CYCLES[:5]),
        F.try_divide(F.size("hot").cast("double"), F.size("own").cast("double")).alias("burst_fraction"), F.size("own").alias("n_cycles"), F.size("hot").alias("n_burst_cycles"),
        (F.size("own") == 0).alias("cycle_no_complete_cycles"), (F.size("hot") == 0).alias("cycle_no_burst"),
    )
    flags = ("cycle_no_complete_cycles", "cycle_no_burst")
    long = long_measures(wide, CYCLES, [*KEYS, "channel", "window", "band", "coverage", *flags])
    return aggregate_space(long, [*KEYS, "window", "band", "measure"], groups, include_global, flags=flags)


# Time-resolved connectivity ---------------------------------------------------------------


def connectivity_over_time(
    traces: DataFrame, methods: Sequence[str], bands: Sequence[Band], window: Window, freqs: Sequence[float], sfreq: float, cycles: float = 7.0, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Connectivity of channel pairs of each epoch, averages running over time: keys, a, b, band, method, value.

    Morlet coefficients are kept where their support lies in the window. Rows of
    one epoch's channels are joined pair by pair, and one kernel gives all methods.
    """
    bad = set(methods) - (set(METHODS) - {"wpli2_debiased", "imcoh"})
    if bad:
        raise ValueError(f"methods {sorted(bad)} need trials")
    f = np.asarray(freqs, dtype=float)
    in_band = [(b.name, np.flatnonzero((f >= b.fmin) & (f < b.fmax))) for b in bands]
    if any(not len(at) for _, at in in_band):
        raise ValueError("a band holds none of the frequencies")
    names = [(b, m) for b, _ in in_band for m in methods]
    lo, hi = window.tmin, window.tmax

    @F.pandas_udf("array<double>")
    def run(xa: pd.Series, xb: pd.Series, t0: pd.Series) -> pd.Series:
        out = []
        for p, q, start in zip(xa, xb, t0):
            z = kernels.morlet(np.stack([np.asarray(p, dtype=float), np.asarray(q, dtype=float)]), sfreq, f, np.full(len(f), cycles))
            t = start + np.arange(z.shape[2]) / sfreq
            rows = []
            for k in range(len(f)):
                reach = 5 * cycles / (2 * np.pi * f[k])
                own = (t >= max(lo, t[0]) + reach - 1e-9) & (t <= min(hi, t[-1]) - reach + 1e-9)
                s = z[0, k, own] * np.conj(z[1, k, own])
                if len(s) < 2 or not np.isfinite(s).all():
                    rows.append([np.nan] * len(methods))
                    continue
                u, n = s / np.maximum(np.abs(s), 1e-300), len(s)
                made = {
                    "coh": abs(s.mean()) / np.sqrt((abs(z[0, k, own]) ** 2).mean() * (abs(z[1, k, own]) ** 2).mean()), "plv": abs(u.mean()),
                    "ciplv": abs(u.imag.mean()) / np.sqrt(max(1 - u.real.mean() ** 2, 1e-12)), "ppc": (abs(u.sum()) ** 2 - n) / (n * (n - 1)),
                    "pli": abs(np.sign(s.imag).mean()), "wpli": abs(s.imag.mean()) / max(np.abs(s.imag).mean(), 1e-300),
                }
                rows.append([made[m] for m in methods])
            grid = np.array(rows)
            out.append([float(np.nanmean(grid[at, j])) if np.isfinite(grid[at, j]).any() else np.nan for _, at in in_band for j in range(len(methods))])
        return pd.Series(out)

    left = traces.select(*keys, "t0", F.col("channel").alias("a"), F.col("x").alias("xa"))
    right = traces.select(*keys, F.col("channel").alias("b"), F.col("x").alias("xb"))
    rows = left.join(right, list(keys)).where("a < b").select(*keys, "a", "b", F.posexplode(run("xa", "xb", "t0")).alias("k", "value"))
    name = F.get(F.array(*(F.struct(F.lit(b).alias("band"), F.lit(m).alias("method")) for b, m in names)), F.col("k"))
    return rows.withColumn("n", name).select(*keys, "a", "b", "n.band", "n.method", blank("value").alias("value"))
