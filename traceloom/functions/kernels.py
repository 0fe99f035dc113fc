"""Array kernels for Arrow batches: Fourier, filters, complexity. NumPy only."""

from __future__ import annotations

import math

import numpy as np


def welch(x: np.ndarray, sfreq: float, n_fft: int, overlap: int | None = None, statistic: str = "mean") -> tuple[np.ndarray, np.ndarray]:
    """Hann Welch density of the rows of x; a row with a missing sample is all NaN.

    The median over segments is divided by its bias for that many segments.
    """
    x = np.atleast_2d(np.asarray(x, dtype=float))
    n_fft = min(n_fft, x.shape[1])
    step = n_fft - (n_fft // 2 if overlap is None else overlap)
    if step < 1:
        raise ValueError("segments must not overlap whole")
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    starts = range(0, x.shape[1] - n_fft + 1, step)
    segments = np.stack([x[:, s : s + n_fft] for s in starts], axis=1)
    segments = segments - segments.mean(axis=2, keepdims=True)
    p = np.abs(np.fft.rfft(segments * window, axis=2)) ** 2 / (sfreq * (window**2).sum())
    p[..., 1 : -1 if n_fft % 2 == 0 else None] *= 2
    k = p.shape[1]
    if statistic == "median":
        if k < 3:
            raise ValueError("a median needs three segments at least")
        odd = 2 * np.arange(1, (k - 1) // 2 + 1)
        p = np.median(p, axis=1) / (1 + (1 / (odd + 1) - 1 / odd).sum())
    else:
        p = p.mean(axis=1)
    p[~np.isfinite(x).all(axis=1)] = np.nan
    return np.fft.rfftfreq(n_fft, 1 / sfreq), p


def dpss(n: int, half_bandwidth: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First k Slepian tapers of length n and their concentrations, from the tridiagonal matrix that commutes."""
    w = half_bandwidth / n
    t = np.arange(n)
    main = ((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * w)
    side = t[1:] * (n - t[1:]) / 2
    matrix = np.diag(main) + np.diag(side, 1) + np.diag(side, -1)
    _, vectors = np.linalg.eigh(matrix)
    tapers = vectors[:, ::-1][:, :k].T.copy()
    for i, v in enumerate(tapers):
        lead = v.sum() if i % 2 == 0 else ((n - 1 - 2 * t) * v).sum()
        if lead < 0:
            tapers[i] = -v
    gap = t[:, None] - t[None, :]
    kernel = np.where(gap == 0, 2 * w, np.sin(2 * np.pi * w * gap) / np.where(gap == 0, 1, np.pi * gap))
    return tapers, np.einsum("ki,ij,kj->k", tapers, kernel, tapers)


def taper_set(n: int, sfreq: float, bandwidth: float) -> tuple[np.ndarray, np.ndarray]:
    """Tapers of a bandwidth in Hz whose concentration is over 0.9."""
    half = bandwidth * n / (2 * sfreq)
    if bandwidth < 1.35 * sfreq / n:
        raise ValueError("the bandwidth is under 1.35 bins")
    k = max(1, int(2 * half - 1))
    tapers, share = dpss(n, half, k)
    keep = share > 0.9
    return (tapers[keep], share[keep]) if keep.any() else (tapers[:1], share[:1])


def multitaper(x: np.ndarray, sfreq: float, bandwidth: float) -> tuple[np.ndarray, np.ndarray]:
    """Multitaper density of the rows of x, tapers weighted by their concentration."""
    x = np.atleast_2d(np.asarray(x, dtype=float))
    n = x.shape[1]
    tapers, share = taper_set(n, sfreq, bandwidth)
    y = np.fft.rfft((x - x.mean(axis=1, keepdims=True))[:, None, :] * tapers, axis=2)
    p = (share[:, None] * np.abs(y) ** 2).sum(axis=1) / share.sum() / sfreq
    p[:, 1 : -1 if n % 2 == 0 else None] *= 2
    p[~np.isfinite(x).all(axis=1)] = np.nan
    return np.fft.rfftfreq(n, 1 / sfreq), p


def tapered_spectra(x: np.ndarray, sfreq: float, bandwidth: float) -> np.ndarray:
    """Complex spectra (row, taper, frequency) of the rows of x."""
    x = np.atleast_2d(np.asarray(x, dtype=float))
    tapers, share = taper_set(x.shape[1], sfreq, bandwidth)
    return np.fft.rfft((x - x.mean(axis=1, keepdims=True))[:, None, :] * tapers, axis=2) * np.sqrt(share)[None, :, None]


def morlet(x: np.ndarray, sfreq: float, freqs: np.ndarray, cycles: np.ndarray) -> np.ndarray:
    """Complex Morlet coefficients (row, frequency, time); wavelets are cut at five deviations."""
    x = np.atleast_2d(np.asarray(x, dtype=float))
    out = np.empty((x.shape[0], len(freqs), x.shape[1]), dtype=complex)
    for k, (f, c) in enumerate(zip(freqs, np.broadcast_to(cycles, len(freqs)))):
        sigma = c / (2 * np.pi * f)
        half = int(np.ceil(5 * sigma * sfreq))
        t = np.arange(-half, half + 1) / sfreq
        w = (np.exp(2j * np.pi * f * t) - np.exp(-2 * (np.pi * f * sigma) ** 2)) * np.exp(-(t**2) / (2 * sigma**2))
        w /= np.sqrt(0.5) * np.linalg.norm(w)
        size = x.shape[1] + len(w) - 1
        full = np.fft.ifft(np.fft.fft(x, size, axis=1) * np.fft.fft(w, size)[None, :], axis=1)
        out[:, k] = full[:, half : half + x.shape[1]]
    return out


def fir_bandpass(sfreq: float, fmin: float, fmax: float) -> np.ndarray:
    """Hamming-windowed sinc of odd length; transitions are a quarter of the edge, two hertz at least."""
    low, high = min(max(0.25 * fmin, 2.0), fmin), min(max(0.25 * fmax, 2.0), sfreq / 2 - fmax)
    n = int(math.ceil(3.3 * sfreq / max(min(low, high), 1e-6)))
    n += 1 - n % 2
    t = np.arange(n) - (n - 1) / 2
    lo, hi = max(fmin - low / 2, 0.0), min(fmax + high / 2, sfreq / 2)
    h = (2 * hi / sfreq) * np.sinc(2 * hi * t / sfreq) - (2 * lo / sfreq) * np.sinc(2 * lo * t / sfreq)
    h *= 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    gain = abs(np.exp(-2j * np.pi * (fmin + fmax) / 2 * t / sfreq) @ h)
    return h / gain


def hilbert(x: np.ndarray) -> np.ndarray:
    """Analytic signal of the rows of x."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * gain, axis=-1)


def band_analytic(x: np.ndarray, sfreq: float, fmin: float, fmax: float, pad_seconds: float = 0.5, pad_cycles: float = 3.0) -> np.ndarray:
    """Analytic band signal of the rows of x: reflected ends, zero-phase filter, Hilbert; a bad sample voids its row."""
    x = np.atleast_2d(np.asarray(x, dtype=float))
    bad = ~np.isfinite(x).all(axis=1)
    x = np.where(bad[:, None], 0.0, x)
    pad = min(int(np.ceil(max(pad_seconds, pad_cycles / fmin) * sfreq)), x.shape[1] - 1)
    ends = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1) if pad > 0 else x
    h = fir_bandpass(sfreq, fmin, fmax)
    size = ends.shape[1] + len(h) - 1
    y = np.fft.irfft(np.fft.rfft(ends, size, axis=1) * np.fft.rfft(h, size), size, axis=1)
    lead = (len(h) - 1) // 2
    z = hilbert(y[:, lead : lead + ends.shape[1]])[:, pad : pad + x.shape[1]]
    z[bad] = np.nan
    return z


def coarse_grain(x: np.ndarray, scale: int) -> np.ndarray:
    """Means of blocks of `scale` samples; a block with a missing sample is missing."""
    n = len(x) // scale
    return x[: n * scale].reshape(n, scale).mean(axis=1) if scale > 1 else x


def tolerance_of(x: np.ndarray, r: float) -> float:
    v = x[np.isfinite(x)]
    return float("nan") if not len(v) else 0.0 if np.ptp(v) == 0 else r * float(np.std(v))


def sample_entropy(x: np.ndarray, order: int = 2, r: float = 0.2, tolerance: float | None = None) -> float:
    """-ln of the share of template pairs within the tolerance that stay so one sample longer.

    Distances are the largest of the coordinates', strictly under the tolerance;
    templates with a missing sample are left out.
    """
    x = np.asarray(x, dtype=float)
    if len(x) < order + 2:
        return float("nan")
    tol = tolerance_of(x, r) if tolerance is None else tolerance
    t = np.lib.stride_tricks.sliding_window_view(x, order + 1)
    t = t[np.isfinite(t).all(axis=1)]
    if not (tol > 0) or len(t) < 2:
        return float("nan")
    short = long = 0
    rows = max(1, 1_000_000 // len(t))
    for lo in range(0, len(t), rows):
        part = t[lo : lo + rows]
        near = np.triu(np.ones((len(part), len(t)), dtype=bool), lo + 1)
        for d in range(order):
            near &= np.abs(part[:, d : d + 1] - t[None, :, d]) < tol
        short += int(near.sum())
        long += int((near & (np.abs(part[:, order : order + 1] - t[None, :, order]) < tol)).sum())
    return float("nan") if not short else float("inf") if not long else -math.log(long / short)


def higuchi(x: np.ndarray, k_max: int = 10) -> float:
    """Slope of the log curve length over the log inverse stride."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    if n < 2 * k_max or not np.isfinite(x).all():
        return float("nan")
    lengths = []
    for k in range(1, k_max + 1):
        own = [np.abs(np.diff(x[m::k])).sum() * (n - 1) / (((n - m - 1) // k) * k * k) for m in range(k)]
        lengths.append(sum(own) / k)
    y = np.array(lengths)
    ok = y > 0
    if ok.sum() < 2:
        return float("nan")
    a, b = -np.log(np.arange(1, k_max + 1))[ok], np.log(y[ok])
    a, b = a - a.mean(), b - b.mean()
    return float(a @ b / (a @ a))


def lempel_ziv(x: np.ndarray, symbolization: str = "median") -> float:
    """Phrases of the 1976 parsing of the sequence of samples at or over the median or mean, by n / log2 n."""
    x = np.asarray(x, dtype=float)
    if len(x) < 2 or not np.isfinite(x).all():
        return float("nan")
    s = (x >= (np.median(x) if symbolization == "median" else x.mean())).astype(np.uint8)
    if s.min() == s.max():
        return float("nan")
    text, n, phrases, at = s.tobytes(), len(s), 0, 0
    while at < n:
        size = 1
        # The phrase grows while it occurs before its own last symbol.
        while at + size <= n and text.find(text[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        phrases += 1
        at += size
    return phrases * math.log2(n) / n


def detrended_fluctuation(x: np.ndarray) -> float:
    """Exponent of the root mean square of detrended profiles over block lengths from 4 to a tenth."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    if n < 58 or not np.isfinite(x).all() or np.ptp(x) == 0:
        return float("nan")
    profile = np.cumsum(x - x.mean())
    sizes, s = [], 4.0
    while s <= 0.1 * n:
        if int(s) not in sizes:
            sizes.append(int(s))
        s *= 1.2
    logs = []
    for size in sizes:
        blocks = profile[: n // size * size].reshape(-1, size)
        t = np.arange(size) - (size - 1) / 2
        y = blocks - blocks.mean(axis=1, keepdims=True)
        rest = y - np.outer(y @ t / (t @ t), t)
        f = np.sqrt((rest**2).mean(axis=1)).mean()
        if f > 0:
            logs.append((math.log(size), math.log(f)))
    if len(logs) < 2:
        return float("nan")
    a, b = np.array(logs).T
    a, b = a - a.mean(), b - b.mean()
    return float(a @ b / (a @ a))
