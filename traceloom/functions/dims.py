"""Small dimensions: bands, windows, channel groups, feature names and hashes."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Band:
    """A named frequency band; bins are picked from fmin up to, not including, fmax."""

    name: str
    fmin: float
    fmax: float

    def __post_init__(self) -> None:
        if not self.name.strip():
            raise ValueError("a band needs a name")
        if not (math.isfinite(self.fmin) and math.isfinite(self.fmax) and 0 <= self.fmin < self.fmax):
            raise ValueError(f"band {self.name}: bounds must be finite and rising")

    def picks(self, f: Column) -> Column:
        return (f >= self.fmin) & (f < self.fmax)


#: The usual bands (fixed values).
STANDARD_BANDS = (Band("delta", 1.0, 4.0), Band("theta", 4.0, 8.0), Band("alpha", 8.0, 13.0), Band("beta", 13.0, 30.0), Band("gamma", 30.0, 45.0))


@dataclass(frozen=True)
class Window:
    """A named closed interval of seconds; infinite bounds mean the whole epoch."""

    name: str
    tmin: float = -math.inf
    tmax: float = math.inf

    def __post_init__(self) -> None:
        if not self.name.strip() or math.isnan(self.tmin) or math.isnan(self.tmax) or self.tmin > self.tmax:
            raise ValueError(f"bad window {self.name!r}")

    def holds(self, t: Column) -> Column:
        inside = F.lit(True)
        if math.isfinite(self.tmin):
            inside = inside & (t >= self.tmin)
        if math.isfinite(self.tmax):
            inside = inside & (t <= self.tmax)
        return inside

    def bounds(self, t0: Column, sfreq: Column, n: Column) -> tuple[Column, Column]:
        """First sample and number of samples inside, of a trace of n samples from t0 on."""
        eps = 1e-9
        lo = F.greatest(F.lit(0), F.ceil((F.lit(self.tmin) - t0) * sfreq - eps)) if math.isfinite(self.tmin) else F.lit(0)
        hi = F.least(n - 1, F.floor((F.lit(self.tmax) - t0) * sfreq + eps)) if math.isfinite(self.tmax) else n - 1
        return lo.cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int")


def passband_fraction(fmin: Column, fmax: Column, highpass: Column, lowpass: Column) -> Column:
    """Share of a band inside a recording's passband; a missing or infinite edge does not limit."""
    inf = float("inf")
    known = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != inf)
    low = F.when(known(highpass), F.greatest(fmin, highpass)).otherwise(fmin)
    high = F.when(known(lowpass), F.least(fmax, lowpass)).otherwise(fmax)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (high - low) / (fmax - fmin)))


def check_passband(band: Band, highpass: float | None, lowpass: float | None) -> float:
    """Share of the band inside the passband; none of it is an error."""
    low = max(band.fmin, highpass) if highpass is not None and math.isfinite(highpass) else band.fmin
    high = min(band.fmax, lowpass) if lowpass is not None and math.isfinite(lowpass) else band.fmax
    share = max(0.0, min(1.0, (high - low) / (band.fmax - band.fmin)))
    if share == 0:
        raise ValueError(f"band {band.name} lies outside the passband")
    return share


def minimum_samples(seconds: float, sfreq: float) -> int:
    """Least whole number of samples that last so long, at least one."""
    return max(1, math.ceil(np.nextafter(seconds * sfreq, -math.inf)))


def trapezoid_weights(freqs: Sequence[float]) -> np.ndarray:
    f = np.asarray(freqs, dtype=float)
    if len(f) == 1:
        return np.ones(1)
    step = np.diff(f)
    return (np.r_[step, 0] + np.r_[0, step]) / 2


def gradient_weights(freqs: Sequence[float]) -> np.ndarray:
    """Width of each bin, full steps at the edges."""
    f = np.asarray(freqs, dtype=float)
    return np.ones(1) if len(f) == 1 else np.gradient(f)


def band_weights(freqs: Sequence[float], fmin: float, fmax: float) -> np.ndarray:
    """Weights of the integral from fmin to fmax of the line through the bins.

    Each segment between bins adds the part of it inside the band, shared between
    its ends as linear interpolation does.
    """
    f = np.asarray(freqs, dtype=float)
    if len(f) < 2 or fmin < f[0] - 1e-9 or fmax > f[-1] + 1e-9:
        raise ValueError(f"the axis does not span {fmin} to {fmax} Hz")
    a, b = f[:-1], f[1:]
    lo, hi = np.clip(fmin, a, b), np.clip(fmax, a, b)
    width, middle = np.maximum(hi - lo, 0.0), (lo + hi) / 2
    share = (middle - a) / (b - a)
    return np.r_[width * (1 - share), 0] + np.r_[0, width * share]


def weights_table(spark: SparkSession, freqs: Sequence[float], bands: Sequence[Band], kind: str = "band") -> DataFrame:
    """(band, bin, w): a small dimension of bins by bands; its size is that of one axis times the bands."""
    f = np.asarray(freqs, dtype=float)
    rows = []
    for band in bands:
        if kind == "band":
            w = band_weights(f, band.fmin, band.fmax)
        else:
            own = np.flatnonzero((f >= band.fmin) & (f < band.fmax))
            part = {"trapezoid": trapezoid_weights, "gradient": gradient_weights, "uniform": lambda x: np.ones(len(x))}[kind](f[own])
            w = np.zeros(len(f))
            w[own] = part
        rows += [(band.name, int(k), float(f[k]), float(v)) for k, v in enumerate(w) if v > 0]
    return spark.createDataFrame(rows, "band string, bin int, f double, w double")


def slug(text: str) -> str:
    return text.strip().lower().replace("_", "-").replace(" ", "-")


def slug_column(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[_ ]", "-")


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, non-finite numbers as strings."""

    def plain(v):
        if isinstance(v, Mapping):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        if isinstance(v, float) and not math.isfinite(v):
            return "nan" if math.isnan(v) else ("inf" if v > 0 else "-inf")
        return v.item() if isinstance(v, np.generic) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def identity(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@dataclass(frozen=True)
class Computation:
    """What made a column: method and canonical parameters."""

    method: str
    parameters: str = "{}"

    @property
    def sha256(self) -> str:
        return hashlib.sha256(f"{self.method}\n{self.parameters}".encode()).hexdigest()


def feature_name_column(measure: Column, band: Column, space: Column, window: Column, normalization: Column, parameters: Column | None = None) -> Column:
    """tl_measure_band_space_window_normalization, with a short hash of the full metadata if given."""
    name = F.concat_ws(
        "_", F.lit("tl"), slug_column(measure), slug_column(F.coalesce(band, F.lit("broadband"))), slug_column(space),
        slug_column(F.coalesce(window, F.lit("all"))), slug_column(normalization),
    )
    return name if parameters is None else F.concat(name, F.lit("_p"), F.substring(F.sha2(parameters, 256), 1, 12))
