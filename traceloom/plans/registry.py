"""Measures by name: what a recipe can ask for, and which parameters each takes."""

from __future__ import annotations

import inspect
import types
import typing
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from importlib.metadata import entry_points

from traceloom.operators import complexity, events, phase, spectral, temporal

#: Entry points of this group name further measures.
GROUP = "traceloom.measures"


@dataclass(frozen=True)
class Measure:
    """A measure: its kind says what it is computed from, its defaults what a recipe may set."""

    name: str
    kind: str
    function: Callable
    defaults: dict = field(default_factory=dict)

    def settable(self) -> set[str]:
        return set(self.defaults)


def _defaults(f: Callable, skip: Sequence[str]) -> dict:
    return {n: p.default for n, p in inspect.signature(f).parameters.items() if p.default is not inspect.Parameter.empty and n not in skip}


_SHARED = ("groups", "include_global", "measures", "bands", "baseline", "normalize", "measure")


def built_in() -> dict[str, Measure]:
    out = {}
    for m in temporal.MEASURES:
        allowed = {"amplitude_quantile": {"q": 0.5}, "peak_amplitude": {"polarity": "absolute"}, "peak_latency": {"polarity": "absolute"}}.get(m, {})
        out[m] = Measure(m, "time", temporal.temporal_features, allowed)
    for m in events.BURSTS:
        out[f"burst_{m}"] = Measure(f"burst_{m}", "burst", events.burst_features, {"threshold": 0.75, "min_ms": 100.0})
    for m in events.ERDS:
        out[m] = Measure(m, "erds", events.erds_features, {"mode": "db", "onset_samples": None})
    for f in (spectral.mean_psd, spectral.mean_tfr_power, spectral.band_power, spectral.periodic_power):
        out[f.__name__] = Measure(f.__name__, "power", f, _defaults(f, _SHARED))
    for f in (spectral.spectral_centroid, spectral.spectral_bandwidth, spectral.spectral_entropy, spectral.spectral_edge):
        out[f.__name__] = Measure(f.__name__, "spectrum", f, _defaults(f, _SHARED))
    out["aperiodic"] = Measure("aperiodic", "fit", spectral.aperiodic, {"fit_range": (2.0, 40.0), "z": 2.5, "rounds": 3})
    out["peak_frequency"] = Measure("peak_frequency", "peak", spectral.peak_frequency, _defaults(spectral.peak_frequency, _SHARED))
    for f in (complexity.sample_entropy, complexity.multiscale_entropy, complexity.higuchi_fd, complexity.lempel_ziv, complexity.detrended_fluctuation, complexity.permutation_entropy):
        out[f.__name__] = Measure(f.__name__, "trace", f, _defaults(f, _SHARED) | ({"scale": 1} if f is complexity.multiscale_entropy else {}))
    for f in (phase.itpc, phase.ppc):
        out[f.__name__] = Measure(f.__name__, "phase", f, {"least": 2})
    return out


def lookup(name: str) -> Measure:
    """A built-in measure or one that an installed package offers."""
    own = built_in()
    if name in own:
        return own[name]
    for e in entry_points(group=GROUP):
        if e.name == name:
            found = e.load()
            return found if isinstance(found, Measure) else Measure(name, "trace", found, _defaults(found, _SHARED))
    raise KeyError(f"unknown measure {name!r}")


def convert(value: object, annotation: object) -> object:
    """A recipe's value as the annotated type: numbers to floats, lists to tuples, choices checked."""
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if annotation in (inspect.Parameter.empty, typing.Any):
        return value
    if origin in (typing.Union, types.UnionType):
        for a in args:
            try:
                return convert(value, a)
            except (TypeError, ValueError):
                continue
        raise ValueError(f"{value!r} is none of {args}")
    if origin is typing.Literal:
        if value not in args:
            raise ValueError(f"{value!r} is none of {args}")
        return value
    if annotation is type(None):
        if value is not None:
            raise ValueError(f"{value!r} is not null")
        return None
    if annotation is float:
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise TypeError(f"{value!r} is not a number")
        return float(value)
    if annotation is int:
        if isinstance(value, bool) or not isinstance(value, int):
            raise TypeError(f"{value!r} is not a whole number")
        return value
    if annotation in (str, bool):
        if not isinstance(value, annotation):
            raise TypeError(f"{value!r} is not a {annotation.__name__}")
        return value
    if origin in (tuple, list) or isinstance(origin, type) and issubclass(origin, Sequence):
        if not isinstance(value, (list, tuple)):
            raise TypeError(f"{value!r} is not a list")
        inner = args or (typing.Any,)
        kinds = [inner[0]] * len(value) if len(inner) == 1 or inner[-1] is Ellipsis else inner
        if len(kinds) != len(value):
            raise ValueError(f"{value!r} has not {len(kinds)} items")
        return tuple(convert(v, k) for v, k in zip(value, kinds))
    return value
