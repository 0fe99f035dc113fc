"""Recipes: a mapping or TOML file that asks for measures, planned as one set of DataFrames.

Every problem of a recipe is collected before one error names them all. Entries
that share an input share its plan: all time-domain measures over the same
windows are one aggregation, and the spectra are estimated once for all measures.
"""

from __future__ import annotations

import hashlib
import re
import tomllib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.dims import STANDARD_BANDS, Band, Window, canonical_json, feature_name_column
from traceloom.operators import connectivity, estimators, events, phase, spectral, temporal
from traceloom.plans.registry import Measure, lookup
from traceloom.sources.scratch import cut

SECTIONS = ("inputs", "output", "bands", "windows", "rois", "spectra", "band_signal", "trials", "defaults", "features")
ENTRY = ("measure", "measures", "bands", "windows", "baseline", "spatial", "normalize", "ratios", "asymmetry", "pairs", "graph_threshold")
SPATIAL = ("channels", "rois", "global")
RATIO_MEASURES = ("mean_psd", "band_power", "mean_tfr_power")
OUT = ("recording", "epoch", "event", "measure", "band", "window", "space", "space_kind", "value", "coverage")


class RecipeError(ValueError):
    """All problems of a recipe, a line each."""


@dataclass(frozen=True)
class SpectraSettings:
    method: str = "welch"
    fmin: float = 1.0
    fmax: float = 45.0
    n_fft: int | None = None
    bandwidth: float = 2.0
    n_freqs: int = 40
    statistic: str = "mean"


@dataclass(frozen=True)
class Entry:
    """One measure with its bands, windows, baseline, spatial levels and parameters."""

    measure: Measure
    bands: tuple[str, ...]
    windows: tuple[str, ...]
    baseline: str | None
    spatial: tuple[str, ...]
    normalize: str
    params: dict = field(default_factory=dict)
    ratios: tuple[tuple[str, str], ...] = ()
    asymmetry: tuple[tuple[str, str], ...] = ()
    pairs: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Recipe:
    bands: dict[str, Band]
    windows: dict[str, Window]
    rois: dict[str, tuple[str, ...] | str]
    spectra: SpectraSettings
    trials: str | None
    entries: tuple[Entry, ...]
    inputs: dict
    output: dict
    source: dict

    def sha256(self) -> str:
        """Identity of all that the features depend on, paths excluded."""
        own = {k: v for k, v in self.source.items() if k not in ("inputs", "output")}
        return hashlib.sha256(canonical_json(own).encode()).hexdigest()


def _pairs(value: object) -> tuple[tuple[str, str], ...]:
    return tuple((str(a), str(b)) for a, b in value)


def load_recipe(source: Mapping | str | Path) -> Recipe:
    """A validated recipe from a mapping or the path of a TOML file."""
    data = dict(source) if isinstance(source, Mapping) else tomllib.loads(Path(source).read_text())
    problems = [f"unknown section {s!r}" for s in data if s not in SECTIONS]
    bands = {b.name: b for b in STANDARD_BANDS}
    for name, bounds in data.get("bands", {}).items():
        try:
            bands[name] = Band(name, float(bounds[0]), float(bounds[1]))
        except (ValueError, TypeError, IndexError) as e:
            problems.append(f"bands.{name}: {e}")
    windows = {}
    for name, bounds in data.get("windows", {"all": []}).items():
        try:
            windows[name] = Window(name, *map(float, bounds))
        except (ValueError, TypeError) as e:
            problems.append(f"windows.{name}: {e}")
    rois = {n: v if isinstance(v, str) else tuple(v) for n, v in data.get("rois", {}).items()}
    for n, v in rois.items():
        if isinstance(v, str):
            try:
                re.compile(v)
            except re.error as e:
                problems.append(f"rois.{n}: {e}")
    known = {f.name for f in SpectraSettings.__dataclass_fields__.values()}
    given = data.get("spectra", {})
    problems += [f"spectra: unknown key {k!r}" for k in given if k not in known]
    spectra = replace(SpectraSettings(), **{k: v for k, v in given.items() if k in known})
    if spectra.method not in ("welch", "multitaper", "morlet"):
        problems.append(f"spectra.method: unknown method {spectra.method!r}")
    entries = []
    defaults = data.get("defaults", {})
    if not data.get("features"):
        problems.append("features: there are none")
    for k, raw in enumerate(data.get("features", [])):
        at = f"features[{k}]"
        item = defaults | raw
        names = item.get("measures", [item["measure"]] if "measure" in item else [])
        if not names:
            problems.append(f"{at}: no measure")
        for name in names:
            try:
                m = lookup(name)
            except KeyError as e:
                problems.append(f"{at}: {e.args[0]}")
                continue
            params = {p: tuple(v) if isinstance(v, list) else v for p, v in item.items() if p not in ENTRY}
            problems += [f"{at}: {name} has no parameter {p!r}" for p in params if p not in m.settable() and p in raw]
            params = {p: v for p, v in params.items() if p in m.settable()}
            own_bands = tuple(item.get("bands", [b.name for b in STANDARD_BANDS] if m.kind in ("power", "spectrum") else []))
            baseline = item.get("baseline")
            own_windows = tuple(w for w in item.get("windows", list(windows)) if w != baseline)
            spatial = tuple(item.get("spatial", ["channels", "global"]))
            normalize = item.get("normalize", "raw")
            problems += [f"{at}: unknown band {b!r}" for b in own_bands if b not in bands]
            problems += [f"{at}: unknown window {w!r}" for w in (*own_windows, *([baseline] if baseline else [])) if w not in windows]
            problems += [f"{at}: unknown spatial level {s!r}" for s in spatial if s not in SPATIAL]
            if "rois" in spatial and not rois:
                problems.append(f"{at}: there are no rois")
            if m.kind in ("erds",) and not baseline:
                problems.append(f"{at}: {name} needs a baseline")
            if m.kind in ("peak", "phase") and len(own_bands) < 1:
                problems.append(f"{at}: {name} needs bands")
            if m.kind == "power" and (normalize in ("db", "percent", "log_ratio")) != bool(baseline):
                problems.append(f"{at}: {normalize} and the baseline do not fit")
            if name == "mean_tfr_power" and spectra.method != "morlet" or name in ("mean_psd", "spectral_entropy", "aperiodic") and spectra.method == "morlet":
                problems.append(f"{at}: {name} cannot be computed from {spectra.method} spectra")
            ratios, asymmetry, pairs = (_pairs(item.get(x, ())) for x in ("ratios", "asymmetry", "pairs"))
            if ratios and name not in RATIO_MEASURES:
                problems.append(f"{at}: ratios are of {', '.join(RATIO_MEASURES)} only")
            problems += [f"{at}: ratio of {a}, {b} needs both bands" for a, b in ratios if a not in own_bands or b not in own_bands]
            if asymmetry and "channels" not in spatial:
                problems.append(f"{at}: asymmetry needs the channel level")
            if normalize == "percent" and ratios:
                problems.append(f"{at}: a ratio of percentages has no meaning")
            entries.append(Entry(m, own_bands, own_windows, baseline, spatial, normalize, params, ratios, asymmetry, pairs))
    fits = [e.params.get("fit_range", e.measure.defaults.get("fit_range")) for e in entries if "fit_range" in e.measure.defaults]
    low = min((f[0] for f in fits if f), default=spectra.fmin)
    high = max((f[1] for f in fits if f), default=spectra.fmax)
    if low < spectra.fmin or high > spectra.fmax:
        if "fmin" in given and low < spectra.fmin or "fmax" in given and high > spectra.fmax:
            problems.append(f"spectra: {spectra.fmin} to {spectra.fmax} Hz does not cover the fit range {low} to {high}")
        spectra = replace(spectra, fmin=min(low, spectra.fmin), fmax=max(high, spectra.fmax))
    if problems:
        raise RecipeError("\n".join(problems))
    return Recipe(bands, windows, rois, spectra, data.get("trials", {}).get("column"), tuple(entries), data.get("inputs", {}), data.get("output", {}), data)


def resolve_rois(recipe: Recipe, channels: Sequence[str]) -> dict[str, list[str]]:
    """Channels of each region: listed, or those that its pattern matches whole."""
    out = {}
    for name, v in recipe.rois.items():
        own = [c for c in channels if re.fullmatch(v, c)] if isinstance(v, str) else list(v)
        missing = [c for c in own if c not in channels]
        if missing or not own:
            raise RecipeError(f"rois.{name}: {'unknown channels ' + str(missing) if missing else 'matches no channel'}")
        out[name] = own
    return out


def _shape(df: DataFrame) -> DataFrame:
    """The common columns, absent ones as null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("int" if c == "epoch" else "string").alias(c) for c in OUT))


def _levels(e: Entry, rois: dict) -> list[tuple[dict | None, bool]]:
    """Calls that cover the entry's spatial levels: (groups, include_global)."""
    out: list[tuple[dict | None, bool]] = []
    if "channels" in e.spatial:
        out.append((None, "global" in e.spatial))
    if "rois" in e.spatial:
        out.append((rois, "global" in e.spatial and not out))
    if not out:
        out.append(({}, True))
    return out


class Inputs:
    """Inputs that entries share: spectra and band signals, each computed once and written to the shared folder."""

    def __init__(self, traces: DataFrame, recipe: Recipe, sfreq: float, n: int) -> None:
        self.traces, self.recipe, self.sfreq, self.n = traces, recipe, sfreq, n
        self._spectra: dict[tuple, tuple[DataFrame, list[float]]] = {}
        self._bands: dict[str, DataFrame] = {}

    def spectra(self, windows: Sequence[str]) -> tuple[DataFrame, list[float]]:
        key, s = tuple(sorted(set(windows))), self.recipe.spectra
        if key not in self._spectra:
            own = [self.recipe.windows[w] for w in key]
            shortest = min(self.n, *(self._samples(w) for w in own))
            n_fft = s.n_fft or min(round(2 * self.sfreq), shortest)
            top = min(s.fmax, self.sfreq / 2)
            if s.method == "multitaper":
                self._spectra[key] = estimators.multitaper(self.traces, own, self.sfreq, shortest, s.bandwidth, s.fmin, top)
            elif s.method == "morlet":
                freqs = [s.fmin * (top / s.fmin) ** (k / (s.n_freqs - 1)) for k in range(s.n_freqs)]
                rows = estimators.morlet(self.traces, own, self.sfreq, freqs, [min(max(f / 2, 3.0), 15.0) for f in freqs], s.statistic)
                self._spectra[key] = (rows, freqs)
            else:
                self._spectra[key] = estimators.welch(self.traces, own, self.sfreq, n_fft, s.fmin, top, statistic=s.statistic)
            rows, freqs = self._spectra[key]
            self._spectra[key] = (cut(rows, "spectra"), freqs)
        return self._spectra[key]

    def _samples(self, w: Window) -> int:
        lo, hi = max(0.0, w.tmin), min((self.n - 1) / self.sfreq, w.tmax)
        return max(0, int((hi - lo) * self.sfreq + 1e-9) + 1)

    def band(self, name: str) -> DataFrame:
        if name not in self._bands:
            self._bands[name] = cut(estimators.band_signal(self.traces, self.recipe.bands[name], self.sfreq), "band")
        return self._bands[name]

    def modulus(self, name: str, square: bool) -> DataFrame:
        z = F.transform(F.arrays_zip("re", "im"), lambda v: v["re"] * v["re"] + v["im"] * v["im"])
        x = z if square else F.transform(z, lambda v: F.sqrt(v))
        return self.band(name).select("recording", "epoch", "event", "channel", F.lit(0.0).alias("t0"), "sfreq", x.alias("x"))


def extract(traces: DataFrame, recipe: Recipe, sfreq: float, n_samples: int, channels: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(per-epoch cells, cross-trial cells or None) of all entries.

    traces: keys, channel, t0, sfreq, x. The recordings' rate, length and channels
    are stated. Spectra and band signals are computed here, once for all entries;
    the entries themselves are planned only.
    """
    rois = resolve_rois(recipe, channels) if recipe.rois else {}
    inputs = Inputs(traces, recipe, sfreq, n_samples)
    per_epoch: list[DataFrame] = []
    per_trial: list[DataFrame] = []
    fused: dict[tuple, list[Entry]] = {}
    for e in recipe.entries:
        if e.measure.kind == "time":
            fused.setdefault((e.windows, e.spatial, tuple(sorted(e.params.items()))), []).append(e)
    for (own, _, params), group in fused.items():
        for groups, all_of in _levels(group[0], rois):
            names = list(dict.fromkeys(g.measure.name for g in group))
            per_epoch.append(_shape(temporal.temporal_features(traces, [recipe.windows[w] for w in own], names, groups, all_of, **dict(params))))
    for e in recipe.entries:
        own = [recipe.windows[w] for w in e.windows]
        bands = [recipe.bands[b] for b in e.bands]
        kind, f = e.measure.kind, e.measure.function
        for groups, all_of in _levels(e, rois):
            kw = {"groups": groups, "include_global": all_of}
            if kind in ("power", "spectrum"):
                rows, freqs = inputs.spectra([*e.windows, *([e.baseline] if e.baseline else [])])
                extra = {"baseline": e.baseline, "normalize": e.normalize} if kind == "power" else {}
                made = f(rows, freqs, bands=bands, **extra, **kw, **e.params)
                per_epoch.append(_shape(made))
                log = e.normalize in ("log10", "db", "log_ratio")
                per_epoch += [_shape(spectral.band_ratio(made, a, b, log)) for a, b in e.ratios]
                if e.asymmetry and groups is None:
                    per_epoch.append(_shape(spectral.asymmetry(made, e.asymmetry, log)))
            elif kind == "fit":
                rows, freqs = inputs.spectra(e.windows)
                per_epoch.append(_shape(f(rows, freqs, **kw, **e.params)))
            elif kind == "peak":
                rows, freqs = inputs.spectra(e.windows)
                per_epoch += [_shape(f(rows, freqs, b, **kw, **e.params)) for b in bands]
            elif kind == "trace":
                per_epoch.append(_shape(f(traces, own, **e.params, **kw)))
            elif kind == "burst":
                for b in bands:
                    made = events.burst_features(inputs.modulus(b.name, False), own, [e.measure.name.removeprefix("burst_")], baseline=recipe.windows[e.baseline] if e.baseline else None, sfreq=sfreq, **kw, **e.params)
                    per_epoch.append(_shape(made.withColumns({"band": F.lit(b.name), "measure": F.concat(F.lit("burst_"), "measure")})))
            elif kind == "erds":
                for b in bands:
                    made = events.erds_features(inputs.modulus(b.name, True), recipe.windows[e.baseline], own, [e.measure.name], band=b, sfreq=sfreq, **kw, **e.params)
                    per_epoch.append(_shape(made.withColumn("band", F.lit(b.name))))
            elif kind == "phase":
                for b in bands:
                    made = f(inputs.band(b.name), own, recipe.trials, **kw, **e.params)
                    per_trial.append(made.withColumn("band", F.lit(b.name)))
    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None
    cells = union(per_epoch)
    if cells is None:
        cells = traces.sparkSession.createDataFrame([], "recording string, epoch long, event string, measure string, band string, window string, space string, space_kind string, value double, coverage double")
    name = feature_name_column(F.col("measure"), F.col("band"), F.col("space"), F.col("window"), F.lit("raw"), F.lit(recipe.sha256()))
    return cells.withColumn("feature", name), union(per_trial)


def connect(traces: DataFrame, recipe: Recipe, sfreq: float, n: int, methods: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Connectivity of channel pairs by multitaper cross-spectra, over the recipe's trial groups."""
    rows, freqs = estimators.cross_inputs(traces, sfreq, n, recipe.spectra.bandwidth)
    return connectivity.spectral_connectivity(rows, freqs, methods, [recipe.bands[b] for b in bands], recipe.trials, keys=("recording", "epoch", "event", "taper"))


def couple(traces: DataFrame, recipe: Recipe, sfreq: float, slow: str, fast: str, windows: Sequence[str]) -> DataFrame:
    """Phase-amplitude coupling of two of the recipe's bands."""
    a, b = recipe.bands[slow], recipe.bands[fast]
    phase.check_bands((a.fmin, a.fmax), (b.fmin, b.fmax))
    inputs = Inputs(traces, recipe, sfreq, 0)
    return phase.pac(inputs.band(slow), inputs.band(fast), [recipe.windows[w] for w in windows])


def run(traces: DataFrame, recipe: Recipe, path: str, sfreq: float, n_samples: int, channels: Sequence[str], resume: bool = False) -> None:
    """Write the cells of all recordings as Parquet, a folder for each recording and recipe.

    With resume, recordings that this recipe has already written are left out, by
    an anti join to the manifest of done ones.
    """
    own = traces
    if resume:
        done = status(traces, recipe, path).where("state = 'done'").select("recording")
        own = traces.join(done, "recording", "left_anti")
    cells, _ = extract(own, recipe, sfreq, n_samples, channels)
    cells.withColumn("recipe", F.lit(recipe.sha256())).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recipe", "recording").parquet(path)


def status(traces: DataFrame, recipe: Recipe, path: str) -> DataFrame:
    """(recording, state): done, stale (written by another recipe) or missing."""
    spark = traces.sparkSession
    wanted = traces.select("recording").distinct()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return wanted.withColumn("state", F.lit("missing"))
    # What cannot be read is an error, not a recording to compute again.
    written = spark.read.parquet(path).select("recipe", F.col("recording").cast("string").alias("recording")).distinct()
    own = written.groupBy("recording").agg(F.max((F.col("recipe") == recipe.sha256()).cast("int")).alias("own"))
    return wanted.join(own, "recording", "left").select("recording", F.when(F.col("own") == 1, "done").when(F.col("own") == 0, "stale").otherwise("missing").alias("state"))


def check(traces: DataFrame, recipe: Recipe, sfreq: float, n_samples: int, channels: Sequence[str]) -> dict:
    """A dry run on one recording: rows, features and how many recordings there are."""
    first = traces.select("recording").limit(1)
    cells, _ = extract(traces.join(first, "recording", "left_semi"), recipe, sfreq, n_samples, channels)
    got = cells.agg(F.count("*").alias("cells"), F.count_distinct("feature").alias("features"), F.count_if(F.col("value").isNull()).alias("missing")).first()
    return got.asDict() | {"recordings": traces.select("recording").distinct().count()}
