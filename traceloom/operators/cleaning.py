"""Recordings to clean epochs as one recipe-driven call, or stage by stage with stored results.

A recording is a row for each channel with its whole signal (epoch 0, event
"raw"), so filters, crops and cuts are array functions within rows. Stages form a
chain; a stage's identity is the hash of its settings, its decisions and the
identity of the stage before, so a stored result is used as long as nothing that
it came from has changed.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.dims import identity
from traceloom.operators import preprocess as P
from traceloom.operators.spatial_models import channel_matrix

KEYS = P.KEYS


class CleaningError(ValueError):
    """All problems of a cleaning recipe, or a stage that cannot run."""


# Steps that the chain adds to traceloom.operators.preprocess -------------------------------------


def crop_raw(traces: DataFrame, tmin: float = 0.0, tmax: float | None = None) -> DataFrame:
    """Whole signals from tmin to tmax; without tmax to their end."""
    return P.crop_epochs(traces, tmin, float("1e12") if tmax is None else tmax)


def apply_raw_review(traces: DataFrame, bads: Sequence[str] = (), spans: DataFrame | None = None) -> DataFrame:
    """Signals without the channels given, and null within the spans (recording, start, stop, in samples)."""
    out = traces.where(~F.col("channel").isin(list(bads))) if bads else traces
    if spans is None:
        return out
    held = spans.groupBy("recording").agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    inside = lambda i: F.coalesce(F.exists("_spans", lambda s: (i >= s["start"]) & (i < s["stop"])), F.lit(False))
    return out.join(held, "recording", "left").withColumn("x", F.transform("x", lambda v, i: F.when(~inside(i), v))).drop("_spans")


def cut_traces(traces: DataFrame, events: DataFrame, tmin: float, tmax: float) -> DataFrame:
    """An epoch row for each event (recording, i, label) that lies within its recording; epochs count a recording's events from 0."""
    n = F.round((F.lit(tmax) - F.lit(tmin)) * F.col("sfreq")).cast("int") + 1
    first = (F.col("i") + F.round(F.lit(tmin) * F.col("sfreq"))).cast("int")
    numbered = events.groupBy("recording").agg(F.array_sort(F.collect_list(F.struct("i", "label"))).alias("e")).select("recording", F.posexplode("e").alias("epoch", "e")).select("recording", "epoch", "e.i", F.col("e.label").alias("event"))
    rows = traces.drop("epoch", "event").join(numbered, "recording").withColumns({"_first": first, "_n": n}).where((F.col("_first") >= 0) & (F.col("_first") + F.col("_n") <= F.size("x")))
    return rows.select("recording", F.col("epoch").cast("int").alias("epoch"), "event", "channel", F.lit(float(tmin)).alias("t0"), "sfreq", F.slice("x", F.col("_first") + 1, F.col("_n")).alias("x"))


def fit_rejection(traces: DataFrame, candidates: int = 10, folds: int = 5) -> DataFrame:
    """(recording, channel, threshold): the peak-to-peak limit whose kept epochs' mean is nearest to the median of left-out ones.

    Candidates are quantiles of a channel's own peak-to-peak values (Jas et al.,
    "Autoreject", 2017); a task holds one channel of one recording.
    """

    def run(own: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(own.sort_values("epoch")["x"].map(lambda v: np.asarray(v, dtype=float)).to_numpy())
        size, of = np.nanmax(x, axis=1) - np.nanmin(x, axis=1), np.arange(len(x)) % folds
        best = (np.inf, float(np.nanmax(size)))
        for limit in np.unique(np.quantile(size, np.linspace(0.2, 1.0, candidates))):
            error = []
            for k in range(min(folds, len(x))):
                train, test = x[(of != k) & (size <= limit)], x[of == k]
                error.append(np.inf if not len(train) or not len(test) else float(np.sqrt(np.nanmean((train.mean(axis=0) - np.nanmedian(test, axis=0)) ** 2))))
            if np.mean(error) < best[0]:
                best = (float(np.mean(error)), float(limit))
        return pd.DataFrame({"recording": own["recording"].iloc[:1], "channel": own["channel"].iloc[:1], "threshold": [best[1]]})

    kind = dict(traces.dtypes)["recording"]
    return traces.select("recording", "epoch", "channel", "x").groupBy("recording", "channel").applyInPandas(run, f"recording {kind}, channel string, threshold double")


def apply_rejection(traces: DataFrame, model: DataFrame) -> DataFrame:
    """Epochs none of whose channels is over its learned limit."""
    over = traces.join(model, ["recording", "channel"]).where(P.peak_to_peak(F.col("x")) > F.col("threshold") * (1 + 1e-12)).select(*KEYS).distinct()
    return traces.join(over, list(KEYS), "left_anti")


def fit_ssp(traces: DataFrame, channels: Sequence[str], components: int = 1) -> np.ndarray:
    """Projector that takes out the strongest spatial directions of these epochs: their products are summed on executors."""
    n = len(channels)

    def run(batches):
        total = np.zeros((n, n))
        for pdf in batches:
            for m in pdf["m"]:
                x = np.nan_to_num(np.stack([np.asarray(c, dtype=float) for c in m]))
                x = x - x.mean(axis=1, keepdims=True)
                total += x @ x.T
        yield pd.DataFrame({"place": np.arange(n * n), "v": total.ravel()})

    sums = channel_matrix(traces, channels).select("m").mapInPandas(run, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
    c = np.zeros(n * n)
    for r in sums:
        c[r["place"]] = r["v"]
    top = np.linalg.eigh(c.reshape(n, n))[1][:, n - components :]
    return np.eye(n) - top @ top.T


def apply_projector(traces: DataFrame, channels: Sequence[str], projector: np.ndarray) -> DataFrame:
    """Channels of each epoch through the projector."""
    p = np.asarray(projector, dtype=float)

    @F.pandas_udf("array<array<double>>")
    def run(m: pd.Series) -> pd.Series:
        return pd.Series([(p @ np.stack([np.asarray(c, dtype=float) for c in e])).tolist() for e in m])

    made = channel_matrix(traces, channels).withColumn("m", run("m"))
    names = F.array(*(F.lit(c) for c in channels))
    t0 = traces.groupBy(*KEYS).agg(F.first("t0").alias("t0"))
    cells = made.select(*KEYS, "sfreq", F.explode(F.arrays_zip(names.alias("channel"), F.col("m").alias("x"))).alias("c")).select(*KEYS, "sfreq", "c.*")
    rest = traces.where(~F.col("channel").isin(list(channels)))
    return cells.join(t0, list(KEYS)).select(*traces.columns).unionByName(rest)


def resample_epochs(traces: DataFrame, up: int, down: int) -> DataFrame:
    """Signals at up / down of their rate, through a windowed-sinc filter below the lower Nyquist rate (polyphase)."""
    g = np.gcd(up, down)
    up, down = up // g, down // g
    half = 10 * max(up, down)
    k = np.arange(-half, half + 1)
    cutoff = 1.0 / max(up, down)
    taps = cutoff * np.sinc(cutoff * k) * np.kaiser(len(k), 5.0)
    taps = taps / taps.sum() * up

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        out = []
        for v in x:
            v = np.asarray(v, dtype=float)
            wide = np.zeros(len(v) * up)
            wide[::up] = v
            out.append(np.convolve(wide, taps)[half : half + len(wide)][::down])
        return pd.Series(out)

    return traces.withColumns({"x": run("x"), "sfreq": F.col("sfreq") * up / down})


# The chain -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Stage:
    """A step: what it does to (traces, settings, tables), the settings it reads, and whether it takes a decision."""

    name: str
    run: Callable[[DataFrame, Mapping, Mapping], DataFrame]
    settings: tuple[str, ...] = ()
    review: bool = False


def _channels(t: DataFrame, s: Mapping, _) -> DataFrame:
    c = s.get("channels", {})
    return P.prepare_channels(t, c.get("rename"), {k: tuple(v) for k, v in c.get("bipolar", {}).items()}, c.get("drop", ()))


def _epoch(t: DataFrame, s: Mapping, tables: Mapping) -> DataFrame:
    e = s.get("epochs")
    if e is None:
        return t
    if "events" not in tables:
        raise CleaningError("epochs need a table of events (recording, i, label)")
    return cut_traces(t, tables["events"], e["tmin"], e["tmax"])


def _artifact(t: DataFrame, s: Mapping, _) -> DataFrame:
    a = s.get("artifact", {})
    if a.get("method") == "regression":
        return P.regress_channel(t, a["reference"])
    if a.get("method") == "ssp":
        return apply_projector(t, a["channels"], fit_ssp(t, a["channels"], a.get("components", 1)))
    return t


def _reject(t: DataFrame, s: Mapping, _) -> DataFrame:
    r = s.get("rejection", {})
    if r.get("learned"):
        t = apply_rejection(t, fit_rejection(t, r.get("candidates", 10), r.get("folds", 5)))
    return P.reject_epochs(t, r.get("reject"), r.get("flat")) if "reject" in r or "flat" in r else t


def _interpolate(t: DataFrame, s: Mapping, _) -> DataFrame:
    i = s.get("interpolate")
    return P.interpolate_channels(t, P.interpolation_weights(i["places"], i["bad"])) if i else t


def _reference(t: DataFrame, s: Mapping, _) -> DataFrame:
    r = s.get("reference")
    return t if r is None else P.reference_epochs(t, None if r == "average" else r)


def _resample(t: DataFrame, s: Mapping, _) -> DataFrame:
    r = s.get("sampling", {})
    if "decimate" in r:
        return P.decimate_epochs(t, r["decimate"])
    return resample_epochs(t, r["up"], r["down"]) if "up" in r else t


def _baseline(t: DataFrame, s: Mapping, _) -> DataFrame:
    b = s.get("baseline")
    return t if b is None else P.baseline_epochs(t, b["first"], b["samples"])


STAGES: tuple[Stage, ...] = (
    Stage("channels", _channels, ("channels",)),
    Stage("crop-raw", lambda t, s, _: crop_raw(t, **s["crop"]) if "crop" in s else t, ("crop",)),
    Stage("review-raw", lambda t, s, tables: apply_raw_review(t, tables.get("bads", ()), tables.get("spans")), (), True),
    Stage("repair", lambda t, s, _: P.repair_interval(t, **s["repair"]) if "repair" in s else t, ("repair",)),
    Stage("notch", lambda t, s, _: P.notch_traces(t, **s["notch"]) if "notch" in s else t, ("notch",)),
    Stage("filter", lambda t, s, _: P.filter_traces(t, **s["filter"]) if "filter" in s else t, ("filter",)),
    Stage("artifact", _artifact, ("artifact",)),
    Stage("epoch", _epoch, ("epochs",)),
    Stage("reject", _reject, ("rejection",)),
    Stage("review-epochs", lambda t, s, tables: P.review_epochs(t, tables["dropped"]) if "dropped" in tables else t, (), True),
    Stage("interpolate", _interpolate, ("interpolate",)),
    Stage("reference", _reference, ("reference",)),
    Stage("resample", _resample, ("sampling",)),
    Stage("crop-epochs", lambda t, s, _: P.crop_epochs(t, **s["window"]) if "window" in s else t, ("window",)),
    Stage("detrend", lambda t, s, _: P.detrend_epochs(t, s["detrend"]) if "detrend" in s else t, ("detrend",)),
    Stage("baseline", _baseline, ("baseline",)),
)
NAMES = tuple(s.name for s in STAGES)
SETTINGS = frozenset(k for s in STAGES for k in s.settings)


def load_config(source: Mapping | str | Path) -> dict:
    """A validated cleaning recipe from a mapping or a TOML file; every problem is named in one error."""
    made = dict(source) if isinstance(source, Mapping) else tomllib.loads(Path(source).read_text())
    problems = [f"unknown key {k!r}" for k in made if k not in SETTINGS]
    if "epochs" in made and not made["epochs"].get("tmin", 1) < made["epochs"].get("tmax", 0):
        problems.append("epochs: tmin and tmax are needed, tmin below tmax")
    f = made.get("filter")
    if f is not None and not {"sfreq", "fmin", "fmax"} <= set(f):
        problems.append("filter: sfreq, fmin and fmax are needed")
    elif f is not None and not 0 <= f["fmin"] < f["fmax"] <= f["sfreq"] / 2:
        problems.append("filter: its band does not lie below half the rate")
    if made.get("artifact", {}).get("method", "ssp") not in ("ssp", "regression"):
        problems.append(f"artifact: unknown method {made['artifact']['method']!r}")
    if made.get("detrend", "linear") not in ("linear", "constant"):
        problems.append(f"detrend: unknown method {made['detrend']!r}")
    if problems:
        raise CleaningError("\n".join(problems))
    return made


load_recipe = load_config


def execute(stage: str, traces: DataFrame, settings: Mapping, tables: Mapping | None = None) -> DataFrame:
    """One stage."""
    return STAGES[NAMES.index(stage)].run(traces, settings, tables or {})


def preprocess(traces: DataFrame, settings: Mapping | str | Path, tables: Mapping | None = None) -> DataFrame:
    """All stages in their order, as one plan; tables: events, bads, spans, dropped."""
    made = load_config(settings)
    for s in STAGES:
        traces = s.run(traces, made, tables or {})
    return traces


# Stage by stage ---------------------------------------------------------------------------------


@dataclass
class Workflow:
    """A recipe over one source, whose stages' rows are kept under a folder of the shared file system."""

    spark: SparkSession
    settings: dict
    root: str
    source: DataFrame
    source_id: str
    tables: dict = field(default_factory=dict)
    decisions: dict = field(default_factory=dict)


def open_workflow(source: DataFrame, settings: Mapping | str | Path, root: str, source_id: str, tables: Mapping | None = None, decisions: Mapping | None = None) -> Workflow:
    """decisions: review stage -> what was decided, as JSON-able values; a review stage without one takes it that nothing is dropped."""
    return Workflow(source.sparkSession, load_config(settings), root.rstrip("/"), source, source_id, dict(tables or {}), dict(decisions or {}))


def stage_identities(workflow: Workflow) -> dict[str, str]:
    """Stage -> hash of its settings, its decision and the identity before it."""
    out, last = {}, identity({"source": workflow.source_id})
    for s in STAGES:
        own = {"stage": s.name, "after": last, "settings": {k: workflow.settings[k] for k in s.settings if k in workflow.settings}}
        last = out[s.name] = identity(own | ({"decision": workflow.decisions.get(s.name)} if s.review else {}))
    return out


def _path(workflow: Workflow, stage: str) -> str:
    return f"{workflow.root}/{stage}/{stage_identities(workflow)[stage]}"


def _files(workflow: Workflow, path: str):
    p = workflow.spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(workflow.spark._jsc.hadoopConfiguration()), p


def _done(workflow: Workflow, path: str) -> bool:
    fs, p = _files(workflow, f"{path}/_SUCCESS")
    return bool(fs.exists(p))


def list_steps(workflow: Workflow) -> list[tuple[str, str]]:
    """(stage, state) in order: done, stale (another identity's rows are there) or pending."""
    out = []
    for s in NAMES:
        path = _path(workflow, s)
        fs, p = _files(workflow, path.rsplit("/", 1)[0])
        out.append((s, "done" if _done(workflow, path) else "stale" if fs.exists(p) and len(fs.listStatus(p)) else "pending"))
    return out


def read_checkpoint(workflow: Workflow, stage: str) -> DataFrame:
    path = _path(workflow, stage)
    if not _done(workflow, path):
        raise CleaningError(f"{stage} has not run with these settings")
    return workflow.spark.read.parquet(path)


def publish_checkpoint(workflow: Workflow, stage: str, rows: DataFrame) -> DataFrame:
    """rows written under the stage's identity; Spark's commit makes them visible at once."""
    path = _path(workflow, stage)
    rows.write.mode("overwrite").parquet(path)
    return workflow.spark.read.schema(rows.schema).parquet(path)


def run_step(workflow: Workflow, stage: str, overwrite: bool = False) -> DataFrame:
    """One stage on the stored rows of the stage before."""
    at = NAMES.index(stage)
    if not overwrite and _done(workflow, _path(workflow, stage)):
        return read_checkpoint(workflow, stage)
    before = workflow.source if at == 0 else read_checkpoint(workflow, NAMES[at - 1])
    return publish_checkpoint(workflow, stage, STAGES[at].run(before, workflow.settings, workflow.tables))


def run_next(workflow: Workflow) -> str | None:
    """The first stage that is not done, by name; None if all are."""
    for stage, state in list_steps(workflow):
        if state != "done":
            run_step(workflow, stage)
            return stage
    return None


def run_until(workflow: Workflow, stage: str = NAMES[-1], on_step: Callable[[str], None] | None = None) -> DataFrame:
    """All stages up to one, each from its stored rows where they are there."""
    out = workflow.source
    for s in NAMES[: NAMES.index(stage) + 1]:
        out = run_step(workflow, s)
        if on_step:
            on_step(s)
    return out


def reset_from(workflow: Workflow, stage: str) -> list[str]:
    """Remove the stored rows of a stage and of all after it; their names."""
    gone = []
    for s in NAMES[NAMES.index(stage) :]:
        fs, p = _files(workflow, f"{workflow.root}/{s}")
        if fs.exists(p):
            fs.delete(p, True)
            gone.append(s)
    return gone


def write_result(workflow: Workflow, output: str, overwrite: bool = False) -> None:
    """The last stage's rows by recording, with the recipe and the identities beside them as one JSON text."""
    rows = read_checkpoint(workflow, NAMES[-1])
    rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("recording").parquet(f"{output}/epochs")
    text = json.dumps({"settings": workflow.settings, "source": workflow.source_id, "stages": stage_identities(workflow), "decisions": workflow.decisions}, sort_keys=True)
    workflow.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/recipe")
