"""Microstates and common spatial patterns over channels of epochs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.numeric import divide, pinned
from traceloom.sources.scratch import cut

KEYS = ("recording", "epoch", "event")


def channel_matrix(traces: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row for each epoch: m, the channels' arrays in the given order; epochs that lack one go."""
    order = F.create_map(*(F.lit(x) for i, c in enumerate(channels) for x in (c, i)))
    rows = traces.where(F.col("channel").isin(list(channels))).groupBy(*KEYS, "sfreq").agg(F.array_sort(F.collect_list(F.struct(F.element_at(order, F.col("channel")).alias("k"), "x"))).alias("s"))
    return rows.where(F.size("s") == len(channels)).select(*KEYS, "sfreq", F.col("s.x").alias("m"))


def sparse_channel_matrix(traces: DataFrame, channels: Sequence[str]) -> DataFrame:
    """As channel_matrix, but no epoch goes: what a channel lacks is null, and of its several rows the greatest sample counts.

    An epoch is as long as its longest trace, that of a channel that is not named included.
    """
    rows = traces.groupBy(*KEYS, "sfreq").agg(F.max(F.size("x")).alias("_n"), *(F.collect_list(F.when(F.col("channel") == c, F.col("x"))).alias(f"_c{k}") for k, c in enumerate(channels))).where("_n > 0")
    places = F.sequence(F.lit(0), F.col("_n") - 1)
    one = lambda own: F.transform(places, lambda i: F.array_max(F.transform(own, lambda x: F.get(x, i))))
    return pinned(rows, m=F.array(*(one(f"_c{k}") for k in range(len(channels))))).select(*KEYS, "sfreq", "m")


def label_samples(epochs: DataFrame, templates: np.ndarray) -> DataFrame:
    """epochs with states: for each sample the template of greatest |spatial correlation|, the first on a tie, and the last where a channel is null."""
    t = np.asarray(templates, dtype=float)
    t = t - t.mean(axis=1, keepdims=True)
    t = t / np.linalg.norm(t, axis=1, keepdims=True)
    # A sample's own norm is the same for all templates, so it does not matter here.
    places = F.sequence(F.lit(0), F.size(F.col("m")[0]) - 1)

    def best(i):
        scores = []
        for row in t:
            s = F.lit(0.0)
            for k, w in enumerate(row):
                s = s + F.get(F.col("m")[k], i) * float(w)
            scores.append(F.abs(s))
        top = F.greatest(*scores)
        out = F.lit(len(scores) - 1)
        for k in range(len(scores) - 2, -1, -1):
            out = F.when(scores[k] == top, F.lit(k)).otherwise(out)
        return out

    return epochs.withColumn("states", F.transform(places, best))


def smooth_states(states: np.ndarray, least: int) -> np.ndarray:
    """Runs shorter than `least` join a neighbour, the shortest first; of two neighbours the longer takes it."""
    runs: list[list[int]] = []
    for s in states.tolist():
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    while len(runs) > 1:
        k = min(range(len(runs)), key=lambda j: (runs[j][1], j))
        if runs[k][1] >= least:
            break
        left, right = (runs[k - 1] if k else None), (runs[k + 1] if k + 1 < len(runs) else None)
        to = left if right is None or left is not None and left[1] >= right[1] else right
        runs[k][0] = to[0]
        merged: list[list[int]] = []
        for s, n in runs:
            if merged and merged[-1][0] == s:
                merged[-1][1] += n
            else:
                merged.append([s, n])
        runs = merged
    return np.repeat([s for s, _ in runs], [n for _, n in runs])


def smooth_segments(labelled: DataFrame, least: int) -> DataFrame:
    @F.pandas_udf("array<int>")
    def run(states: pd.Series) -> pd.Series:
        return pd.Series([smooth_states(np.asarray(s), least) for s in states])

    return labelled.withColumn("states", run("states"))


def _summed(rows: DataFrame, column: str, width: int, make) -> np.ndarray:
    """Sum over all rows' arrays of make(matrix of a batch), a vector: one such vector leaves each task."""

    def run(batches):
        total = None
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            if len(x):
                total = make(x) if total is None else total + make(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "v"])

    table = rows.select(column).mapInArrow(run, "place bigint, v double").groupBy("place").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(table.num_rows)
    out[table["place"].to_numpy()] = table["v"].to_numpy()
    return out


def gfp_peaks(epochs: DataFrame, peaks_per_epoch: int = 400) -> DataFrame:
    """(map): channel maps at peaks of global field power, of an epoch the highest ones."""

    def peaks(batches):
        for pdf in batches:
            out = []
            for m in pdf["m"]:
                x = np.stack([np.asarray(c, dtype=float) for c in m])
                x = x - x.mean(axis=0)
                g = x.std(axis=0)
                top = np.flatnonzero((g[1:-1] > g[:-2]) & (g[1:-1] >= g[2:])) + 1
                top = top[np.argsort(-g[top], kind="stable")][:peaks_per_epoch]
                out += [row.tolist() for row in x[:, top].T]
            yield pd.DataFrame({"map": out})

    return epochs.select("m").mapInPandas(peaks, "map array<double>")


def fit_microstates(epochs: DataFrame, n_states: int = 4, peaks_per_epoch: int = 400, starts: int = 20, seed: int = 42, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Templates by polarity-blind modified k-means on maps at peaks of global field power, and the variance explained.

    All peaks count: each round, every task sums its maps' products by start and
    state, and the driver solves systems of the size of the channels. A start is
    settled when it explains no more than the round before.
    """
    maps = cut(gfp_peaks(epochs, peaks_per_epoch), "peaks")
    # The first maps of all starts: those of least hash, without replacement.
    first = np.array([r["map"] for r in maps.orderBy(F.xxhash64("map", F.lit(seed)), "map").limit(n_states * starts).collect()], dtype=float)
    if len(first) < n_states:
        raise ValueError("fewer peaks than states")
    starts, c = max(1, len(first) // n_states), first.shape[1]
    t = first[: starts * n_states].reshape(starts, n_states, c)
    t = t / np.maximum(np.linalg.norm(t, axis=2, keepdims=True), 1e-12)
    best, live, explained = t.copy(), np.arange(starts), np.full(starts, -1.0)
    for _ in range(rounds):
        own = t[live]

        def step(x, own=own):
            sums, hit = np.zeros((len(own), n_states, c, c)), np.zeros(len(own))
            for s, one in enumerate(own):
                score = (x @ one.T) ** 2
                of = score.argmax(axis=1)
                hit[s] = score.max(axis=1).sum()
                for k in range(n_states):
                    part = x[of == k]
                    sums[s, k] = part.T @ part
            return np.r_[sums.ravel(), hit, (x**2).sum()]

        found = _summed(maps, "map", c, step)
        now = found[-1 - len(live) : -1] / found[-1]
        sums = found[: -1 - len(live)].reshape(len(live), n_states, c, c)
        better = now > explained[live] + 1e-12
        best[live[better]], explained[live[better]] = own[better], now[better]
        for s, k in np.ndindex(len(live), n_states):
            if better[s] and sums[s, k].any():
                t[live[s], k] = np.linalg.eigh(sums[s, k])[1][:, -1]
        live = live[better]
        if not len(live):
            break
    top = int(explained.argmax())
    return best[top], float(explained[top])


def match_reference(templates: np.ndarray, reference: np.ndarray) -> list[int]:
    """Order of templates of the greatest total |correlation| with the reference maps, by a programme over sets of templates."""
    c = np.abs(np.corrcoef(templates, reference)[: len(templates), len(templates) :])
    states: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for j in range(len(reference)):
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (value, order) in states.items():
            for i in range(len(templates)):
                if not used >> i & 1:
                    new = (value + c[i, j], (*order, i))
                    if used | 1 << i not in after or new[0] > after[used | 1 << i][0]:
                        after[used | 1 << i] = new
        states = after
    return list(max(states.values())[1])


def state_runs(labelled: DataFrame) -> DataFrame:
    """(keys, sfreq, total, place, state, length): runs of equal states in order."""
    n = F.size("states")
    places = F.sequence(F.lit(0), n - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get("states", i) != F.get("states", i - 1)))
    rows = labelled.where(n > 0).withColumn("starts", starts)
    cells = F.transform("starts", lambda s, k: F.struct(k.alias("place"), F.get("states", s).alias("state"), (F.coalesce(F.get("starts", k + 1), n) - s).alias("length"), F.get("states", F.get("starts", k + 1)).alias("next")))
    return rows.select(*KEYS, "sfreq", n.alias("total"), F.explode(cells).alias("c")).select(*KEYS, "sfreq", "total", "c.*")


def microstate_summary(labelled: DataFrame, n_states: int) -> DataFrame:
    """(keys, state, coverage, duration, occurrence): share of samples, mean run in ms, runs a second.

    A state that never occurs has coverage and occurrence 0 and no duration.
    """
    runs = state_runs(labelled)
    own = [*KEYS, "sfreq", "total"]
    cells = runs.groupBy(*own).agg(*(f for k in range(n_states) for f in (F.sum(F.when(F.col("state") == k, F.col("length"))).alias(f"l{k}"), F.count_if(F.col("state") == k).alias(f"n{k}"))))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("state"), F.coalesce(F.col(f"l{k}"), F.lit(0)).alias("l"), F.col(f"n{k}").alias("n")) for k in range(n_states))))
    s = cells.select(*own, each.alias("c")).select(*own, "c.*")
    return s.select(
        *KEYS, "state", (F.col("l") / F.col("total")).alias("coverage"), (divide(F.col("l").cast("double"), F.col("n").cast("double")) * 1000 / F.col("sfreq")).alias("duration"),
        (F.col("n") / (F.col("total") / F.col("sfreq"))).alias("occurrence"),
    )


def microstate_transitions(labelled: DataFrame) -> DataFrame:
    """(keys, source, target, share): of a state's runs that are followed by another, the share that each follows."""
    pairs = state_runs(labelled).where("next is not null").groupBy(*KEYS, F.col("state").alias("source"), F.col("next").alias("target")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*KEYS, "source"))
    return pairs.withColumn("share", F.col("n") / total).drop("n")


# Common spatial patterns -----------------------------------------------------------------


#: Channels beyond which an epoch's products are one matrix product and no longer an expression for each pair.
WIDE = 12


def class_covariances(epochs: DataFrame, label: str, n_channels: int) -> dict:
    """Mean over epochs of trace-normalised channel covariances, by class: C x C sums leave the executors."""
    if n_channels > WIDE:
        return _wide_covariances(epochs, label, n_channels)
    pairs = [(i, j) for i in range(n_channels) for j in range(i, n_channels)]
    dot = lambda i, j: F.aggregate(F.zip_with(F.col("m")[i], F.col("m")[j], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = epochs.select(label, *(dot(i, j).alias(f"c{i}_{j}") for i, j in pairs))
    trace = sum((F.col(f"c{i}_{i}") for i in range(1, n_channels)), F.col("c0_0"))
    sums = rows.groupBy(label).agg(*(F.avg(divide(f"c{i}_{j}", trace)).alias(f"c{i}_{j}") for i, j in pairs)).collect()
    out = {}
    for r in sums:
        c = np.zeros((n_channels, n_channels))
        for i, j in pairs:
            c[i, j] = c[j, i] = r[f"c{i}_{j}"]
        out[r[label]] = c
    return out


def _wide_covariances(epochs: DataFrame, label: str, n_channels: int) -> dict:
    def run(batches):
        sums: dict = {}
        for pdf in batches:
            for k, m in zip(pdf["label"], pdf["m"]):
                x = np.stack([np.asarray(c, dtype=float) for c in m])
                c = x @ x.T
                if np.trace(c):
                    n, s = sums.get(k, (0, 0.0))
                    sums[k] = n + 1, s + c / np.trace(c)
        yield pd.DataFrame([(k, n, i, v) for k, (n, s) in sums.items() for i, v in enumerate(s.ravel().tolist())], columns=["label", "n", "place", "v"])

    kind = dict(epochs.dtypes)[label]
    parts = epochs.select(F.col(label).alias("label"), "m").mapInPandas(run, f"label {kind}, n bigint, place int, v double")
    out: dict = {}
    for r in parts.groupBy("label", "place").agg((F.sum("v") / F.sum("n")).alias("v")).collect():
        out.setdefault(r["label"], np.zeros(n_channels * n_channels))[r["place"]] = r["v"]
    return {k: v.reshape(n_channels, n_channels) for k, v in out.items()}


def csp_filters(covariances: dict, n_components: int = 4, regularization: float = 0.0) -> np.ndarray:
    """Filters from both ends of the generalised spectrum of two classes' covariances, in their joint range."""
    if len(covariances) < 2:
        raise ValueError("two classes are needed at least")
    if len(covariances) > 2:
        return _many_class_filters(covariances, n_components, regularization)
    a, b = (covariances[k] for k in sorted(covariances))
    if regularization:
        a, b = ((1 - regularization) * c + regularization * np.trace(c) / len(c) * np.eye(len(c)) for c in (a, b))
    values, vectors = np.linalg.eigh(a + b)
    live = values > values.max() * 1e-10
    white = vectors[:, live] / np.sqrt(values[live])
    own, rotation = np.linalg.eigh(white.T @ a @ white)
    w = (white @ rotation).T
    order = np.argsort(own)
    ends = [x for k in range((len(order) + 1) // 2) for x in ({order[-1 - k], order[k]} if order[-1 - k] != order[k] else {order[k]})]
    ordered = sorted(ends, key=lambda k: -abs(own[k] - 0.5))[:n_components]
    return w[ordered]


def _many_class_filters(covariances: dict, n_components: int, regularization: float, rounds: int = 200) -> np.ndarray:
    """Filters of several classes: the joint approximate diagonalisation of their whitened covariances by rotations
    (Cardoso and Souloumiac, 1996), ordered by how far a component's power spreads over the classes."""
    cs = [covariances[k] for k in sorted(covariances)]
    if regularization:
        cs = [(1 - regularization) * c + regularization * np.trace(c) / len(c) * np.eye(len(c)) for c in cs]
    values, vectors = np.linalg.eigh(sum(cs))
    live = values > values.max() * 1e-10
    white = vectors[:, live] / np.sqrt(values[live])
    m = np.stack([white.T @ c @ white for c in cs])
    n = m.shape[1]
    turn = np.eye(n)
    for _ in range(rounds):
        moved = 0.0
        for i in range(n - 1):
            for j in range(i + 1, n):
                h = np.stack([m[:, i, i] - m[:, j, j], 2 * m[:, i, j]])
                g = h @ h.T
                angle = 0.5 * np.arctan2(2 * g[0, 1], g[0, 0] - g[1, 1] + np.hypot(g[0, 0] - g[1, 1], 2 * g[0, 1]))
                if abs(angle) < 1e-10:
                    continue
                moved = max(moved, abs(angle))
                c, s = np.cos(angle), np.sin(angle)
                r = np.eye(n)
                r[[i, j], [i, j]], r[i, j], r[j, i] = c, -s, s
                m, turn = r.T @ m @ r, turn @ r
        if moved < 1e-8:
            break
    power = np.stack([x.diagonal() for x in m])
    spread = (power / power.sum(axis=0)).std(axis=0)
    return (white @ turn).T[np.argsort(-spread, kind="stable")[:n_components]]


def csp_features(epochs: DataFrame, filters: np.ndarray) -> DataFrame:
    """epochs with csp: log of each component's share of the filtered variance."""

    @F.pandas_udf("array<double>")
    def run(m: pd.Series) -> pd.Series:
        out = []
        for e in m:
            v = (filters @ np.stack([np.asarray(c, dtype=float) for c in e])).var(axis=1)
            out.append(np.log(v / v.sum()))
        return pd.Series(out)

    return epochs.withColumn("csp", run("m"))


def cross_fit_csp(epochs: DataFrame, label: str, fold: str, folds: Sequence, n_channels: int, n_components: int = 4) -> DataFrame:
    """csp features of every epoch by filters of the other folds' epochs."""
    out = None
    for k in folds:
        filters = csp_filters(class_covariances(epochs.where(F.col(fold) != k), label, n_channels), n_components)
        one = csp_features(epochs.where(F.col(fold) == k), filters)
        out = one if out is None else out.unionByName(one)
    return out


def covariance_features(epochs: DataFrame, shrinkage: float = 0.1) -> DataFrame:
    """epochs with cov: the shrunken covariance of each epoch's channels, rows one after the other."""

    @F.pandas_udf("array<double>")
    def run(m: pd.Series) -> pd.Series:
        out = []
        for e in m:
            c = np.cov(np.stack([np.asarray(x, dtype=float) for x in e]), bias=True)
            out.append(((1 - shrinkage) * c + shrinkage * np.trace(c) / len(c) * np.eye(len(c))).ravel())
        return pd.Series(out)

    return epochs.withColumn("cov", run("m"))


def _power(c: np.ndarray, f) -> np.ndarray:
    v, u = np.linalg.eigh(c)
    return (u * f(np.maximum(v, 1e-12))) @ u.T


def riemannian_mean(epochs: DataFrame, n_channels: int, rounds: int = 30) -> np.ndarray:
    """Geometric mean of all rows' covariances (column cov): each round, the tasks sum logs at the mean so far."""
    total = _summed(epochs, "cov", n_channels**2, lambda x: np.r_[x.sum(axis=0), len(x)])
    if not len(total):
        raise ValueError("no covariances")
    mean = (total[:-1] / total[-1]).reshape(n_channels, n_channels)
    for _ in range(rounds):
        half, back = _power(mean, np.sqrt), _power(mean, lambda v: 1 / np.sqrt(v))
        logs = lambda x, back=back: sum(_power(back @ c @ back, np.log) for c in x.reshape(-1, n_channels, n_channels)).ravel()
        step = (_summed(epochs, "cov", n_channels**2, logs) / total[-1]).reshape(n_channels, n_channels)
        mean = half @ _power_exp(step) @ half
        if np.linalg.norm(step) < 1e-8:
            break
    return mean


def tangent_features(epochs: DataFrame, n_channels: int, rounds: int = 30, mean: np.ndarray | None = None) -> DataFrame:
    """epochs with tangent: logs of covariances at the Riemannian mean of all of them, or at one that is given."""
    if mean is None:
        epochs = cut(epochs, "covariances")
        mean = riemannian_mean(epochs, n_channels, rounds)
    back = _power(mean, lambda v: 1 / np.sqrt(v))
    upper = np.triu_indices(n_channels)
    weight = np.where(upper[0] == upper[1], 1.0, np.sqrt(2.0))

    @F.pandas_udf("array<double>")
    def run(cov: pd.Series) -> pd.Series:
        return pd.Series([_power(back @ np.asarray(v, dtype=float).reshape(n_channels, n_channels) @ back, np.log)[upper] * weight for v in cov])

    return epochs.withColumn("tangent", run("cov"))


def _power_exp(c: np.ndarray) -> np.ndarray:
    v, u = np.linalg.eigh(c)
    return (u * np.exp(v)) @ u.T
