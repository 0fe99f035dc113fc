"""Connectivity of channel pairs and graph measures of pair tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.dims import Band, Window
from traceloom.functions.numeric import blank, divide, fisher_z, safe_pearson

KEYS = ("recording", "epoch", "event")
METHODS = ("coh", "imcoh", "plv", "ciplv", "ppc", "pli", "wpli", "wpli2_debiased")


def node_signals(signals: DataFrame, groups: dict[str, Sequence[str]] | None) -> DataFrame:
    """Signals by node: the channel, or the mean complex signal of each region's channels."""
    if not groups:
        return signals.select(*KEYS, F.col("channel").alias("node"), "sfreq", "re", "im")
    member = F.filter(F.array(*(F.when(F.col("channel").isin(list(c)), F.lit(g)) for g, c in groups.items())), lambda x: x.isNotNull())
    z = F.posexplode(F.arrays_zip("re", "im")).alias("i", "z")
    rows = signals.select(*KEYS, "sfreq", F.explode(member).alias("node"), "re", "im").select(*KEYS, "sfreq", "node", z)
    mean = rows.groupBy(*KEYS, "sfreq", "node", "i").agg(F.avg("z.re").alias("re"), F.avg("z.im").alias("im"))
    packed = mean.groupBy(*KEYS, "sfreq", "node").agg(F.array_sort(F.collect_list(F.struct("i", "re", "im"))).alias("s"))
    return packed.select(*KEYS, "node", "sfreq", F.col("s.re").alias("re"), F.col("s.im").alias("im"))


def pairs_of(signals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of node pairs (a before b) of the same row: a, b and the arrays of both."""
    left = signals.select(*keys, F.col("node").alias("a"), F.col("re").alias("re_a"), F.col("im").alias("im_a"), "sfreq")
    right = signals.select(*keys, F.col("node").alias("b"), F.col("re").alias("re_b"), F.col("im").alias("im_b"))
    return left.join(right, list(keys)).where("a < b")


def envelope_correlation(
    signals: DataFrame, windows: Sequence[Window], trials: str | None = None, groups=None, orthogonalize: bool = True, absolute: bool = True
) -> DataFrame:
    """Mean over trials, on Fisher's scale, of the correlation of two nodes' envelopes.

    Orthogonalised, each node's part at right angles to the other is correlated
    with the other's envelope, and both directions are averaged (Hipp et al., 2012).
    Row: trial_group, window, a, b, value.
    """
    rows = pairs_of(node_signals(signals, groups)).withColumn("trial_group", F.lit("all") if trials is None else F.col(trials))
    z = F.posexplode(F.arrays_zip("re_a", "im_a", "re_b", "im_b")).alias("i", "z")
    cells = rows.select(*dict.fromkeys([*KEYS, "trial_group"]), "a", "b", "sfreq", z)
    t = F.col("i") / F.col("sfreq")
    names = F.filter(F.array(*(F.when(w.holds(t), F.lit(w.name)) for w in windows)), lambda n: n.isNotNull())
    cells = cells.withColumn("window", F.explode(names)).select("*", "z.*")
    ma, mb = F.sqrt(F.expr("re_a * re_a + im_a * im_a")), F.sqrt(F.expr("re_b * re_b + im_b * im_b"))
    cells = cells.withColumns({"ma": ma, "mb": mb, "cross": F.expr("im_a * re_b - re_a * im_b")})
    by = [*dict.fromkeys([*KEYS, "trial_group"]), "window", "a", "b"]
    if orthogonalize:
        cells = cells.withColumns({"oa": F.abs(divide("cross", "mb")), "ob": F.abs(divide("cross", "ma"))})
        one = lambda x, y: F.coalesce(safe_pearson(x, y), F.when(F.max(y) > F.min(y), 0.0))
        ra, rb = one("oa", "mb"), one("ob", "ma")
        r = (F.abs(ra) + F.abs(rb)) / 2 if absolute else (ra + rb) / 2
    else:
        r = safe_pearson("ma", "mb")
    per_trial = cells.groupBy(*by).agg(r.alias("r"))
    return per_trial.groupBy("trial_group", "window", "a", "b").agg(F.tanh(F.avg(fisher_z("r"))).alias("value"))


def _formulas() -> dict[str, Column]:
    """Method -> value at one frequency, from sums over trials of the cross-spectrum's parts."""
    c = F.col
    n = c("n")
    power = F.sqrt(c("xx") * c("yy"))
    u2 = c("u_re") * c("u_re") + c("u_im") * c("u_im")
    return {
        "coh": divide(F.sqrt(c("re") * c("re") + c("im") * c("im")), power),
        "imcoh": divide(F.abs("im"), power),
        "plv": F.sqrt(u2) / n,
        "ciplv": divide(F.abs("u_im") / n, F.sqrt(1 - F.pow(c("u_re") / n, 2))),
        "ppc": divide(u2 - n, n * (n - 1)),
        "pli": F.abs("sign") / n,
        "wpli": divide(F.abs("im"), c("abs_im")),
        "wpli2_debiased": divide(c("im") * c("im") - c("im2"), c("abs_im") * c("abs_im") - c("im2")),
    }


def spectral_connectivity(
    spectra: DataFrame, freqs: Sequence[float], methods: Sequence[str], bands: Sequence[Band], trials: str | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Band means of connectivity over trials: trial_group, a, b, band, method, value.

    spectra: keys, node, sfreq and the arrays re, im over freqs. All methods come
    from one aggregation of cross-spectra; bands are half open.
    """
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}")
    rows = pairs_of(spectra, keys).withColumn("trial_group", F.lit("all") if trials is None else F.col(trials))
    cells = rows.select("trial_group", "a", "b", F.posexplode(F.arrays_zip("re_a", "im_a", "re_b", "im_b")).alias("bin", "z")).select("trial_group", "a", "b", "bin", "z.*")
    re, im = F.expr("re_a * re_b + im_a * im_b"), F.expr("im_a * re_b - re_a * im_b")
    cells = cells.withColumns({"re": re, "im": im, "xx": F.expr("re_a * re_a + im_a * im_a"), "yy": F.expr("re_b * re_b + im_b * im_b")})
    cells = cells.withColumn("m", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    sums = cells.groupBy("trial_group", "a", "b", "bin").agg(
        F.count("*").cast("double").alias("n"), *(F.sum(x).alias(x) for x in ("re", "im", "xx", "yy")), F.sum(F.abs("im")).alias("abs_im"),
        F.sum(F.col("im") * F.col("im")).alias("im2"), F.sum(F.signum("im")).alias("sign"), F.sum(divide("re", "m")).alias("u_re"), F.sum(divide("im", "m")).alias("u_im"),
    ).where("n >= 2")
    made = _formulas()
    f = F.get(F.array(*(F.lit(float(x)) for x in freqs)), F.col("bin"))
    band = F.filter(F.array(*(F.when(b.picks(f), F.lit(b.name)) for b in bands)), lambda x: x.isNotNull())
    per_bin = sums.select("trial_group", "a", "b", F.explode(band).alias("band"), *(made[m].alias(m) for m in methods))
    means = per_bin.groupBy("trial_group", "a", "b", "band").agg(*(F.avg(blank(m)).alias(m) for m in methods))
    cell = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("value")) for m in methods)))
    return means.select("trial_group", "a", "b", "band", cell.alias("c")).select("trial_group", "a", "b", "band", "c.*")


def check_pairs(edges: DataFrame, keys: Sequence[str] = ("graph",)) -> None:
    """Raise if a graph has a pair twice or lacks one of its nodes' pairs."""
    nodes = edges.select(*keys, F.explode(F.array("a", "b")).alias("node")).groupBy(*keys).agg(F.count_distinct("node").alias("n"))
    sizes = edges.groupBy(*keys).agg(F.count("*").alias("m"), F.count_distinct(F.struct(F.least("a", "b"), F.greatest("a", "b"))).alias("k"))
    bad = sizes.join(nodes, list(keys)).where("m <> k or 2 * k <> n * (n - 1)").limit(3).collect()
    if bad:
        raise ValueError(f"incomplete or repeated pairs: {bad}")


def clustering_coefficient(edges: DataFrame, threshold: float) -> DataFrame:
    """(graph, value): mean over all nodes of the share of a node's neighbour pairs that are linked.

    Edges with |w| over the threshold count; a node with fewer than two neighbours
    counts as 0. Triangles are found by joining ordered edges, each once.
    """
    nodes = edges.select("graph", F.explode(F.array("a", "b")).alias("node")).distinct()
    e = edges.where(F.abs("w") > threshold).select("graph", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = e.select("graph", F.col("a").alias("b"), F.col("b").alias("c"))
    third = e.select("graph", "a", F.col("b").alias("c"))
    triangles = e.join(second, ["graph", "b"]).join(third, ["graph", "a", "c"]).select("graph", F.explode(F.array("a", "b", "c")).alias("node"))
    t = triangles.groupBy("graph", "node").agg(F.count("*").alias("t"))
    k = e.select("graph", F.explode(F.array("a", "b")).alias("node")).groupBy("graph", "node").agg(F.count("*").alias("k"))
    both = nodes.join(k, ["graph", "node"], "left").join(t, ["graph", "node"], "left")
    share = F.when(F.col("k") >= 2, 2 * F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0)
    return both.groupBy("graph").agg(F.avg(share).alias("value"))


def global_efficiency(edges: DataFrame) -> DataFrame:
    """(graph, value): mean inverse length of the shortest paths, an edge being 1 / |w| long.

    A graph's nodes are channels, so one graph fits a task; graphs are spread.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*rows["a"], *rows["b"]})
        at = {n: i for i, n in enumerate(nodes)}
        d = np.full((len(nodes), len(nodes)), np.inf)
        np.fill_diagonal(d, 0.0)
        w = rows["w"].abs().to_numpy()
        length = np.divide(1.0, w, out=np.full(len(w), np.inf), where=w > 0)
        for a, b, x in zip(rows["a"], rows["b"], length):
            d[at[a], at[b]] = d[at[b], at[a]] = min(x, d[at[a], at[b]])
        for k in range(len(nodes)):
            d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1, :])
        off = ~np.eye(len(nodes), dtype=bool)
        value = float(np.mean(1 / d[off])) if off.any() else float("nan")
        return pd.DataFrame({"graph": [rows["graph"].iloc[0]], "value": [value]})

    return edges.select("graph", "a", "b", "w").groupBy("graph").applyInPandas(solve, f"graph {dict(edges.dtypes)['graph']}, value double")
