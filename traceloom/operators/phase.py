"""Phase consistency over trials and phase-amplitude coupling.

A complex trace is one row: keys, channel, sfreq and the arrays re and im. Trials
meet per time point, so samples are aggregated to sums of unit vectors before
they are shuffled; coupling joins rows, not samples.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions.dims import Window
from traceloom.functions.numeric import bh_adjust, blank, divide
from traceloom.operators.spatial import aggregate_space

KEYS = ("recording", "epoch", "event")


def complex_samples(signals: DataFrame, windows: Sequence[Window]) -> DataFrame:
    """Rows of samples inside each window: i, re, im, a (modulus); all null where one part is not finite."""
    z = F.posexplode(F.arrays_zip("re", "im")).alias("i", "z")
    rows = signals.select(*KEYS, "channel", "sfreq", z)
    t = F.col("i") / F.col("sfreq")
    names = F.filter(F.array(*(F.when(w.holds(t), F.lit(w.name)) for w in windows)), lambda n: n.isNotNull())
    ok = blank("z.re").isNotNull() & blank("z.im").isNotNull()
    rows = rows.select(*KEYS, "channel", "sfreq", "i", F.explode(names).alias("window"), F.when(ok, F.col("z.re")).alias("re"), F.when(ok, F.col("z.im")).alias("im"))
    return rows.withColumn("a", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")))


def _consistency(signals: DataFrame, windows: Sequence[Window], measure: str, trials: str | None, groups, include_global: bool, least: int) -> DataFrame:
    if least < 2:
        raise ValueError("at least two trials must be asked for")
    group = F.lit("all") if trials is None else F.col(trials)
    rows = complex_samples(signals, windows).withColumn("trial_group", group)
    # A sample of amplitude zero has no phase.
    c, s = divide("re", "a"), divide("im", "a")
    per_time = rows.groupBy("trial_group", "channel", "window", "i").agg(F.count(c).alias("n"), F.sum(c).alias("c"), F.sum(s).alias("s"), F.count("*").alias("rows"))
    square = F.col("c") * F.col("c") + F.col("s") * F.col("s")
    n = F.col("n").cast("double")
    value = F.sqrt(square) / n if measure == "itpc" else divide(square - n, n * (n - 1))
    cells = per_time.withColumn("v", F.when(n >= least, value)).groupBy("trial_group", "channel", "window").agg(
        F.avg("v").alias("value"), (F.sum("n") / F.sum("rows")).alias("coverage"), (F.max("n") < least).alias("insufficient_trials")
    )
    cells = cells.withColumn("measure", F.lit(measure))
    return aggregate_space(cells, ["trial_group", "window", "measure"], groups, include_global, flags=("insufficient_trials",))


def itpc(signals: DataFrame, windows: Sequence[Window], trials: str | None = None, groups: Mapping[str, Sequence[str]] | None = None, include_global: bool = True, least: int = 2) -> DataFrame:
    """Mean over time of the modulus of the trials' mean unit vector."""
    return _consistency(signals, windows, "itpc", trials, groups, include_global, least)


def ppc(signals: DataFrame, windows: Sequence[Window], trials: str | None = None, groups: Mapping[str, Sequence[str]] | None = None, include_global: bool = True, least: int = 2) -> DataFrame:
    """Mean over time of the pairwise phase consistency (|sum|^2 - n) / (n (n - 1))."""
    return _consistency(signals, windows, "ppc", trials, groups, include_global, least)


def paired(slow: DataFrame, fast: DataFrame, windows: Sequence[Window]) -> DataFrame:
    """Rows of unit phases (c, s) of the slow signal and moduli a of the fast one, joined by row and channel."""
    f = fast.select(*KEYS, "channel", F.transform(F.arrays_zip("re", "im"), lambda z: F.sqrt(z["re"] * z["re"] + z["im"] * z["im"])).alias("a"))
    modulus = lambda z: F.sqrt(z["re"] * z["re"] + z["im"] * z["im"])
    s = slow.select(
        *KEYS, "channel", "sfreq",
        F.transform(F.arrays_zip("re", "im"), lambda z: F.struct(divide(z["re"], modulus(z)).alias("c"), divide(z["im"], modulus(z)).alias("s"))).alias("u"),
    )
    both = s.join(f, [*KEYS, "channel"])
    parts = []
    for w in windows:
        lo, n = w.bounds(F.lit(0.0), F.col("sfreq"), F.size("u"))
        parts.append(F.struct(F.lit(w.name).alias("window"), F.slice("u", lo + 1, n).alias("u"), F.slice("a", lo + 1, n).alias("a")))
    return both.select(*KEYS, "channel", F.explode(F.array(*parts)).alias("_p")).select(*KEYS, "channel", "_p.*")


def _length(u: Column, a: Column, shift: Column, normalize: bool) -> Column:
    """Mean vector length of a with the phases moved around by shift."""
    n = F.size(a)
    s = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.struct(*(F.lit(0.0).alias(x) for x in ("c", "s", "a", "n"))),
        lambda acc, i: _add(acc, F.get(u, F.pmod(i + shift, n)), F.get(a, i)),
    )
    return F.sqrt(s["c"] * s["c"] + s["s"] * s["s"]), F.when(s["a"] > 0, s["a"]) if normalize else F.when(s["n"] > 0, s["n"])


def _add(acc: Column, u: Column, a: Column) -> Column:
    ok = blank(a).isNotNull() & blank(u["c"]).isNotNull() & blank(u["s"]).isNotNull()
    plus = lambda name, v: (acc[name] + F.when(ok, v).otherwise(0.0)).alias(name)
    return F.struct(plus("c", a * u["c"]), plus("s", a * u["s"]), plus("a", a), plus("n", F.lit(1.0)))


def check_bands(slow: tuple[float, float], fast: tuple[float, float], allow_overlap: bool = False) -> None:
    """Raise unless the phase band lies below the amplitude band."""
    if sum(slow) >= sum(fast):
        raise ValueError("the phase band must be the slower one")
    if slow[1] > fast[0] and not allow_overlap:
        raise ValueError("phase and amplitude bands overlap")


def pac(slow: DataFrame, fast: DataFrame, windows: Sequence[Window], normalize: bool = True, groups=None, include_global: bool = True) -> DataFrame:
    """Modulus of the amplitude-weighted phase sum, by the amplitudes' sum or the number of samples."""
    rows = paired(slow, fast, windows)
    top, bottom = _length(F.col("u"), F.col("a"), F.lit(0), normalize)
    share = F.size(F.filter("a", lambda v: blank(v).isNotNull())) / F.size("a")
    cells = rows.select(*KEYS, "channel", "window", top.alias("top"), bottom.alias("bottom"), share.alias("coverage"))
    cells = cells.select(*KEYS, "channel", "window", F.lit("pac").alias("measure"), divide("top", "bottom").alias("value"), "coverage")
    return aggregate_space(cells, [*KEYS, "window", "measure"], groups, include_global)


def surrogate_shift(draw: Column, n: Column, least: int, seed: int) -> Column:
    """A shift from `least` to n - least, by draw number and seed alone."""
    mixed = F.pmod(draw * 2654435761 + F.lit(seed * 40503 + 12345), F.lit(4294967296))
    return (F.lit(least) + F.pmod(mixed, n - 2 * least + 1)).cast("int")


def pac_surrogates(
    slow: DataFrame, fast: DataFrame, windows: Sequence[Window], draws: int = 200, least_shift: int = 6, seed: int = 0, correction: str = "fdr",
    normalize: bool = True, groups=None, include_global: bool = True,
) -> DataFrame:
    """Coupling against circular shifts of the phase: value, null_mean, null_std, corrected, z, p, p_adjusted.

    Draws are numbers that each task makes next to its rows; p is the upper tail
    with ties within 100 machine epsilons; adjustments are by row.
    """
    if correction not in ("none", "fdr", "bonferroni", "maxstat"):
        raise ValueError(f"unknown correction {correction!r}")
    if draws < 2:
        raise ValueError("at least two draws are needed")
    rows = paired(slow, fast, windows).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    shift = F.when(F.col("draw") == 0, F.lit(0)).otherwise(surrogate_shift(F.col("draw").cast("bigint"), F.size("a"), least_shift, seed))
    top, bottom = _length(F.col("u"), F.col("a"), F.col("shift"), normalize)
    rows = rows.withColumn("shift", shift).select(*KEYS, "channel", "window", "draw", top.alias("top"), bottom.alias("bottom"))
    cells = rows.select(*KEYS, "channel", "window", "draw", divide("top", "bottom").alias("value"), F.lit(1.0).alias("coverage"))
    units = aggregate_space(cells, [*KEYS, "window", "draw"], groups, include_global)
    own = [*KEYS, "window", "space", "space_kind"]
    observed = units.where("draw = 0").select(*own, F.col("value").alias("observed"))
    null = units.where("draw > 0").join(observed, own)
    tie = F.col("value") >= F.col("observed") - 100 * 2.220446049250313e-16 * F.abs("observed")
    found = null.groupBy(*own).agg(F.first("observed").alias("value"), F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_std"), ((F.count_if(tie) + 1) / F.lit(draws + 1.0)).alias("p"))
    found = found.withColumns({"corrected": F.col("value") - F.col("null_mean"), "z": divide(F.col("value") - F.col("null_mean"), F.col("null_std")), "degenerate_null": F.col("null_std") == 0})
    if correction == "fdr":
        return bh_adjust(found, "p", "p_adjusted", list(KEYS))
    if correction == "bonferroni":
        per = units.where("draw = 0").groupBy(*KEYS).agg(F.count("*").alias("m"))
        return found.join(per, list(KEYS)).withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p") * F.col("m"))).drop("m")
    if correction == "maxstat":
        tops = units.where("draw > 0").groupBy(*KEYS, "draw").agg(F.max("value").alias("top"))
        over = F.col("top") >= F.col("observed") - 100 * 2.220446049250313e-16 * F.abs("observed")
        adjusted = observed.join(tops, list(KEYS)).groupBy(*own).agg(((F.count_if(over) + 1) / F.lit(draws + 1.0)).alias("p_adjusted"))
        return found.join(adjusted, own)
    return found.withColumn("p_adjusted", F.col("p"))
