"""The feature table as a long fact: selection, binding, design joins, quality, reliability.

Cells: row keys, feature, value, coverage, support and flag columns. Metadata of
features is a small dimension that is joined by name. Guards are anti joins and
counts; they run only where validate is set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.numeric import blank, divide, exact_quantiles, is_finite

ROW = ("recording", "epoch", "event")
META = ("measure", "band", "space", "space_kind", "window", "normalization", "unit", "source")


class KeyMismatch(ValueError):
    """Keys that should match one to one do not."""


def guard_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    twice = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if twice:
        raise KeyMismatch(f"{what}: repeated keys, such as {[tuple(r)[:-1] for r in twice]}")


def guard_same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    for x, y, side in ((a, b, "left"), (b, a, "right")):
        alone = x.exceptAll(y).limit(3).collect()
        if alone:
            raise KeyMismatch(f"keys only on the {side}, such as {[tuple(r) for r in alone]}")


# Selection ------------------------------------------------------------------------


@dataclass(frozen=True)
class Selection:
    """Features by metadata: any of the values of a field, all fields; minus what exclude selects."""

    fields: Mapping[str, Sequence[str]] = field(default_factory=dict)
    exclude: "Selection | None" = None

    def condition(self) -> Column:
        unknown = set(self.fields) - set(META)
        if unknown:
            raise ValueError(f"unknown metadata fields {sorted(unknown)}")
        out = F.lit(True)
        for name, values in self.fields.items():
            out = out & F.coalesce(F.col(name).isin(list(values)), F.lit(False))
        if self.exclude is not None:
            if not self.exclude.fields and self.exclude.exclude is None:
                raise ValueError("an exclusion must restrict something")
            out = out & ~self.exclude.condition()
        return out


def select(cells: DataFrame, meta: DataFrame, selection: Selection, validate: bool = False) -> DataFrame:
    """Cells of the selected features; the names come from the metadata dimension."""
    own = meta.where(selection.condition()).select("feature")
    if validate and own.isEmpty():
        raise ValueError("no feature matches the selection")
    return cells.join(own, "feature", "left_semi")


def take(cells: DataFrame, rows: DataFrame, keys: Sequence[str] = ROW) -> DataFrame:
    """Cells of the given row keys."""
    return cells.join(rows.select(*keys).distinct(), list(keys), "left_semi")


def drop_missing(cells: DataFrame, max_fraction: float) -> DataFrame:
    """Cells of features whose share of missing values is at most max_fraction."""
    if not 0 <= max_fraction <= 1:
        raise ValueError("max_fraction must lie between 0 and 1")
    kept = cells.groupBy("feature").agg(F.avg((~is_finite("value")).cast("int")).alias("share")).where(F.col("share") <= max_fraction)
    return cells.join(kept, "feature", "left_semi")


def to_long(wide: DataFrame, features: Sequence[str], keys: Sequence[str] = ROW) -> DataFrame:
    return wide.unpivot(list(keys), list(features), "feature", "value")


def to_wide(cells: DataFrame, features: Sequence[str], keys: Sequence[str] = ROW) -> DataFrame:
    """One row for each key; the features are named, so no pass is needed to find them."""
    return cells.groupBy(*keys).agg(*(F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features))


def concat(tables: Sequence[DataFrame], keys: Sequence[str] = ROW, flags: Sequence[str] = (), validate: bool = False) -> DataFrame:
    """Bind columns: the tables must have the same row keys; missing flags are false, missing support 1."""
    if validate:
        for t in tables[1:]:
            guard_same_keys(tables[0], t, keys)
        guard_unique(_union(tables), [*keys, "feature"], "concat")
    out = _union(tables)
    fill = {f: F.coalesce(F.col(f), F.lit(False)) for f in flags}
    if "support" in out.columns:
        fill["support"] = F.coalesce(F.col("support"), F.lit(1.0))
    return out.withColumns(fill) if fill else out


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def stack_rows(tables: Sequence[DataFrame], columns: str = "identical", keys: Sequence[str] = ROW, validate: bool = False) -> DataFrame:
    """Bind rows. identical: all tables have the same features. union: a table's absent
    features become cells of null value, no coverage and no support."""
    if columns not in ("identical", "union"):
        raise ValueError(f"unknown columns mode {columns!r}")
    out = _union(tables)
    if validate:
        guard_unique(out, [*keys, "feature"], "stack_rows")
    if columns == "identical":
        if validate:
            first = tables[0].select("feature").distinct()
            for t in tables[1:]:
                guard_same_keys(first, t.select("feature").distinct(), ["feature"])
        return out
    # Each table's rows need only the features that it lacks.
    features = out.select("feature").distinct()
    filled = []
    for t in tables:
        lacking = features.join(t.select("feature").distinct(), "feature", "left_anti")
        names = lacking.agg(F.collect_set("feature").alias("names"))
        rows = t.select(*keys).distinct().join(F.broadcast(names)).select(*keys, F.explode("names").alias("feature"))
        filled.append(rows.withColumns({"value": F.lit(None).cast("double"), "coverage": F.lit(0.0), "support": F.lit(0.0)}))
    return _union([out, *filled])


# Designs -------------------------------------------------------------------------

#: Words in a covariate's name that give the target away (fixed values).
LEAKS = ("target", "outcome", "label", "predicted", "prediction")


def build_design(
    cells: DataFrame, targets: DataFrame, target: str, group: str, covariates: Sequence[str] = (), keys: Sequence[str] = ROW, validate: bool = True
) -> DataFrame:
    """Cells with y, group and covariates, by an exact one-to-one match of row keys.

    With validate, repeated or unmatched keys, a missing target and a covariate
    named for a target are errors.
    """
    bad = [c for c in covariates if any(w in c.lower() for w in LEAKS) or c == target]
    if bad:
        raise ValueError(f"covariates {bad} would give the target away")
    if validate:
        guard_unique(targets, keys, "targets")
        guard_unique(cells, [*keys, "feature"], "features")
        guard_same_keys(cells, targets, keys)
        if not targets.where(~is_finite(F.col(target).cast("double"))).isEmpty():
            raise ValueError(f"{target} has missing values")
    side = targets.select(*keys, F.col(target).cast("double").alias("y"), F.col(group).alias("group"), *covariates)
    return cells.join(side, list(keys), "inner")


def build_group_design(cells: DataFrame, targets: DataFrame, target: str, groups: str = "subject_id", keys: Sequence[str] = ("recording", "group"), validate: bool = True) -> DataFrame:
    """Cells of cross-trial measures with y and the subject of their recording, by an exact match of recording and group; no covariates."""
    missing = {"recording", "group", "feature"} - set(cells.columns)
    if missing:
        raise ValueError(f"not a table of groups: {sorted(missing)} are missing")
    side = targets.withColumnRenamed(groups, "_subject")
    if validate:
        guard_unique(targets, keys, "targets")
        guard_unique(cells, [*keys, "feature"], "features")
        guard_same_keys(cells, targets, keys)
        if not targets.where(~is_finite(F.col(target).cast("double"))).isEmpty():
            raise ValueError(f"{target} has missing values")
    return cells.join(side.select(*keys, F.col(target).cast("double").alias("y"), F.col("_subject").alias(groups)), list(keys), "inner")


def merge_targets(descriptors: DataFrame, external: DataFrame, keys: Sequence[str], validate: bool = True) -> DataFrame:
    """descriptors with the external columns, keys matching one to one and no column in both."""
    both = (set(descriptors.columns) & set(external.columns)) - set(keys)
    if both:
        raise ValueError(f"columns in both tables: {sorted(both)}")
    if validate:
        guard_unique(descriptors, keys, "descriptors")
        guard_unique(external, keys, "external targets")
        guard_same_keys(descriptors, external, keys)
    return descriptors.join(external, list(keys), "left")


def in_every_group(cells: DataFrame, group: str = "group") -> DataFrame:
    """(feature): those with a finite value in every group."""
    groups = cells.agg(F.count_distinct(group).alias("n"))
    own = cells.groupBy("feature").agg(F.count_distinct(F.when(is_finite("value"), F.col(group))).alias("k"))
    return own.join(F.broadcast(groups)).where("k = n").select("feature")


def harmonize(train: DataFrame, test: DataFrame, mode: str, group: str = "group") -> tuple[DataFrame, DataFrame]:
    """Train and test cells of the features that the training rows admit.

    intersection: finite in every training group; union_impute: finite anywhere in
    training, gaps filled by the training median.
    """
    if mode == "intersection":
        own = in_every_group(train, group)
        return tuple(t.join(own, "feature", "left_semi") for t in (train, test))
    if mode != "union_impute":
        raise ValueError(f"unknown mode {mode!r}")
    medians = exact_quantiles(train, "value", [0.5], ["feature"]).select("feature", F.col("quantiles")[0].alias("_median"))
    fill = lambda t: t.join(medians, "feature").withColumn("value", F.coalesce(blank("value"), "_median")).drop("_median")
    return fill(train), fill(test)


# Quality -------------------------------------------------------------------------


@dataclass(frozen=True)
class QualityPolicy:
    """Cells under min_coverage or min_support, or with one of the flags, are rejected."""

    min_coverage: float | None = None
    min_support: float | None = None
    rejected_flags: tuple[str, ...] = ()

    def reasons(self) -> Column:
        found = []
        if self.min_coverage is not None:
            found.append(F.when(F.col("coverage") < self.min_coverage, F.lit("coverage")))
        if self.min_support is not None:
            found.append(F.when(F.col("support") < self.min_support, F.lit("support")))
        found += [F.when(F.col(f), F.lit(f)) for f in self.rejected_flags]
        return F.concat_ws(";", *found) if found else F.lit("")


def apply_quality(cells: DataFrame, policy: QualityPolicy, keys: Sequence[str] = ROW) -> tuple[DataFrame, DataFrame]:
    """The masked cells with the flag quality_rejected, and the ledger of rejections with their reasons."""
    marked = cells.withColumn("reasons", policy.reasons())
    bad = F.col("reasons") != ""
    earlier = F.col("quality_rejected") if "quality_rejected" in cells.columns else F.lit(False)
    masked = marked.withColumns({"value": F.when(~bad, F.col("value")), "quality_rejected": bad | earlier}).drop("reasons")
    return masked, marked.where(bad).select(*keys, "feature", "reasons")


def feature_quality(cells: DataFrame, flags: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """n_rows, n_finite, missing_fraction, mean_coverage and a share for each flag, by feature and descriptors."""
    fine = is_finite("value").cast("int")
    return cells.groupBy(*by, "feature").agg(
        F.count("*").alias("n_rows"), F.sum(fine).alias("n_finite"), F.avg(1 - fine).alias("missing_fraction"), F.avg("coverage").alias("mean_coverage"),
        *(F.avg(F.coalesce(F.col(f).cast("int"), F.lit(0))).alias(f"{f}_fraction") for f in flags),
    )


def recording_quality(rows: DataFrame, validate: bool = False) -> DataFrame:
    """One row for each recording: original, retained and rejected epochs; rows that disagree are an error."""
    if validate:
        odd = rows.groupBy("recording").agg(F.count_distinct("original", "retained").alias("n")).where("n > 1").limit(3).collect()
        if odd:
            raise KeyMismatch(f"recordings with several records: {[r['recording'] for r in odd]}")
    return rows.groupBy("recording").agg(F.max("original").alias("original"), F.max("retained").alias("retained")).withColumn("rejected", F.col("original") - F.col("retained"))


def intraclass_reliability(samples: DataFrame, subject: str = "subject", session: str = "session", by: Sequence[str] = ("feature",), validate: bool = False) -> DataFrame:
    """ICC(3,1) (consistency) and ICC(2,1) (absolute) of a balanced two-way layout, by feature."""
    if validate:
        guard_unique(samples, [*by, subject, session], "samples")
    key = list(by)
    n, k = F.count_distinct(subject).alias("n"), F.count_distinct(session).alias("k")
    size = samples.groupBy(*key).agg(n, k, F.count(blank("value")).alias("cells"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("ss"))
    rows = samples.groupBy(*key, subject).agg(F.avg("value").alias("m")).groupBy(*key).agg((F.var_pop("m") * F.count("m")).alias("row_ss"))
    cols = samples.groupBy(*key, session).agg(F.avg("value").alias("m")).groupBy(*key).agg((F.var_pop("m") * F.count("m")).alias("col_ss"))
    t = size.join(rows, key).join(cols, key).where("cells = n * k and n >= 3 and k >= 2 and ss > 0")
    c = F.col
    msr = c("k") * c("row_ss") / (c("n") - 1)
    msc = c("n") * c("col_ss") / (c("k") - 1)
    mse = (c("ss") - c("k") * c("row_ss") - c("n") * c("col_ss")) / ((c("n") - 1) * (c("k") - 1))
    t = t.withColumns({"msr": msr, "msc": msc, "mse": mse})
    return t.select(
        *key, "n", "k",
        divide(c("msr") - c("mse"), c("msr") + (c("k") - 1) * c("mse")).alias("icc_consistency"),
        divide(c("msr") - c("mse"), c("msr") + (c("k") - 1) * c("mse") + c("k") * (c("msc") - c("mse")) / c("n")).alias("icc_absolute"),
    )


def row_positions(rows: DataFrame, keys: Sequence[str] = ROW, within: Sequence[str] = ("recording",)) -> DataFrame:
    """Place of each row key within its recording, from 0."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*within).orderBy(*keys)) - 1)
