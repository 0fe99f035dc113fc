"""Folds as tables: (fold, role, row key), from groups and runs."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.numeric import is_finite


def loso_folds(rows: DataFrame, key: Sequence[str], group: str = "subject") -> DataFrame:
    """Leave one group out: (fold, key, role); folds number the sorted groups from 1.

    Each row is a training row of every other fold, so the output has rows times
    groups; the groups are few and are ranked alone.
    """
    groups = fold_numbers(rows, group)
    return rows.select(*key, group).join(F.broadcast(groups)).select("fold", *key, F.when(F.col(group) == F.col("held_out"), "test").otherwise("train").alias("role"))


def fold_numbers(rows: DataFrame, group: str = "subject") -> DataFrame:
    """(held_out, fold): number of each group in sorted order, from 1."""
    names = rows.select(F.col(group).alias("held_out")).where("held_out is not null").distinct()
    return names.withColumn("fold", F.row_number().over(Window.orderBy("held_out")))


def test_fold(rows: DataFrame, group: str = "subject") -> DataFrame:
    """rows with the fold that tests them, the compact form of loso_folds."""
    return rows.join(fold_numbers(rows, group).withColumnRenamed("held_out", group), group)


def forward_folds(rows: DataFrame, key: Sequence[str], subject: str = "subject", run: str = "run", most: int | None = None) -> DataFrame:
    """Within each subject, run k is tested on the runs before it; the first two are never tested.

    (fold, subject, key, role); folds are numbered by subject and run. With most,
    only a subject's last folds are kept. Subjects with fewer than three runs have
    none.
    """
    runs = rows.select(subject, run).distinct()
    w = Window.partitionBy(subject).orderBy(run)
    placed = runs.withColumns({"place": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(subject))})
    tests = placed.where("place >= 3" + (f" and place > n - {int(most)}" if most else ""))
    tests = tests.select(subject, F.col(run).alias("test_run"), F.col("place").alias("test_place"))
    tests = tests.withColumn("fold", F.row_number().over(Window.orderBy(subject, "test_place")))
    own = rows.join(placed.select(subject, run, "place"), [subject, run])
    return own.join(tests, subject).where("place <= test_place").select(
        "fold", subject, *[k for k in key if k != subject], F.when(F.col("place") == F.col("test_place"), "test").otherwise("train").alias("role")
    )


def balanced_folds(rows: DataFrame, group: str, n_splits: int) -> DataFrame:
    """(group, fold): whole groups dealt to folds, the largest first, of equal ones the last label, each to the smallest fold so far.

    The groups' sizes are aggregated; only they, a row for each group, are dealt
    on the driver.
    """
    sizes = rows.groupBy(group).count().orderBy(F.desc("count"), F.desc(group)).collect()
    if len(sizes) < n_splits:
        raise ValueError(f"{len(sizes)} groups cannot make {n_splits} folds")
    load, dealt = [0] * n_splits, []
    for r in sizes:
        k = min(range(n_splits), key=lambda j: (load[j], j))
        load[k] += r["count"]
        dealt.append((r[group], k + 1))
    return rows.sparkSession.createDataFrame(dealt, f"{group} {dict(rows.dtypes)[group]}, fold int")


def within_subject_folds(rows: DataFrame, key: Sequence[str], subject: str = "subject", run: str = "run", n_splits: int = 3) -> DataFrame:
    """Run-disjoint folds within each subject: (fold, subject, key, role); runs are dealt by size, the largest first.

    A subject has at most as many folds as runs; those with one run have none.
    """
    runs = rows.groupBy(subject, run).agg(F.count("*").alias("_size"))
    w = Window.partitionBy(subject)
    dealt = runs.withColumns({"_rank": F.row_number().over(w.orderBy(F.desc("_size"), run)) - 1, "_runs": F.count("*").over(w)}).where("_runs >= 2")
    dealt = dealt.withColumn("_own", F.pmod(F.col("_rank"), F.least("_runs", F.lit(n_splits))).cast("int"))
    folds = dealt.select(subject, F.col("_own").alias("_test")).distinct().withColumn("fold", F.row_number().over(Window.orderBy(subject, "_test")))
    both = rows.join(dealt.select(subject, run, "_own"), [subject, run]).join(folds, subject)
    return both.select("fold", subject, *[k for k in key if k != subject], F.when(F.col("_own") == F.col("_test"), "test").otherwise("train").alias("role"))


@dataclass(frozen=True)
class InnerSplit:
    """How a training fold is split again: by subjects or runs, with equal shares of classes or not."""

    grouping: str = "subject"
    stratified: bool = False
    n_splits: int = 5

    def __post_init__(self) -> None:
        if self.grouping not in ("subject", "run"):
            raise ValueError(f"unknown grouping {self.grouping!r}")
        if self.n_splits < 2:
            raise ValueError("two splits are needed at least")


def stratified_folds(rows: DataFrame, group: str, y: str, n_splits: int, seed: int = 42) -> DataFrame:
    """(group, fold): whole groups dealt so that every fold gets near equal shares of each class.

    Groups whose classes are most uneven come first, equal ones in hashed order;
    each goes to the fold where the classes' shares then spread least over folds.
    Only counts by group and class reach the driver.
    """
    counts = rows.groupBy(group, y).agg(F.count("*").alias("n")).collect()
    classes = sorted({r[y] for r in counts})
    table: dict = {}
    for r in counts:
        table.setdefault(r[group], np.zeros(len(classes)))[classes.index(r[y])] += r["n"]
    total = sum(table.values())
    if len(classes) < 2:
        raise ValueError("two classes are needed at least")
    if total.min() < n_splits:
        raise ValueError(f"class {classes[int(total.argmin())]} has {int(total.min())} rows for {n_splits} splits")
    load, dealt = np.zeros((n_splits, len(classes))), []
    for g in sorted(table, key=lambda g: (-table[g].std(), zlib.crc32(f"{seed} {g}".encode()))):
        spread = []
        for k in range(n_splits):
            load[k] += table[g]
            spread.append(((load / total).std(axis=0).mean(), load[k].sum(), k))
            load[k] -= table[g]
        k = min(spread)[2]
        load[k] += table[g]
        dealt.append((g, k + 1))
    return rows.sparkSession.createDataFrame(dealt, f"{group} {dict(rows.dtypes)[group]}, fold int")


def inner_cv(train: DataFrame, split: InnerSplit, group: str, y: str | None = None, seed: int = 42) -> DataFrame:
    """(group, fold) of the inner splits of one training fold; the count is capped at that of the groups."""
    groups = train.select(group).distinct().count()
    if split.grouping == "subject" and groups == 1:
        raise ValueError("a fold within one subject has no subjects to split by")
    n = split_count(groups, split.n_splits)
    if not split.stratified:
        return balanced_folds(train, group, n)
    if y is None:
        raise ValueError("a stratified split needs labels")
    return stratified_folds(train, group, y, n, seed)


def run_aware_cv(rows: DataFrame, run: str = "run", n_splits: int | None = None, default: int = 5) -> tuple[DataFrame | None, int]:
    """(run, fold) that keeps runs whole, and the number of folds; none of either with under two runs."""
    if not rows.where(F.col(run).isNull()).isEmpty():
        raise ValueError("each row needs a run")
    runs = rows.select(run).distinct().count()
    if runs < 2:
        return None, 0
    n = min(n_splits or default, runs)
    return balanced_folds(rows, run, n), n


def run_aware_inner_cv(train: DataFrame, n_splits: int, key: Sequence[str], run: str = "run") -> DataFrame | None:
    """(fold, key, role) of the run-disjoint splits of one training fold; None with under two runs."""
    dealt, n = run_aware_cv(train, run, n_splits)
    if dealt is None:
        return None
    own = train.join(dealt.withColumnRenamed("fold", "_own"), run).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return own.select("fold", *key, F.when(F.col("_own") == F.col("fold"), "test").otherwise("train").alias("role"))


def find_run_column(events: DataFrame) -> DataFrame | None:
    """events with the column run as numbers: as they are if all that are there are numbers, else parsed from labels; None without the column.

    Labels that no number can be parsed from are null, as is a column of which none can.
    """
    if "run" not in events.columns:
        return None
    number = F.expr("try_cast(run as double)")
    bad = events.where(F.col("run").isNotNull() & ~is_finite(number)).isEmpty()
    return events.withColumn("run", number if bad else run_number(F.col("run")).cast("double"))


def split_count(n_groups: int, default: int = 5) -> int:
    """Inner splits for a number of groups: the default, at most the groups, two at least."""
    if n_groups < 2:
        raise ValueError("at least two groups are needed")
    return max(2, min(default, n_groups))


def run_number(label: Column) -> Column:
    """Number of a run label: a number, `run-N`, or the digits that it ends with."""
    text = label.cast("string")
    number = F.when(text.rlike(r"^\s*[+-]?\d+(\.0*)?\s*$"), F.regexp_extract(text, r"([+-]?\d+)", 1))
    named = F.when(text.rlike(r"(?i)run-?\d+"), F.regexp_extract(text, r"(?i)run-?(\d+)", 1))
    tail = F.when(text.rlike(r"\d+\s*$"), F.regexp_extract(text, r"(\d+)\s*$", 1))
    return F.coalesce(number, named, tail).cast("int")
