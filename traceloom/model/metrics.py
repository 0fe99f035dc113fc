"""Scores of predictions, pooled and by subject, as aggregates.

Predictions: y, p, subject and, where asked for, fold, condition, score. Two-level
measures aggregate by subject first, so what is shuffled is one row for each
subject and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.numeric import divide, fisher_z, is_finite, running_sums, safe_pearson


def regression_metrics(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """pearson_r, r2, explained_variance and n."""
    e = F.col("y") - F.col("p")
    n = F.count("*")
    ss = F.var_pop("y") * n
    return pred.groupBy(*by).agg(
        safe_pearson("y", "p").alias("pearson_r"),
        F.when(n > 1, 1 - divide(F.sum(e * e), ss)).alias("r2"),
        F.when(n > 1, 1 - divide(F.var_pop(e) * n, ss)).alias("explained_variance"),
        n.alias("n"),
    )


def subject_r(pred: DataFrame, by_fold: bool = False, least: int = 3) -> DataFrame:
    """(subject, r, n): correlation of each subject, both sides centred within folds if by_fold."""
    rows = pred
    if by_fold:
        w = Window.partitionBy("subject", "fold")
        rows = pred.withColumns({"y": F.col("y") - F.avg("y").over(w), "p": F.col("p") - F.avg("p").over(w)})
    folds = F.count_distinct("fold") - 1 if by_fold else F.lit(0)
    return rows.groupBy("subject").agg(safe_pearson("y", "p").alias("r"), (F.count("*") - folds).alias("n")).where(F.col("n") >= least)


def subject_level_r(pred: DataFrame, weighting: str = "equal", by_fold: bool = False, undefined: str = "raise") -> DataFrame:
    """One row: Fisher mean of the subjects' correlations, equal or by n - 3, and how many they are."""
    if weighting not in ("equal", "trial_count"):
        raise ValueError(f"unknown weighting {weighting!r}")
    own = subject_r(pred, by_fold)
    if undefined == "zero":
        own = own.withColumn("r", F.coalesce("r", F.lit(0.0)))
    w = F.lit(1.0) if weighting == "equal" else (F.col("n") - 3).cast("double")
    own = own.where("r is not null" + ("" if weighting == "equal" else " and n > 3")).withColumn("w", w)
    return own.agg(F.tanh(divide(F.sum(F.col("w") * fisher_z("r")), F.sum("w"))).alias("subject_level_r"), F.count("*").alias("n_subjects"))


def subject_level_errors(pred: DataFrame, weighting: str = "equal") -> DataFrame:
    """One row: mean over subjects of MAE and RMSE, equal or by trials."""
    e = F.col("y") - F.col("p")
    own = pred.groupBy("subject").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").cast("double").alias("n"))
    w = F.lit(1.0) if weighting == "equal" else F.col("n")
    return own.agg((F.sum(w * F.col("mae")) / F.sum(w)).alias("mae"), (F.sum(w * F.col("rmse")) / F.sum(w)).alias("rmse"), F.count("*").alias("n_subjects"))


def centred_metrics(pred: DataFrame, cells: Sequence[str] = ("subject",), least: int = 2) -> DataFrame:
    """R^2 of full (p) and nuisance predictions after centring within cells, mean over subjects.

    Cells with fewer than two trials are left out, as are subjects whose target is
    constant within every cell left.
    """
    w = Window.partitionBy(*cells)
    centred = pred.withColumn("_n", F.count("*").over(w)).where(F.col("_n") >= least)
    c = lambda x: F.col(x) - F.avg(x).over(w)
    varies = (F.max("y").over(w) > F.min("y").over(w)).cast("int")
    centred = centred.withColumns({"cy": c("y"), "cp": c("p"), "cn": c("nuisance"), "varies": varies})
    ss = F.sum(F.col("cy") * F.col("cy"))
    r2 = lambda x: 1 - divide(F.sum((F.col("cy") - F.col(x)) * (F.col("cy") - F.col(x))), ss)
    own = centred.groupBy("subject").agg(F.when(F.max("varies") == 1, r2("cp")).alias("full"), F.when(F.max("varies") == 1, r2("cn")).alias("nuisance"), F.count("*").alias("trials")).where("full is not null")
    return own.agg(
        F.avg("full").alias("full_r2"), F.avg("nuisance").alias("nuisance_r2"), (F.avg("full") - F.avg("nuisance")).alias("delta_r2"), F.count("*").alias("n_subjects"), F.sum("trials").alias("n_trials")
    )


def auc(rows: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """(by, auc): rank sum with mid-ranks; null with one class only.

    Equal scores are counted first, so the ranking sorts distinct scores and not
    rows.
    """
    counts = rows.groupBy(*by, score).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    upto = running_sums(counts, score, {"upto": "n"}, list(by))
    mid = F.col("upto") - F.col("n") + (F.col("n") + 1) / 2
    ranked = upto.withColumn("rank_sum", mid * F.col("pos"))
    pos, n = F.sum("pos").cast("double"), F.sum("n").cast("double")
    return ranked.groupBy(*by).agg(divide(F.sum("rank_sum") - pos * (pos + 1) / 2, pos * (n - pos)).alias("auc"))


def average_precision(rows: DataFrame, by: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """(by, average_precision): precision at each distinct score, weighted by the recall gained there."""
    counts = rows.groupBy(*by, score).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.count("*").alias("n"))
    cum = running_sums(counts, score, {"tp": "pos", "seen": "n"}, list(by), descending=True)
    return cum.groupBy(*by).agg(divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos").cast("double")).alias("average_precision"))


def confusion(rows: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """Counts tn, fp, fn, tp and the scores that they give; a score without cases is null."""
    cell = lambda a, b: F.count_if((F.col(y) == a) & (F.col(p) == b)).cast("double")
    c = rows.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    recall, specificity = divide(tp, tp + fn), divide(tn, tn + fp)
    return c.withColumns({
        "accuracy": divide(tp + tn, tp + tn + fp + fn), "recall": recall, "specificity": specificity,
        "balanced_accuracy": F.when(recall.isNotNull() & specificity.isNotNull(), (recall + specificity) / 2).otherwise(F.coalesce(recall, specificity)),
        "precision": divide(tp, tp + fp), "f1": divide(2 * tp, 2 * tp + fp + fn),
    })


SCORES = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "specificity")


def classification_metrics(rows: DataFrame, group: str | None = None, y: str = "y", p: str = "p", score: str = "score") -> DataFrame:
    """One row of scores with auc and average_precision; by group, the equal mean over groups that have one."""
    if not rows.where(~F.col(y).isin(0, 1) | ~F.col(p).isin(0, 1)).isEmpty():
        raise ValueError("labels must be 0 or 1")
    by = [group] if group else []
    c, a, ap = confusion(rows, by, y, p), auc(rows, by, y, score), average_precision(rows, by, y, score)
    own = c.join(a, by).join(ap, by) if by else c.join(a).join(ap)
    return own.agg(*(F.avg(s).alias(s) for s in (*SCORES, "auc", "average_precision")))


def finite_pairs(pred: DataFrame, *columns: str) -> DataFrame:
    ok: Column = F.lit(True)
    for c in columns or ("y", "p"):
        ok = ok & is_finite(c)
    return pred.where(ok)
