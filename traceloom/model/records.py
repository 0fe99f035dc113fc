"""Configurations and results of modelling as small records; rows stay DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions.numeric import safe_pearson
from traceloom.model import inference, metrics


@dataclass(frozen=True)
class PreprocessingConfig:
    """What a design's preparation leaves out and adds; estimators.preparation takes its stages from it."""

    max_feature_missingness: float = 0.2
    max_subject_missingness: float = 0.5
    feature_selection_percentile: float | None = None
    deconfound: bool = False
    pca_n_components: int | None = None

    def __post_init__(self) -> None:
        for name in ("max_feature_missingness", "max_subject_missingness"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} is a share")
        if self.feature_selection_percentile is not None and not 0 < self.feature_selection_percentile <= 100:
            raise ValueError("feature_selection_percentile lies in (0, 100]")
        if self.pca_n_components is not None and self.pca_n_components < 1:
            raise ValueError("one component is needed at least")

    def stages(self, features: Sequence[str], scale: bool = True, label: str = "y") -> list:
        from traceloom.model.estimators import preparation

        return preparation(features, scale, self.feature_selection_percentile, label, self.pca_n_components)


def transform_feature_names(model, features: Sequence[str]) -> list[str]:
    """Names of the columns that reach the estimator of a fitted pipeline of estimators.preparation: kept ones by name, components by number."""
    names = list(features)
    for stage in model.stages:
        if hasattr(stage, "selectedFeatures"):
            names = [names[k] for k in sorted(stage.selectedFeatures)]
        elif hasattr(stage, "pc"):
            names = [f"component_{k}" for k in range(stage.pc.numCols)]
    return names


@dataclass(frozen=True)
class AggregationConfig:
    """How subjects are weighted and what interval their mean gets."""

    subject_weighting: str = "equal"
    bootstrap_iterations: int = 1000
    ci_method: str = "none"
    seed: int = 42

    def __post_init__(self) -> None:
        if self.subject_weighting not in ("equal", "trial_count"):
            raise ValueError(f"unknown weighting {self.subject_weighting!r}")
        if self.ci_method not in ("none", "fixed_effects", "bootstrap"):
            raise ValueError(f"unknown interval {self.ci_method!r}")


@dataclass(frozen=True)
class SubjectLevelR:
    """Fisher mean of the subjects' correlations, the rows behind it, and its interval."""

    r: float | None
    per_subject: DataFrame
    ci_low: float | None = None
    ci_high: float | None = None


def subject_level_r(pred: DataFrame, config: AggregationConfig = AggregationConfig(), by_fold: bool = False) -> SubjectLevelR:
    own = metrics.subject_r(pred, by_fold)
    r = metrics.subject_level_r(pred, config.subject_weighting, by_fold).first()["subject_level_r"]
    if config.ci_method == "none" or r is None:
        return SubjectLevelR(r, own)
    z = own.where("r is not null and abs(r) < 1").select("subject", F.atanh("r").alias("value"), "n")
    if config.ci_method == "fixed_effects":
        import math

        weight = z.where("n > 3").agg(F.sum(F.col("n") - 3)).first()[0]
        half = 1.959963984540054 / math.sqrt(weight) if weight else float("nan")
        return SubjectLevelR(r, own, math.tanh(math.atanh(r) - half), math.tanh(math.atanh(r) + half))
    # A row for each subject: numbered by rank.
    from pyspark.sql import Window

    units = z.withColumn("unit", F.row_number().over(Window.orderBy("subject")) - 1)
    ends = inference.bootstrap_mean_ci(units, iterations=config.bootstrap_iterations, seed=config.seed).select(F.tanh("ci_low").alias("a"), F.tanh("ci_high").alias("b")).first()
    return SubjectLevelR(r, own, ends["a"], ends["b"])


Scorer = Callable[[DataFrame], float]


def pearsonr_scorer() -> Scorer:
    """Pooled r of predictions, 0 where it is undefined."""
    return lambda pred: pred.agg(F.coalesce(safe_pearson("y", "p"), F.lit(0.0))).first()[0]


def subject_r_scorer(config: AggregationConfig = AggregationConfig()) -> Scorer:
    """Fisher mean of the subjects' correlations, undefined ones as 0."""
    return lambda pred: metrics.subject_level_r(pred, config.subject_weighting, undefined="zero").first()["subject_level_r"] or 0.0


def scoring_dict() -> dict[str, Scorer]:
    return {"r": pearsonr_scorer(), "neg_mse": lambda pred: pred.agg(-F.avg(F.pow(F.col("y") - F.col("p"), 2))).first()[0]}


@dataclass(frozen=True)
class NullConfig:
    """Scheme of a null: targets rearranged within subjects or shifted within runs, how often, and how few trials a block may have."""

    scheme: str = "within_subject"
    n_permutations: int = 1000
    min_retained_trials: int = 8

    def __post_init__(self) -> None:
        if self.scheme not in ("within_subject", "circular_shift"):
            raise ValueError(f"unknown scheme {self.scheme!r}")
        if self.n_permutations < 1:
            raise ValueError("one permutation is needed at least")


@dataclass(frozen=True)
class NullResult:
    p_value: float
    observed: float
    null: tuple[float, ...]
    changed_fractions: tuple[float, ...] = ()
    n_incomplete: int = 0


def permutation_null(rows: DataFrame, score: Callable[[DataFrame], float | None], config: NullConfig, group: str, order: str, run: str | None = None, seed: int = 42) -> NullResult:
    """The observed score against those of rows whose y is rearranged by the scheme; any model, as score takes rows.

    A draw without a score counts as incomplete and against significance.
    """
    observed = score(rows)
    if observed is None:
        raise ValueError("the observed score is undefined")
    null, changed, lost = [], [], 0
    for k in range(1, config.n_permutations + 1):
        if config.scheme == "within_subject":
            moved = inference.block_permutation(rows, [group], order, "y", k, seed)
        else:
            moved = inference.circular_permutation(rows, [group, run] if run else [group], [order], "y", 1 + int(inference.draw_numbers(k, np.array([1]), seed)[0] % 997), config.min_retained_trials)
        changed.append(inference.changed_fraction(moved, "y", "permuted").first()["changed"] or 0.0)
        s = score(moved.drop("y").withColumnRenamed("permuted", "y"))
        if s is None:
            lost += 1
        else:
            null.append(float(s))
    over = sum(v >= observed - inference.EPS * abs(observed) for v in null) + lost
    return NullResult((over + 1) / (config.n_permutations + 1), float(observed), tuple(null), tuple(changed), lost)


@dataclass(frozen=True)
class TunedFit:
    """A fitted pipeline and the parameters that it was chosen by."""

    estimator: object
    best_params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class FoldPrediction:
    """One fold's held-out rows (y, p and keys), and its parameters."""

    fold: int
    group: object
    rows: DataFrame
    best_params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class FoldClassification(FoldPrediction):
    """As FoldPrediction, with the classes; rows may have score and probability."""

    classes: tuple = (0, 1)


@dataclass(frozen=True)
class FoldResults:
    """All folds' held-out rows with the column fold, in fold order when sorted by it."""

    rows: DataFrame
    folds: tuple[int, ...]


def fold_results(folds: Sequence[FoldPrediction]) -> FoldResults:
    out = None
    for f in sorted(folds, key=lambda f: f.fold):
        one = f.rows.withColumn("fold", F.lit(f.fold))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no folds")
    return FoldResults(out, tuple(sorted(f.fold for f in folds)))


@dataclass(frozen=True)
class ClassificationResult:
    """Scores of labelled predictions and, by subject, their table."""

    scores: dict
    confusion: dict
    per_subject: DataFrame | None = None
    mean_subject_auc: float | None = None


def classification_result(pred: DataFrame, group: str | None = "subject") -> ClassificationResult:
    scores = metrics.classification_metrics(pred).first().asDict()
    cells = metrics.confusion(pred).select("tn", "fp", "fn", "tp").first().asDict()
    if group is None:
        return ClassificationResult(scores, cells)
    per = metrics.confusion(pred, [group]).join(metrics.auc(pred, [group]), group)
    return ClassificationResult(scores, cells, per, per.agg(F.avg("auc")).first()[0])


@dataclass(frozen=True)
class PredictionIntervals:
    """Rows with lower and upper, how they were made, and the unit that was exchanged."""

    rows: DataFrame
    alpha: float
    method: str
    calibration_unit: str = "trial"

    def coverage(self) -> float | None:
        return self.rows.agg(F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("int"))).first()[0]


@dataclass(frozen=True)
class Importance:
    """(feature, importance) and, where folds were judged one by one, their table."""

    rows: DataFrame
    per_fold: DataFrame | None = None
