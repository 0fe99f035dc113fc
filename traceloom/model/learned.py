"""Features that are learned from signals inside each training fold, and cross-fitting of models on them.

A learned feature has fit(train epochs) and gives a function from epochs to
epochs with the columns that it names; nothing of the test epochs reaches a fit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.model import estimators as E
from traceloom.model import splits as S
from traceloom.model.workflow import FoldFitError, score_of
from traceloom.operators import spatial_models as SM

Applied = Callable[[DataFrame], DataFrame]


def _spread(rows: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return rows.withColumns({n: F.get(column, F.lit(k)) for k, n in enumerate(names)})


@dataclass(frozen=True)
class MicrostateTransformer:
    """Coverage, mean duration and occurrence of states whose maps the training epochs give."""

    n_states: int = 4
    starts: int = 5
    seed: int = 42

    def fit(self, train: DataFrame, label: str) -> tuple[Applied, list[str]]:
        templates, _ = SM.fit_microstates(train, self.n_states, starts=self.starts, seed=self.seed)
        names = [f"state{k}_{m}" for k in range(self.n_states) for m in ("coverage", "duration", "occurrence")]

        def apply(epochs: DataFrame) -> DataFrame:
            cells = SM.microstate_summary(SM.label_samples(epochs, templates), self.n_states)
            wide = cells.groupBy(*SM.KEYS).agg(*(F.max(F.when(F.col("state") == k, F.col(m))).alias(f"state{k}_{m}") for k in range(self.n_states) for m in ("coverage", "duration", "occurrence")))
            return epochs.join(wide, list(SM.KEYS))

        return apply, names


@dataclass(frozen=True)
class CSPTransformer:
    """Log power of components that part the training epochs' classes."""

    n_channels: int
    n_components: int = 4
    regularization: float = 0.0

    def fit(self, train: DataFrame, label: str) -> tuple[Applied, list[str]]:
        filters = SM.csp_filters(SM.class_covariances(train, label, self.n_channels), self.n_components, self.regularization)
        names = [f"csp{k}" for k in range(len(filters))]
        return lambda epochs: _spread(SM.csp_features(epochs, filters), "csp", names), names


@dataclass(frozen=True)
class CovarianceTransformer:
    """The epochs' shrunken covariances, upper triangle; nothing is learned."""

    n_channels: int
    shrinkage: float = 0.1

    def fit(self, train: DataFrame, label: str) -> tuple[Applied, list[str]]:
        places = [i * self.n_channels + j for i in range(self.n_channels) for j in range(i, self.n_channels)]
        names = [f"cov{p}" for p in places]
        return lambda epochs: SM.covariance_features(epochs, self.shrinkage).withColumns({n: F.get("cov", F.lit(p)) for n, p in zip(names, places)}), names


@dataclass(frozen=True)
class TangentSpaceTransformer:
    """Logs of covariances at the training epochs' Riemannian mean."""

    n_channels: int
    shrinkage: float = 0.1
    rounds: int = 30

    def fit(self, train: DataFrame, label: str) -> tuple[Applied, list[str]]:
        mean = SM.riemannian_mean(SM.covariance_features(train, self.shrinkage), self.n_channels, self.rounds)
        names = [f"tangent{k}" for k in range(self.n_channels * (self.n_channels + 1) // 2)]
        return lambda epochs: _spread(SM.tangent_features(SM.covariance_features(epochs, self.shrinkage), self.n_channels, mean=mean), "tangent", names), names


@dataclass(frozen=True)
class LearnedPipeline:
    """Learned features, then an estimator made from its parameters."""

    features: tuple
    estimator: Callable[[dict], object]

    def fit(self, train: DataFrame, params: Mapping) -> Applied:
        steps, columns, rows = [], [], train
        for f in self.features:
            apply, names = f.fit(train, "y")
            steps.append(apply)
            columns += names
        for apply in steps:
            rows = apply(rows)
        model = Pipeline(stages=[*E.preparation(columns), self.estimator(dict(params))]).fit(rows)

        def predict(epochs: DataFrame) -> DataFrame:
            for apply in steps:
                epochs = apply(epochs)
            return model.transform(epochs)

        return predict


def learned_pipeline(features, estimator: Callable[[dict], object]) -> LearnedPipeline:
    """features: one learned feature or several; estimator: parameters -> a stage of pyspark.ml with the columns features, y and p."""
    own = tuple(features) if isinstance(features, (list, tuple)) else (features,)
    if not own:
        raise ValueError("a learned feature is needed")
    return LearnedPipeline(own, estimator)


def _cross_fit(epochs: DataFrame, pipeline: LearnedPipeline, candidates: Sequence[dict], group: str, inner: S.InnerSplit, task: str, keep: Sequence[str], seed: int) -> tuple[DataFrame, dict]:
    groups = [r[0] for r in epochs.select(group).distinct().orderBy(group).collect()]
    if len(groups) < 3:
        raise ValueError("three groups are needed at least")
    prepare = E.balanced_weights if task == "classification" else lambda d: d
    weighted = (lambda d: d.withColumn("weight", F.lit(1.0))) if task == "classification" else lambda d: d
    out, chosen = None, {}
    for g in groups:
        train, test = prepare(epochs.where(F.col(group) != g)), weighted(epochs.where(F.col(group) == g))
        best = dict(candidates[0]) if candidates else {}
        if len(candidates) > 1:
            dealt = S.inner_cv(train, inner, group, "y" if inner.stratified else None, seed)
            own, n = train.join(dealt.withColumnRenamed("fold", "_inner"), group), dealt.agg(F.max("fold")).first()[0]
            scores = []
            for c in candidates:
                try:
                    held = None
                    for k in range(1, n + 1):
                        one = pipeline.fit(own.where(F.col("_inner") != k), c)(own.where(F.col("_inner") == k)).select("y", "p")
                        held = one if held is None else held.unionByName(one)
                    scores.append(score_of(held, task))
                except Exception as e:
                    raise FoldFitError(f"group {g}, candidate {c}: {e}") from e
            best = dict(candidates[int(np.argmax(scores))])
        chosen[g] = best
        one = pipeline.fit(train, best)(test).select(*dict.fromkeys([*keep, group, "y"]), "p")
        out = one if out is None else out.unionByName(one)
    return out, chosen


def cross_fit_signal_classification(epochs: DataFrame, pipeline: LearnedPipeline, group: str, candidates: Sequence[dict] = (), inner: S.InnerSplit = S.InnerSplit(n_splits=3), keep: Sequence[str] = SM.KEYS, seed: int = 42) -> tuple[DataFrame, dict]:
    """Leave-one-group-out labels p of epochs (m, y of 0 and 1), features and estimator fitted inside each training fold."""
    return _cross_fit(epochs, pipeline, candidates, group, inner, "classification", keep, seed)


def cross_fit_signal_regression(epochs: DataFrame, pipeline: LearnedPipeline, group: str, candidates: Sequence[dict] = (), inner: S.InnerSplit = S.InnerSplit(n_splits=3), keep: Sequence[str] = SM.KEYS, seed: int = 42) -> tuple[DataFrame, dict]:
    """Leave-one-group-out predictions p of epochs (m, y)."""
    return _cross_fit(epochs, pipeline, candidates, group, inner, "regression", keep, seed)
