"""Estimators: linear models from normal equations on executors, trees and margins from pyspark.ml.

Normal equations of all folds come from one aggregation of products; the driver
solves systems whose size is that of the features, never of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, PCA, StandardScaler, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.numeric import blank, divide, running_sums
from traceloom.model.kernels import FourierFeatures
from traceloom.sources.scratch import cut

# Grids (fixed values) ---------------------------------------------------------------


def ridge_grid(n: int, p: int) -> list[dict]:
    return [{"alpha": n * p * 10.0**k} for k in range(-6, 2)]


def scaled_ridge_grid() -> list[dict]:
    return [{"alpha": 10.0**k} for k in range(-6, 2)]


def grid(**values: Sequence) -> list[dict]:
    """All combinations of the parameters' values."""
    return [dict(zip(values, v)) for v in product(*values.values())]


def elasticnet_grid() -> list[dict]:
    return grid(alpha=(0.001, 0.01, 0.1, 1.0, 10.0), l1_ratio=(0.2, 0.5, 0.8))


def logistic_grid(penalty: str = "l2") -> list[dict]:
    """Empty without a penalty, as there is nothing to choose."""
    if penalty == "none":
        return []
    return grid(C=(0.01, 0.1, 1.0, 10.0), **({"l1_ratio": (0.1, 0.5, 0.9)} if penalty == "elasticnet" else {}))


def random_forest_grid() -> list[dict]:
    return grid(max_depth=(5, 10, 20, None), min_samples_split=(2, 5, 10), min_samples_leaf=(1, 2, 4))


random_forest_classifier_grid = random_forest_grid


def hist_gradient_boosting_grid() -> list[dict]:
    return grid(max_iter=(100, 200), max_leaf_nodes=(7, 15), min_samples_leaf=(10, 20), l2_regularization=(0.0, 1.0))


hist_gradient_boosting_classifier_grid = hist_gradient_boosting_grid


def svm_grid() -> list[dict]:
    return grid(C=(0.1, 1.0, 10.0), gamma=("scale", "auto"))


def svr_grid() -> list[dict]:
    return grid(C=(0.1, 1.0, 10.0), gamma=("scale", 0.01, 0.1), epsilon=(0.01, 0.1))


def lda_grid() -> list[dict]:
    return grid(shrinkage=("auto", 0.1, 0.5, 0.9))


# Preparation ------------------------------------------------------------------------


def preparation(features: Sequence[str], scale: bool = True, percentile: float | None = None, label: str = "y", pca: int | None = None, categorical_label: bool = False) -> list:
    """Stages fitted on training rows: median imputation, assembly, constant columns out, selection, scaling, PCA."""
    stages: list = [Imputer(strategy="median", inputCols=list(features), outputCols=[f"{f}_i" for f in features], relativeError=0.0)]
    stages.append(VectorAssembler(inputCols=[f"{f}_i" for f in features], outputCol="raw"))
    stages.append(VarianceThresholdSelector(varianceThreshold=0.0, featuresCol="raw", outputCol="varied"))
    at = "varied"
    if percentile is not None:
        chosen = UnivariateFeatureSelector(featuresCol=at, outputCol="chosen", labelCol=label, selectionMode="percentile")
        stages.append(chosen.setFeatureType("continuous").setLabelType("categorical" if categorical_label else "continuous").setSelectionThreshold(percentile / 100))
        at = "chosen"
    if scale:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol=at, outputCol="scaled"))
        at = "scaled"
    if pca is not None:
        stages.append(PCA(k=pca, inputCol=at, outputCol="components"))
        at = "components"
    stages[-1].setOutputCol("features")
    return stages


def replace_infinite(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return rows.withColumns({f: blank(f) for f in features})


def column_quality(rows: DataFrame, features: Sequence[str], group: str | None = None) -> DataFrame:
    """(feature, n_finite, missing, variance, constant[, worst_group_missing]) of wide columns, in one pass each."""
    long = rows.select(*([group] if group else []), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), blank(f).alias("v")) for f in features))).alias("c")).select(*([group] if group else []), "c.*")
    stats = long.groupBy("feature").agg(
        F.count("v").alias("n_finite"), F.avg(F.col("v").isNull().cast("int")).alias("missing"), F.var_pop("v").alias("variance"), (F.max("v") == F.min("v")).alias("constant")
    )
    if group is None:
        return stats
    worst = long.groupBy("feature", group).agg(F.avg(F.col("v").isNull().cast("int")).alias("m")).groupBy("feature").agg(F.max("m").alias("worst_group_missing"))
    return stats.join(worst, "feature")


def keep_columns(quality: DataFrame, min_finite: int = 1, max_missing: float = 0.2, min_variance: float = 0.0, max_group_missing: float | None = None) -> DataFrame:
    """(feature): those that the thresholds admit; a constant column never is."""
    ok = (F.col("n_finite") >= min_finite) & (F.col("missing") <= max_missing) & (F.col("variance") > min_variance) & ~F.col("constant")
    if max_group_missing is not None:
        ok = ok & (F.col("worst_group_missing") <= max_group_missing)
    return quality.where(ok).select("feature")


def match_names(names: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Features whose name holds one of the tokens, in any case."""
    ok = F.lit(False)
    for t in tokens:
        ok = ok | F.lower("feature").contains(t.lower())
    return names.where(ok)


# Normal equations --------------------------------------------------------------------


def normal_equations(rows: DataFrame, columns: Sequence[str], y: str, by: Sequence[str] = ()) -> list[dict]:
    """For each group: n, X'X with the constant first, X'y and y'y; complete rows only.

    The sums are built-in aggregates of products; what reaches the driver is
    (p + 2)^2 / 2 numbers for each group.
    """
    names = ["_one", *columns]
    ok = blank(y).isNotNull()
    for c in columns:
        ok = ok & blank(c).isNotNull()
    x = rows.where(ok).withColumn("_one", F.lit(1.0))
    if len(columns) > WIDE:
        return _gram(x, names, y, by)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = x.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"a{i}_{j}") for i, j in pairs), *(F.sum(F.col(n) * F.col(y)).alias(f"b{i}") for i, n in enumerate(names))
    ).collect()
    out = []
    for r in sums:
        a = np.zeros((len(names), len(names)))
        for i, j in pairs:
            a[i, j] = a[j, i] = r[f"a{i}_{j}"] or 0.0
        out.append({"key": tuple(r[k] for k in by), "n": r["n"], "xx": a, "xy": np.array([r[f"b{i}"] or 0.0 for i in range(len(names))]), "yy": r["yy"] or 0.0})
    return out


#: Columns beyond which products are summed by matrices in each task and no longer by an aggregate for each pair.
WIDE = 24


def _gram(rows: DataFrame, names: Sequence[str], y: str, by: Sequence[str]) -> list[dict]:
    """Sums of products by group: each task multiplies its batches' matrices and emits one row of cells for each group."""
    width = len(names) + 1
    source = rows.select(F.struct(*(F.col(k) for k in by)).alias("key") if by else F.lit(0).alias("key"), F.array(*(F.col(c).cast("double") for c in (*names, y))).alias("x"))
    source = source.withColumn("label", F.to_json("key") if by else F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            label = batch.column(0).dictionary_encode()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            codes = label.indices.to_numpy(zero_copy_only=False)
            for k, name in enumerate(label.dictionary.to_pylist()):
                own = x[codes == k]
                sums[name] = sums.get(name, 0.0) + own.T @ own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.ravel().tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["label", "cells"])

    parts = source.select("label", "x").mapInArrow(run, "label string, cells array<double>")
    # The cells of a task's groups are summed place by place; keys come back typed from the rows themselves.
    cells = parts.select("label", F.posexplode("cells").alias("place", "v")).groupBy("label", "place").agg(F.sum("v").alias("v"))
    keys = {r["label"]: r["key"] for r in source.groupBy("label").agg(F.first("key").alias("key")).collect()}
    found: dict[str, np.ndarray] = {}
    for r in cells.collect():
        found.setdefault(r["label"], np.zeros(width * width))[r["place"]] = r["v"]
    out = []
    for label, flat in found.items():
        m = flat.reshape(width, width)
        out.append({"key": tuple(keys[label]) if by else (), "n": int(round(m[0, 0])), "xx": m[:-1, :-1], "xy": m[:-1, -1], "yy": float(m[-1, -1])})
    return out


def solve_ridge(e: dict, alpha: float, standardise: bool = True) -> np.ndarray:
    """Constant and weights in the columns' own units; the penalty acts on standardised columns, not on the constant."""
    n, xx, xy = e["n"], e["xx"], e["xy"]
    mean = xx[0, 1:] / n
    cov = xx[1:, 1:] / n - np.outer(mean, mean)
    cxy = xy[1:] / n - mean * xy[0] / n
    scale = np.sqrt(np.maximum(cov.diagonal(), 0.0)) if standardise else np.ones(len(mean))
    live = scale > 1e-12
    w = np.zeros(len(mean))
    if live.any():
        s = scale[live]
        a = cov[np.ix_(live, live)] / np.outer(s, s) + np.eye(live.sum()) * alpha / n
        w[live] = np.linalg.lstsq(a, cxy[live] / s, rcond=None)[0] / s
    return np.r_[xy[0] / n - mean @ w, w]


def linear_prediction(columns: Sequence[str], w: Sequence[float]) -> Column:
    out = F.lit(float(w[0]))
    for c, v in zip(columns, w[1:]):
        out = out + F.col(c) * float(v)
    return out


def minus(total: dict, part: dict) -> dict:
    """Sums of the rows of total without those of part."""
    return {k: total[k] - part[k] for k in ("n", "xx", "xy", "yy")}


def plus(parts: Sequence[dict]) -> dict:
    return {k: sum((p[k] for p in parts[1:]), parts[0][k]) for k in ("n", "xx", "xy", "yy")}


def mse_of(e: dict, w: np.ndarray) -> float:
    return float(e["yy"] - 2 * w @ e["xy"] + w @ e["xx"] @ w) / max(e["n"], 1)


def cross_fit_ridge(rows: DataFrame, columns: Sequence[str], y: str, group: str, alphas: Sequence[float] | None = None, scaled: bool = False) -> tuple[DataFrame, dict]:
    """Leave-one-group-out ridge predictions, the penalty chosen by inner leave-one-group-out error.

    All fits, outer and inner, come from one aggregation by group, as training sums
    are differences of the groups' sums. Returns rows with p, and the penalty of
    each group.
    """
    parts = {e["key"][0]: e for e in normal_equations(rows, columns, y, [group])}
    if len(parts) < 3:
        raise ValueError("cross-fitting needs three groups at least")
    total = plus(list(parts.values()))
    chosen, fits = {}, {}
    for g, own in parts.items():
        train = minus(total, own)
        choices = [d["alpha"] for d in (scaled_ridge_grid() if scaled else ridge_grid(train["n"], len(columns)))] if alphas is None else list(alphas)
        unit = train["n"] * len(columns) if scaled else 1.0
        errors = []
        for a in choices:
            total_error = sum(mse_of(o, solve_ridge(minus(train, o), a * unit)) * o["n"] for h, o in parts.items() if h != g)
            errors.append(total_error)
        chosen[g] = choices[int(np.argmin(errors))]
        fits[g] = solve_ridge(train, chosen[g] * unit)
    table = rows.sparkSession.createDataFrame([(g, [float(v) for v in w]) for g, w in fits.items()], f"{group} {dict(rows.dtypes)[group]}, _w array<double>")
    x = F.array(F.lit(1.0), *(F.col(c).cast("double") for c in columns))
    dot = F.aggregate(F.zip_with(x, F.col("_w"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.join(table, group, "left").withColumn("p", dot).drop("_w"), chosen


def ridge_null(rows: DataFrame, columns: Sequence[str], targets: Sequence[str], group: str, alpha: float) -> dict[str, float]:
    """Pooled held-out r^2 of each permuted target column, all draws from one aggregation: X'X is shared."""
    names = ["_one", *columns]
    x = rows.withColumn("_one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = x.groupBy(group).agg(
        F.count("*").alias("n"), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"a{i}_{j}") for i, j in pairs),
        *(F.sum(F.col(t) * F.col(t)).alias(f"y{k}") for k, t in enumerate(targets)), *(F.sum(F.col(n) * F.col(t)).alias(f"b{i}_{k}") for i, n in enumerate(names) for k, t in enumerate(targets)),
    ).collect()
    parts = []
    for r in sums:
        a = np.zeros((len(names), len(names)))
        for i, j in pairs:
            a[i, j] = a[j, i] = r[f"a{i}_{j}"]
        parts.append({"n": r["n"], "xx": a, "b": np.array([[r[f"b{i}_{k}"] for k in range(len(targets))] for i in range(len(names))]), "y": np.array([r[f"y{k}"] for k in range(len(targets))])})
    out = {}
    for k, t in enumerate(targets):
        es = [{"n": p["n"], "xx": p["xx"], "xy": p["b"][:, k], "yy": p["y"][k]} for p in parts]
        total = plus(es)
        sse = sum(mse_of(e, solve_ridge(minus(total, e), alpha)) * e["n"] for e in es)
        out[t] = 1 - sse / (total["yy"] - total["xy"][0] ** 2 / total["n"])
    return out


def residualise(train: DataFrame, test: DataFrame, y: str, covariates: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both with residual: y less its least-squares fit on [1, covariates], made on the training rows."""
    e = normal_equations(train, covariates, y)[0]
    if np.linalg.matrix_rank(e["xx"]) < len(covariates) + 1:
        raise ValueError("the covariates are not independent")
    w = np.linalg.solve(e["xx"], e["xy"])
    return tuple(t.withColumn("residual", F.col(y) - linear_prediction(covariates, w)) for t in (train, test))


def residualise_within(rows: DataFrame, y: str, covariate: str, group: str) -> DataFrame:
    """rows with residual: y less its own group's line on one covariate, by built-in aggregates; rounding is cut to 0."""
    fit = rows.groupBy(group).agg(F.regr_slope(y, covariate).alias("_s"), F.regr_intercept(y, covariate).alias("_i"), F.avg(y).alias("_m"), F.max(F.abs(y)).alias("_scale"))
    rest = F.col(y) - F.coalesce(F.col("_i") + F.col("_s") * F.col(covariate), F.col("_m"))
    out = rows.join(fit, group).withColumn("residual", F.when(F.abs(rest) <= 1e-12 * F.col("_scale"), 0.0).otherwise(rest))
    return out.drop("_s", "_i", "_m", "_scale")


def class_scores(rows: DataFrame, columns: Sequence[str], y: str, shrinkage: float | str = 0.1) -> dict:
    """By class, constant and weights of the linear discriminant with shrunken pooled covariance; any number of classes.

    "auto" shrinks by Ledoit and Wolf's estimate from the fourth moments that the
    pooled rows give (J. Multivariate Analysis, 2004).
    """
    parts = {e["key"][0]: e for e in normal_equations(rows.withColumn("_zero", F.lit(0.0)), columns, "_zero", [y])}
    if len(parts) < 2:
        raise ValueError("both classes must be there")
    means = {k: e["xx"][0, 1:] / e["n"] for k, e in parts.items()}
    n, p = sum(e["n"] for e in parts.values()), len(columns)
    pooled = sum(e["xx"][1:, 1:] - e["n"] * np.outer(means[k], means[k]) for k, e in parts.items()) / n
    if shrinkage == "auto":
        centre = rows.sparkSession.createDataFrame([(k, *(float(v) for v in m)) for k, m in means.items()], f"{y} {dict(rows.dtypes)[y]}, " + ", ".join(f"_m{i} double" for i in range(p)))
        square = sum((F.pow(F.col(c) - F.col(f"_m{i}"), 2) for i, c in enumerate(columns)), F.lit(0.0))
        fourth = rows.join(F.broadcast(centre), y).agg(F.sum(F.pow(square, 2)).alias("s")).first()["s"] or 0.0
        mu = np.trace(pooled) / p
        spread = float(((pooled - mu * np.eye(p)) ** 2).sum())
        noise = max((fourth / n - float((pooled**2).sum())) / n, 0.0)
        shrinkage = 0.0 if spread == 0 else min(1.0, noise / spread)
    s = (1 - shrinkage) * pooled + shrinkage * np.trace(pooled) / p * np.eye(p)
    inverse = np.linalg.pinv(s)
    return {k: np.r_[-m @ inverse @ m / 2 + np.log(parts[k]["n"] / n), inverse @ m] for k, m in means.items()}


def lda(rows: DataFrame, columns: Sequence[str], y: str, shrinkage: float | str = 0.1) -> np.ndarray:
    """Constant and weights of the two-class discriminant: class 1 against class 0."""
    scores = class_scores(rows, columns, y, shrinkage)
    if set(scores) != {0, 1}:
        raise ValueError("both classes must be there")
    return scores[1] - scores[0]


def lda_label(columns: Sequence[str], scores: dict) -> Column:
    """The class of the greatest discriminant, the smaller on a tie."""
    names = sorted(scores)
    values = [linear_prediction(columns, scores[k]) for k in names]
    top = F.greatest(*values) if len(values) > 1 else values[0]
    return F.coalesce(*(F.when(v == top, F.lit(k)) for k, v in zip(names, values)))


# pyspark.ml ---------------------------------------------------------------------------


def _tree(params: dict) -> dict:
    """Sizes of trees in Spark ML's terms: a leaf count bounds the depth, a least split is two least leaves, no depth is the deepest that there is."""
    depth = params.get("max_depth", 5)
    if "max_leaf_nodes" in params:
        depth = max(1, int(np.ceil(np.log2(params["max_leaf_nodes"]))))
    leaf = max(params.get("min_samples_leaf", 1), -(-params.get("min_samples_split", 2) // 2))
    return {"maxDepth": 30 if depth is None else depth, "minInstancesPerNode": leaf}


def regressor(kind: str, seed: int = 42, **params):
    """An estimator of pyspark.ml by name: elasticnet, random_forest, gradient_boosting, svr.

    svr is approximate: penalised least squares on random Fourier features of the
    radial kernel, as Spark has no epsilon-insensitive loss; its epsilon is not used.
    Nor is l2_regularization, which Spark's boosting does not have.
    """
    if kind == "elasticnet":
        return LinearRegression(labelCol="y", predictionCol="p", elasticNetParam=params.get("l1_ratio", 0.5), regParam=params.get("alpha", 0.1), maxIter=params.get("max_iter", 100), tol=params.get("tol", 1e-6))
    if kind == "random_forest":
        return RandomForestRegressor(labelCol="y", predictionCol="p", numTrees=params.get("n_estimators", 100), seed=seed, **_tree(params))
    if kind == "gradient_boosting":
        return GBTRegressor(labelCol="y", predictionCol="p", maxIter=params.get("max_iter", 20), stepSize=params.get("learning_rate", 0.1), seed=seed, **_tree({"max_depth": 3} | params))
    if kind == "svr":
        lift = FourierFeatures(params.get("gamma", "scale"), params.get("components", 200), seed)
        return Pipeline(stages=[lift, LinearRegression(featuresCol="lifted", labelCol="y", predictionCol="p", standardization=False, regParam=1.0 / params.get("C", 1.0) / params.get("n", 100.0), solver="l-bfgs", maxIter=params.get("max_iter", 200))])
    raise ValueError(f"unknown regressor {kind!r}")


def classifier(kind: str, seed: int = 42, **params):
    """logistic, svm, random_forest, gradient_boosting; weights from the column weight.

    With a gamma, svm is a margin on random Fourier features of its radial kernel; else it is linear.
    """
    if kind == "logistic":
        return LogisticRegression(labelCol="y", predictionCol="p", weightCol="weight", elasticNetParam=params.get("l1_ratio", 0.0), regParam=1.0 / params.get("C", 1.0) / params.get("n", 1.0), maxIter=params.get("max_iter", 100))
    if kind == "svm":
        margin = LinearSVC(labelCol="y", predictionCol="p", weightCol="weight", regParam=params.get("reg", 0.01) / params.get("C", 1.0), maxIter=params.get("max_iter", 50))
        if "gamma" not in params:
            return margin
        return Pipeline(stages=[FourierFeatures(params["gamma"], params.get("components", 200), seed), margin.setFeaturesCol("lifted").setStandardization(False)])
    if kind == "random_forest":
        return RandomForestClassifier(labelCol="y", predictionCol="p", weightCol="weight", numTrees=params.get("n_estimators", 100), seed=seed, **_tree(params))
    if kind == "gradient_boosting":
        return GBTClassifier(labelCol="y", predictionCol="p", weightCol="weight", maxIter=params.get("max_iter", 20), seed=seed, **_tree({"max_depth": 3} | params))
    raise ValueError(f"unknown classifier {kind!r}")


def balanced_weights(rows: DataFrame, y: str = "y") -> DataFrame:
    """rows with weight: n over classes times the class's size."""
    sizes = rows.groupBy(y).agg(F.count("*").alias("_k"))
    total = sizes.agg(F.sum("_k").alias("_n"), F.count("*").alias("_c"))
    return rows.join(F.broadcast(sizes), y).join(F.broadcast(total)).withColumn("weight", F.col("_n") / (F.col("_c") * F.col("_k"))).drop("_k", "_n", "_c")


def undersample(rows: DataFrame, key: str, y: str = "y", seed: int = 42) -> DataFrame:
    """As many rows of each class as of the smallest: those of least hash, then least key.

    The hash at which a class has enough rows is found by counting hashes, so that
    no task sorts a class.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    sizes = rows.groupBy(y).agg(F.count("*").alias("_k"))
    least = sizes.agg(F.min("_k")).first()[0] or 0
    # A hash of 64 bits is a row's own but for repeated keys, of which whole groups are kept or left; those are ordered by place.
    placed = rows.withColumns({"_h": h, "_bucket": F.shiftrightunsigned(h.bitwiseXOR(F.lit(-(1 << 63))), 52)})
    counts = placed.groupBy(y, "_bucket").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(y).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("_upto", F.sum("_c").over(w)).withColumn("_before", F.col("_upto") - F.col("_c"))
    out = placed.join(upto.where(F.col("_before") < least), [y, "_bucket"])
    rank = F.row_number().over(Window.partitionBy(y, "_bucket").orderBy("_h", key))
    return out.withColumn("_rank", F.when(F.col("_upto") > least, rank).otherwise(0)).where(F.col("_rank") <= least - F.col("_before")).drop("_h", "_bucket", "_c", "_upto", "_before", "_rank").select(*rows.columns)


def cross_fit(rows: DataFrame, folds: Sequence, fold: str, make: Callable[[], list], columns: Sequence[str], prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Held-out predictions of a pipeline, each fold fitted on the others; columns are kept beside p."""
    out = None
    for k in folds:
        model = Pipeline(stages=make()).fit(prepare(rows.where(F.col(fold) != k)))
        one = model.transform(rows.where(F.col(fold) == k)).select(*columns, "p")
        out = one if out is None else out.unionByName(one)
    return out


def vote(members: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Majority of members' labels p, the smaller label on a tie."""
    rows = None
    for m in members:
        one = m.select(*key, F.col("p").cast("int").alias("p"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*key).agg(F.mode("p", True).alias("p"))


def soft_vote(members: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Mean of members' probabilities, and the label that it says."""
    rows = None
    for m in members:
        one = m.select(*key, F.col("probability").cast("double").alias("q"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*key).agg(F.avg("q").alias("probability")).withColumn("p", (F.col("probability") >= 0.5).cast("int"))


# Rows that repeat ----------------------------------------------------------------------


def counted(rows: DataFrame, columns: Sequence[str], y: str = "y") -> DataFrame:
    """The distinct rows over columns and y, written: n, how many rows each stands for, and weight, n by balanced classes."""
    groups = cut(rows.where(F.col(y).isNotNull()).groupBy(*columns, y).agg(F.count("*").alias("n")), "counted")
    sizes = groups.groupBy(y).agg(F.sum("n").alias("_k"))
    total = sizes.agg(F.sum("_k").alias("_n"), F.count("*").alias("_c"))
    return cut(groups.join(F.broadcast(sizes), y).join(F.broadcast(total)).withColumn("weight", F.col("n") * F.col("_n") / (F.col("_c") * F.col("_k"))).drop("_k", "_n", "_c"), "weighted")


def counted_preparation(groups: DataFrame, features: Sequence[str]) -> list[Column]:
    """preparation()'s columns by counted rows: the (lower) median where one is missing, constant ones out, mean 0 and deviation 1."""
    there = lambda f: F.col(f).isNotNull() & ~F.isnan(f)
    lacks = groups.agg(*(F.max((~there(f)).cast("int")).alias(f) for f in features)).first()
    full = []
    for f in features:
        full.append(F.col(f))
        if lacks[f]:
            values = groups.where(there(f)).groupBy(f).agg(F.sum("n").alias("_c"))
            half = values.agg(F.sum("_c")).first()[0] / 2
            full[-1] = F.when(there(f), F.col(f)).otherwise(F.lit(running_sums(values, f, {"_upto": "_c"}).where(F.col("_upto") >= half).agg(F.min(f)).first()[0]))
    n = F.sum("n")
    means = groups.agg(*((F.sum(F.col("n") * x) / n).alias(f"m{i}") for i, x in enumerate(full))).first()
    spread = groups.agg(*((F.sum(F.col("n") * F.pow(x - float(means[i]), 2)) / (n - 1)).alias(f"v{i}") for i, x in enumerate(full))).first()
    return [(x - float(m)) / float(np.sqrt(v)) for x, m, v in zip(full, means, spread) if v > 0]


def resampled(groups: DataFrame, columns: Sequence[str], draws: int, seed: int = 42) -> DataFrame:
    """groups with times, for each draw how often the group's n rows are drawn: a sum of n Poisson numbers, by a hash of the group."""

    @F.pandas_udf("array<bigint>")
    def drawn(h: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng(k & (2**64 - 1)).poisson(m, draws) for k, m in zip(h.tolist(), n.tolist())])

    return groups.withColumn("times", drawn(F.xxhash64(F.lit(seed), *columns), "n"))


#: Distinct rows up to which their votes are broadcast to the rows.
FEW = 200_000


def counted_vote(
    rows: DataFrame, folds: Sequence, fold: str, features: Sequence[str], key: Sequence[str], members: Sequence[tuple[str, Mapping]], y: str = "y", seed: int = 42, threads: int = 6
) -> DataFrame:
    """vote() of cross-fitted classifiers of labels 0 and 1, by the distinct rows: key, p.

    Rows that are equal in fold, features and label are one row of that weight to
    the members, as their sums are the same; a forest's trees draw the rows that a
    distinct one stands for. A label is told once for each distinct row and joined
    to all rows. Classes are balanced over all rows.
    """
    trees = {m: params.get("n_estimators", 100) for m, (kind, params) in enumerate(members) if kind == "random_forest"}
    groups = counted(rows, [fold, *features], y)
    groups = cut(resampled(groups, [fold, *features, y], sum(trees.values()), seed), "resampled")
    first = dict(zip(trees, np.cumsum([0, *trees.values()]).tolist()))

    def prepare(k):
        train = groups.where(F.col(fold) != k)
        x = counted_preparation(train, features)
        assembled = lambda d: VectorAssembler(inputCols=[f"_x{i}" for i in range(len(x))], outputCol="features").transform(d.withColumns({f"_x{i}": c for i, c in enumerate(x)}))
        return assembled(train), assembled(groups.where(F.col(fold) == k).select(fold, *features).distinct())

    def fit(job):
        k, m, t = job
        kind, params = members[m]
        if kind != "random_forest":
            return classifier(kind, seed, **params).setPredictionCol("_p").fit(made[k][0])
        train = made[k][0].withColumn("weight", F.col("weight") / F.col("n") * F.get("times", F.lit(first[m] + t))).where("weight > 0")
        one = classifier(kind, seed + t, **(dict(params) | {"n_estimators": 1}))
        return one.setBootstrap(False).setFeatureSubsetStrategy("sqrt" if trees[m] > 1 else "all").setPredictionCol("_p").fit(train)

    with ThreadPoolExecutor(threads) as pool:
        made = dict(zip(folds, pool.map(prepare, folds)))
        jobs = [(k, m, t) for k in folds for m in range(len(members)) for t in range(trees.get(m, 1))]
        models = dict(zip(jobs, pool.map(fit, jobs)))
    told = None
    for k in folds:
        d = made[k][1]
        for m in range(len(members)):
            for t in range(trees.get(m, 1)):
                out = models[k, m, t].transform(d)
                # A tree says the share of label 1, which training rows of one label leave out.
                said = F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0)) if m in trees else F.col("_p")
                d = out.withColumn(f"_s{m}_{t}", said).drop("_p", "rawPrediction", "probability")
        label = [(2 * sum((F.col(f"_s{m}_{t}") for t in range(1, n)), F.col(f"_s{m}_0")) > n).cast("int") for m, n in ((m, trees.get(m, 1)) for m in range(len(members)))]
        one = d.select(fold, *features, sum(label[1:], label[0]).alias("_ones"))
        told = one if told is None else told.unionByName(one)
    told = cut(told, "told")
    few = F.broadcast(told) if told.count() <= FEW else told
    same = [rows[c].eqNullSafe(told[c]) for c in (fold, *features)]
    votes = rows.where(F.col(y).isNotNull()).join(few, same).select(*(rows[c] for c in key), "_ones")
    return votes.groupBy(*key).agg((2 * F.sum("_ones") > len(members) * F.count("*")).cast("int").alias("p"))


def shap_linear(rows: DataFrame, columns: Sequence[str], w: Sequence[float]) -> DataFrame:
    """(feature, importance): mean |weight times the distance from the mean| of a linear model."""
    means = rows.agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)))
    both = rows.join(F.broadcast(means))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.abs((F.col(c) - F.col(f"_m{i}")) * float(v)).alias("s")) for i, (c, v) in enumerate(zip(columns, w)))))
    return both.select(cells.alias("c")).select("c.*").groupBy("feature").agg(F.avg("s").alias("importance"))


def explained(rows: DataFrame, y: str, p: str) -> Column:
    return 1 - divide(F.sum(F.pow(F.col(y) - F.col(p), 2)), F.var_pop(y) * F.count(y))
