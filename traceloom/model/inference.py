"""Nulls, intervals, screens: draws by number and hash, so that any task makes the same ones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions.numeric import bh_adjust, blank, divide, fisher_z, running_sums, safe_pearson

EPS = 100 * 2.220446049250313e-16


def draw_number(*parts: Column, seed: int, modulus: int = 2147483648) -> Column:
    """A whole number from draw and unit numbers: products with odd constants, mixed twice."""
    x: Column = F.lit(seed * 69069 + 1).cast("bigint")
    for p in parts:
        x = F.pmod(x * 1103515245 + p.cast("bigint") * 40692 + 12345, F.lit(2147483648))
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, 13)) * 69069 + 7, F.lit(2147483648))
    return F.pmod(x.bitwiseXOR(F.shiftright(x, 15)), F.lit(modulus))


def draw_numbers(draw: int, units: np.ndarray, seed: int) -> np.ndarray:
    """draw_number of one draw and many units, on arrays."""
    x = np.full(len(units), seed * 69069 + 1, dtype=np.int64)
    for part in (np.full(len(units), draw, dtype=np.int64), units.astype(np.int64)):
        x = (x * 1103515245 + part * 40692 + 12345) % 2147483648
        x = ((x ^ (x >> 13)) * 69069 + 7) % 2147483648
    return (x ^ (x >> 15)) % 2147483648


def bootstrap_mean_ci(values: DataFrame, value: str = "value", iterations: int = 1000, seed: int = 42) -> DataFrame:
    """One row: mean, ci_low, ci_high of a percentile bootstrap over the (numbered) values.

    values has unit numbers 0.. in `unit`. Each draw looks its units up by number.
    """
    n = values.count()
    if n == 0:
        raise ValueError("no values to resample")
    draws = values.sparkSession.range(iterations).withColumnRenamed("id", "draw").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    picked = draws.withColumn("unit", draw_number(F.col("draw"), F.col("slot"), seed=seed, modulus=n)).join(values.select(F.col("unit").cast("bigint").alias("unit"), F.col(value).alias("v")), "unit")
    means = picked.groupBy("draw").agg(F.avg("v").alias("m"))
    ends = means.agg(F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"))
    return values.agg(F.avg(value).alias("mean")).join(ends)


def sign_flip_p(differences: DataFrame, value: str = "value", iterations: int = 1000, seed: int = 42) -> DataFrame:
    """One row: mean and p of random sign flips of paired differences, with ties counted."""
    draws = F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("draw")
    flips = differences.select("unit", F.col(value).alias("v"), draws)
    sign = F.when(draw_number(F.col("draw"), F.col("unit"), seed=seed, modulus=2) == 0, -1.0).otherwise(1.0)
    null = flips.groupBy("draw").agg(F.avg(F.col("v") * sign).alias("m"))
    seen = differences.agg(F.avg(value).alias("mean"))
    over = F.abs("m") >= F.abs("mean") - EPS * F.abs("mean")
    return null.join(F.broadcast(seen)).groupBy("mean").agg(((F.count_if(over) + 1) / F.lit(iterations + 1.0)).alias("p"))


def circular_permutation(rows: DataFrame, blocks: Sequence[str], order: Sequence[str], value: str, shift: Column | int, least: int = 8) -> DataFrame:
    """rows with permuted: the value that lies `shift` places before in the row's block, cyclically.

    Blocks with fewer than `least` finite values keep theirs.
    """
    w = Window.partitionBy(*blocks).orderBy(*order)
    own = Window.partitionBy(*blocks)
    placed = rows.withColumns({"_pos": F.row_number().over(w) - 1, "_n": F.count("*").over(own), "_fine": F.count(blank(value)).over(own)})
    moved = placed.select(*blocks, F.pmod(F.col("_pos") + shift, F.col("_n")).cast("int").alias("_pos"), F.col(value).alias("_moved"))
    out = placed.join(moved, [*blocks, "_pos"])
    return out.withColumn("permuted", F.when(F.col("_fine") >= least, F.col("_moved")).otherwise(F.col(value))).drop("_pos", "_n", "_fine", "_moved")


def block_permutation(rows: DataFrame, blocks: Sequence[str], order: str, value: str, draw: int, seed: int = 42) -> DataFrame:
    """rows with permuted: values rearranged within blocks by the hashed order of one draw."""
    by_order = Window.partitionBy(*blocks).orderBy(order)
    by_draw = Window.partitionBy(*blocks).orderBy(draw_number(F.lit(draw), F.col(order), seed=seed), order)
    placed = rows.withColumn("_pos", F.row_number().over(by_order))
    dealt = rows.select(*blocks, F.row_number().over(by_draw).alias("_pos"), F.col(value).alias("permuted"))
    return placed.join(dealt, [*blocks, "_pos"]).drop("_pos")


def changed_fraction(rows: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of finite positions whose value changed."""
    return rows.where(blank(a).isNotNull() & blank(b).isNotNull()).groupBy(*by).agg(F.avg((F.col(a) != F.col(b)).cast("int")).alias("changed"))


def conformal_quantile(residuals: DataFrame, value: str, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, quantile): the ceil((n + 1)(1 - alpha))-th smallest residual; infinite if there are too few."""
    counts = residuals.groupBy(*by, value).agg(F.count("*").alias("k"))
    upto = running_sums(counts, value, {"upto": "k"}, list(by))
    total = residuals.groupBy(*by).agg(F.count("*").alias("n"))
    ranked = upto.join(total, list(by)) if by else upto.join(F.broadcast(total))
    need = F.ceil((F.col("n") + 1) * (1 - alpha) - 1e-9)
    return ranked.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("upto") >= need, F.col(value))), F.lit(float("inf"))).alias("quantile"))


def split_conformal(calibration: DataFrame, test: DataFrame, alpha: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """test with lower and upper bounds around p, from the calibration rows' absolute residuals."""
    q = conformal_quantile(calibration.withColumn("_r", F.abs(F.col("y") - F.col("p"))), "_r", alpha, by)
    out = test.join(q, list(by)) if by else test.join(F.broadcast(q))
    return out.withColumns({"lower": F.col("p") - F.col("quantile"), "upper": F.col("p") + F.col("quantile")}).drop("quantile")


#: Distinct residuals whose sorted values and counts are sent to the tasks, in 64 MB at most.
MOST_RESIDUALS = 4_000_000


def cv_plus(test_predictions: DataFrame, residuals: DataFrame, alpha: float = 0.1, key: str = "row") -> DataFrame:
    """(key, lower, upper): order statistics of the folds' predictions minus and plus their residuals.

    test_predictions: key, fold, p. residuals: fold, r. The folds' distinct
    residuals are counted and sorted once; a row's ends are found by halving and
    counting in each fold, so no row meets all residuals. Beyond MOST_RESIDUALS
    distinct ones they are joined to the rows as arrays.
    """
    counts = residuals.groupBy("fold", "r").agg(F.count("*").alias("k"))
    if counts.count() > MOST_RESIDUALS:
        return _cv_plus_joined(test_predictions, residuals, alpha, key)
    table = counts.orderBy("fold", "r").toArrow()
    names, at, k = (table[c].to_numpy() for c in ("fold", "r", "k"))
    folds = {f: (at[names == f].astype(float), np.cumsum(k[names == f])) for f in np.unique(names).tolist()}
    kept = test_predictions.sparkSession.sparkContext.broadcast(folds)

    def ends(rows: pd.DataFrame) -> pd.DataFrame:
        both = rows.explode("cells", ignore_index=False)
        place = both.index.to_numpy()
        fold, p = (np.array([c[x] for c in both["cells"]]) for x in ("fold", "p"))
        n = np.zeros(len(rows))
        own = [(kept.value[f], fold == f) for f in np.unique(fold).tolist() if f in kept.value]
        for (_, upto), of in own:
            np.add.at(n, place[of], upto[-1])
        out = []
        # The k-th smallest of p + s r; for s = -1 the residuals run backwards.
        for s, rank in ((-1.0, np.floor(alpha * (n + 1) + 1e-9)), (1.0, np.ceil((1 - alpha) * (n + 1) - 1e-9))):
            sides = []
            for (r, upto), of in own:
                v = r if s > 0 else -r[::-1]
                c = upto if s > 0 else upto[-1] - np.r_[0, upto[:-1]][::-1]
                sides.append((v, np.r_[0, c], of))
            lo = np.full(len(rows), np.inf)
            hi = np.full(len(rows), -np.inf)
            for v, _, of in sides:
                np.minimum.at(lo, place[of], p[of] + v[0])
                np.maximum.at(hi, place[of], p[of] + v[-1])
            lo = lo - 1.0
            for _ in range(100):
                mid = lo + (hi - lo) / 2
                seen = np.zeros(len(rows))
                for v, c, of in sides:
                    np.add.at(seen, place[of], c[np.searchsorted(v, mid[place[of]] - p[of], side="right")])
                enough = seen >= rank
                lo, hi = np.where(enough, lo, mid), np.where(enough, mid, hi)
            # The end itself: the sum nearest to where the halving stopped.
            near, gap = hi.copy(), np.full(len(rows), np.inf)
            for v, _, of in sides:
                i = np.searchsorted(v, hi[place[of]] - p[of])
                for j in (-1, 0, 1):
                    value = p[of] + v[np.clip(i + j, 0, len(v) - 1)]
                    d = np.abs(value - hi[place[of]])
                    for q, x, y in zip(place[of].tolist(), value.tolist(), d.tolist()):
                        if y < gap[q]:
                            near[q], gap[q] = x, y
            out.append(np.where(rank < 1, -np.inf, np.where(rank > n, np.inf, near)))
        return pd.DataFrame({key: rows[key], "lower": out[0], "upper": out[1]})

    def run(batches):
        for rows in batches:
            if len(rows):
                yield ends(rows.reset_index(drop=True))

    cells = test_predictions.groupBy(key).agg(F.collect_list(F.struct("fold", F.col("p").cast("double").alias("p"))).alias("cells"))
    return cells.mapInPandas(run, f"`{key}` {dict(test_predictions.dtypes)[key]}, lower double, upper double")


def _cv_plus_joined(test_predictions: DataFrame, residuals: DataFrame, alpha: float, key: str) -> DataFrame:
    arrays = residuals.groupBy("fold").agg(F.collect_list("r").alias("rs"))
    both = test_predictions.join(arrays, "fold")
    cells = both.select(key, F.transform("rs", lambda r: F.col("p") - r).alias("lo"), F.transform("rs", lambda r: F.col("p") + r).alias("hi"))
    whole = cells.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("lo"))).alias("lo"), F.array_sort(F.flatten(F.collect_list("hi"))).alias("hi"))
    n = F.size("lo")
    low, high = F.floor(alpha * (n + 1) + 1e-9).cast("int"), F.ceil((1 - alpha) * (n + 1) - 1e-9).cast("int")
    return whole.select(
        key, F.when(low >= 1, F.get("lo", low - 1)).otherwise(F.lit(float("-inf"))).alias("lower"), F.when(high <= n, F.get("hi", high - 1)).otherwise(F.lit(float("inf"))).alias("upper")
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    from math import exp, lgamma, log

    if not np.isfinite(t) or df <= 0:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x <= 0 or x >= 1:
        return float(x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def univariate_screen(cells: DataFrame, flips: int = 1000, seed: int = 42) -> DataFrame:
    """By feature: mean z, t and p over subjects' correlations with y, family-wise p and q.

    cells: feature, subject, value, y. The family-wise p is that of the largest
    |t| among the features under random sign flips of whole subjects.
    """
    own = cells.groupBy("feature", "subject").agg(fisher_z(safe_pearson("value", "y")).alias("z")).where("z is not null")
    number = own.select("subject").distinct().withColumn("unit", F.row_number().over(Window.orderBy("subject")))
    own = own.join(number, "subject")

    def t_of(v: Column) -> Column:
        return divide(F.avg(v), F.stddev_samp(v) / F.sqrt(F.count(v)))

    seen = own.groupBy("feature").agg(F.avg("z").alias("mean_z"), t_of(F.col("z")).alias("t"), F.count("z").alias("n"))
    draws = own.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(flips))))
    sign = F.when(draw_number(F.col("draw"), F.col("unit"), seed=seed, modulus=2) == 0, -1.0).otherwise(1.0)
    top = draws.withColumn("f", F.col("z") * sign).groupBy("draw", "feature").agg(t_of(F.col("f")).alias("t")).groupBy("draw").agg(F.max(F.abs("t")).alias("top"))
    over = F.col("top") >= F.abs("t") - EPS * F.abs("t")
    fwer = seen.join(top).groupBy("feature").agg(((F.count_if(over) + 1) / F.lit(flips + 1.0)).alias("p_fwer"))

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([student_p(a, b - 1) if a is not None else float("nan") for a, b in zip(t, n)])

    found = seen.join(fwer, "feature").withColumn("p", blank(p_value("t", "n")))
    return bh_adjust(found, "p", "q")


def importance_by(importance: DataFrame, meta: DataFrame, field: str, validate: bool = False) -> DataFrame:
    """Sum of features' importance over a metadata field."""
    rows = importance.join(meta.select("feature", field), "feature")
    if validate and not rows.where(blank("importance").isNull()).isEmpty():
        raise ValueError("an importance is missing")
    return rows.groupBy(field).agg(F.sum("importance").alias("importance"))


def importance_over_folds(rows: DataFrame, features: Sequence[str], fold: str, fit, score, order: str, repeats: int = 10, seed: int = 42, least: float = 0.5) -> DataFrame:
    """(feature, importance, n_folds): mean drop of a score when a column of a fold's held-out rows is rearranged, for any model.

    fit(train) gives a function from rows to rows with p; score(rows) an aggregate
    of y and p. A feature that under `least` of the folds can judge has no importance.
    """
    folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    out = None
    for k in folds:
        held, predict = rows.where(F.col(fold) == k), fit(rows.where(F.col(fold) != k))
        base, blocks = predict(held).agg(score.alias("base")), max(1, held.count() // BLOCK_ROWS)
        for f in features:
            for i in range(repeats):
                moved = block_permutation(held.withColumn("_block", F.pmod(F.xxhash64(F.lit(i), F.col(order)), F.lit(blocks))), ["_block"], order, f, i, seed).drop("_block")
                one = predict(moved.drop(f).withColumnRenamed("permuted", f)).agg(score.alias("s")).join(base).select(F.lit(f).alias("feature"), F.lit(str(k)).alias("fold"), (F.col("base") - F.col("s")).alias("drop"))
                out = one if out is None else out.unionByName(one)
    own = out.groupBy("feature", "fold").agg(F.avg("drop").alias("drop"))
    return own.groupBy("feature").agg(F.when(F.count("drop") >= least * len(folds), F.avg("drop")).alias("importance"), F.count("drop").alias("n_folds"))


def shap_over_folds(rows: DataFrame, columns: Sequence[str], fold: str, weights, least: float = 0.5) -> DataFrame:
    """(feature, importance, n_folds): mean over folds of a linear model's attributions on held-out rows; weights(train) gives constant and weights."""
    from traceloom.model.estimators import shap_linear

    folds = [r[0] for r in rows.select(fold).distinct().orderBy(fold).collect()]
    out = None
    for k in folds:
        w = weights(rows.where(F.col(fold) != k))
        one = shap_linear(rows.where(F.col(fold) == k), columns, w[1:])
        out = one if out is None else out.unionByName(one)
    return out.groupBy("feature").agg(F.when(F.count("importance") >= least * len(folds), F.avg("importance")).alias("importance"), F.count("importance").alias("n_folds"))


#: Rows of a block within which a column is rearranged.
BLOCK_ROWS = 100_000


def permutation_importance(rows: DataFrame, features: Sequence[str], weights: Sequence[float], bias: float, order: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance): mean drop of r^2 of a linear model when a column is rearranged.

    Columns are rearranged within random blocks of about BLOCK_ROWS rows.
    """
    total = lambda skip=None, moved=None: sum(((F.col(moved) if f == skip else F.col(f)) * float(w) for f, w in zip(features, weights)), F.lit(float(bias)))
    r2 = lambda p: 1 - divide(F.sum(F.pow(F.col("y") - p, 2)), F.var_pop("y") * F.count("y"))
    base = rows.agg(r2(total()).alias("base"))
    blocks = max(1, rows.count() // BLOCK_ROWS)
    out = None
    for f in features:
        for k in range(repeats):
            moved = block_permutation(rows.withColumn("_block", F.pmod(F.xxhash64(F.lit(k), F.col(order)), F.lit(blocks))), ["_block"], order, f, k, seed)
            one = moved.agg(r2(total(f, "permuted")).alias("s")).select(F.lit(f).alias("feature"), "s")
            out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(base)).groupBy("feature").agg(F.avg(F.col("base") - F.col("s")).alias("importance"))
