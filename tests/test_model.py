"""Modelling: estimators against NumPy, folds without leaks, statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.model import estimators as E
from traceloom.model import inference as I
from traceloom.model import metrics as M
from traceloom.model import splits as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = 3 + x @ [2.0, -1.0] + 0.1 * rng.normal(size=60)
    data = [(i, i % 4, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "row int, subject int, a double, b double, y double").cache()


def _numpy_ridge(x, y, alpha):
    m, s = x.mean(axis=0), x.std(axis=0)
    z = (x - m) / s
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / s
    return np.r_[y.mean() - m @ w, w]


def test_ridge_is_numpys(rows):
    d = rows.toPandas()
    e = E.normal_equations(rows, ["a", "b"], "y")[0]
    assert E.solve_ridge(e, 5.0) == pytest.approx(_numpy_ridge(d[["a", "b"]].to_numpy(), d["y"].to_numpy(), 5.0))


def test_cross_fit_never_trains_on_the_tested_group(rows):
    out, chosen = E.cross_fit_ridge(rows, ["a", "b"], "y", "subject", [0.1, 1.0])
    p, d = out.orderBy("row").toPandas(), rows.orderBy("row").toPandas()
    assert len(p) == 60 and set(chosen) == {0, 1, 2, 3}
    for g in range(4):
        t = d[d.subject != g]
        w = _numpy_ridge(t[["a", "b"]].to_numpy(), t["y"].to_numpy(), chosen[g])
        own = p[p.subject == g]
        assert own["p"].to_numpy() == pytest.approx(w[0] + own[["a", "b"]].to_numpy() @ w[1:])


def test_ridge_null_equals_the_loop(rows):
    d = rows.withColumns({"t0": F.col("y"), "t1": -F.col("y") + F.col("a")})
    out = E.ridge_null(d, ["a", "b"], ["t0", "t1"], "subject", 1.0)
    q = d.toPandas()
    for t in ("t0", "t1"):
        sse = 0
        for g in range(4):
            tr, te = q[q.subject != g], q[q.subject == g]
            w = _numpy_ridge(tr[["a", "b"]].to_numpy(), tr[t].to_numpy(), 1.0)
            sse += ((te[t] - w[0] - te[["a", "b"]].to_numpy() @ w[1:]) ** 2).sum()
        assert out[t] == pytest.approx(1 - sse / ((q[t] - q[t].mean()) ** 2).sum())


def test_trained_members_vote(rows):
    d = E.balanced_weights(rows.withColumn("y", (F.col("y") > 3).cast("double")))
    members = [E.cross_fit(d, [0], "subject", lambda k=k, p=p: [*E.preparation(["a", "b"]), E.classifier(k, **p)], ["row", "y"]) for k, p in (("logistic", {}), ("svm", {}), ("random_forest", {"n_estimators": 5}))]
    votes = E.vote([m.drop("y") for m in members], ["row"]).join(members[0].select("row", "y"), "row").toPandas()
    assert (votes["p"] == votes["y"]).mean() > 0.8
    for kind in ("elasticnet", "random_forest", "gradient_boosting"):
        make = lambda kind=kind: [*E.preparation(["a", "b"]), E.regressor(kind, n_estimators=5, alpha=0.01, max_iter=5)]
        assert E.cross_fit(rows, [0], "subject", make, ["row"]).count() == 15


def test_lda_and_columns(rows):
    d = rows.withColumn("y", (F.col("a") > 0).cast("int"))
    w = E.lda(d, ["a", "b"], "y")
    assert abs(w[1]) > 5 * abs(w[2])
    q = E.column_quality(rows.withColumn("c", F.lit(1.0)).withColumn("n", F.when(F.col("row") < 40, F.col("a"))), ["a", "c", "n"], "subject")
    assert {r["feature"] for r in E.keep_columns(q).collect()} == {"a"}
    assert {r["feature"] for r in E.keep_columns(q, max_missing=0.5).collect()} == {"a", "n"}
    assert [r["feature"] for r in E.match_names(q.select("feature"), ["C"]).collect()] == ["c"]


def test_folds(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}", i // 3) for i in range(12)], "row int, subject string, run int")
    loso = S.loso_folds(rows, ["row"])
    assert loso.count() == 36 and loso.where("role = 'test'").count() == 12
    forward = S.forward_folds(rows, ["row"])
    assert forward.where("role = 'test'").count() == 6 and forward.select("fold").distinct().count() == 6
    assert S.forward_folds(rows, ["row"], most=1).select("fold").distinct().count() == 3
    with pytest.raises(ValueError):
        S.balanced_folds(rows, "subject", 4)


def test_student_p():
    for t, df, p in ((0.0, 5, 1.0), (2.0, 10, 0.07338803), (-3.5, 4, 0.02489662), (12.706, 1, 0.05)):
        assert I.student_p(t, df) == pytest.approx(p, abs=1e-5)


def test_undefined_scores_are_skipped(spark):
    rows = spark.createDataFrame([("a", 1, 1, 0.9), ("a", 1, 0, 0.2), ("b", 1, 1, 0.8), ("b", 0, 0, 0.1)], "subject string, y int, p int, score double")
    out = M.classification_metrics(rows, "subject").first()
    assert out["auc"] == 1.0 and out["specificity"] == 1.0 and out["recall"] == 0.75
    with pytest.raises(ValueError):
        M.classification_metrics(rows.withColumn("y", F.lit(2)))


def test_conformal_is_infinite_when_too_few(spark):
    r = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "r double")
    assert I.conformal_quantile(r, "r", 0.05).first()["quantile"] == float("inf")
    assert I.conformal_quantile(r, "r", 0.5).first()["quantile"] == 2.0


def test_rearrangements_keep_blocks(spark):
    rows = spark.createDataFrame([(b, i, float(10 * b + i)) for b in range(2) for i in range(10)], "b int, i int, v double")
    out = I.block_permutation(rows, ["b"], "i", "v", 1).toPandas()
    assert sorted(out["permuted"]) == sorted(out["v"]) and (out["permuted"] // 10 == out["b"]).all() and (out["permuted"] != out["v"]).any()
    moved = I.circular_permutation(rows, ["b"], ["i"], "v", 2).orderBy("b", "i").toPandas()
    assert moved["permuted"].tolist()[:3] == [8.0, 9.0, 0.0]
    assert I.changed_fraction(I.circular_permutation(rows, ["b"], ["i"], "v", 2, least=50), "v", "permuted").first()["changed"] == 0


def test_distinct_rows_vote_as_all_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, size=(900, 2)).astype(float)
    y = (x @ [1.0, 2.0] + rng.normal(size=900) > 4.5).astype(float)
    holes = np.flatnonzero(rng.random(900) < 0.05)
    data = [(i // 2, i % 3, None if i in holes[::2] else float("nan") if i in holes else float(a), float(b), 7.0, float(v)) for i, ((a, b), v) in enumerate(zip(x, y))]
    d = spark.createDataFrame([*data, (9999, None, 1.0, 1.0, 7.0, 1.0), (9998, 0, 1.0, 1.0, 7.0, None)], "row int, subject int, a double, b double, c double, y double")
    linear = [("logistic", {"max_iter": 10})]
    balanced = E.balanced_weights(d)
    make = lambda: [*E.preparation(("a", "b", "c")), E.classifier("logistic", max_iter=10)]
    want = {r["row"]: r["p"] for r in E.vote([E.cross_fit(balanced, [0], "subject", make, ["row"])], ["row"]).collect()}
    got = {r["row"]: r["p"] for r in E.counted_vote(d, [0], "subject", ("a", "b", "c"), ["row"], linear).collect()}
    assert got == want and len(got) == 300 and set(got.values()) == {0, 1}
    groups = E.counted(d, ["subject", "a", "b", "c"])
    assert groups.count() < 150 and groups.agg(F.sum("n")).first()[0] == 901
    forest = E.counted_vote(d, [0], "subject", ("a", "b", "c"), ["row"], [("random_forest", {"n_estimators": 3})]).collect()
    truth = {i // 2: v for i, v in enumerate(y) if i % 3 == 0}
    assert len(forest) == 300 and np.mean([r["p"] == truth[r["row"]] for r in forest]) > 0.8


def test_a_distinct_row_is_drawn_as_the_rows_it_stands_for(spark):
    g = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(400).cast("bigint").alias("n"))
    t = np.array([(r["n"], *r["times"]) for r in E.resampled(g, ["id"], 3).collect()])
    for n in (1, 400):
        own = t[t[:, 0] == n, 1:]
        assert own.mean() == pytest.approx(n, rel=0.08) and own.var() == pytest.approx(n, rel=0.15)
