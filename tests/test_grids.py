"""Grids value by value, and estimators beyond two columns or classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.functions.numeric import exact_quantiles
from traceloom.model import estimators as E
from traceloom.model import workflow as W


def test_grids():
    assert [g["alpha"] for g in E.ridge_grid(10, 3)] == pytest.approx([30 * 10.0**k for k in range(-6, 2)])
    assert [g["alpha"] for g in E.scaled_ridge_grid()] == pytest.approx([10.0**k for k in range(-6, 2)])
    values = lambda g, k: sorted({x[k] for x in g}, key=str)
    net = E.elasticnet_grid()
    assert len(net) == 15 and values(net, "alpha") == [0.001, 0.01, 0.1, 1.0, 10.0] and values(net, "l1_ratio") == [0.2, 0.5, 0.8]
    assert [g["C"] for g in E.logistic_grid()] == [0.01, 0.1, 1.0, 10.0] and E.logistic_grid("none") == []
    assert len(E.logistic_grid("elasticnet")) == 12 and values(E.logistic_grid("elasticnet"), "l1_ratio") == [0.1, 0.5, 0.9]
    forest = E.random_forest_grid()
    assert len(forest) == 36 and values(forest, "max_depth") == [10, 20, 5, None] and values(forest, "min_samples_split") == [10, 2, 5] and values(forest, "min_samples_leaf") == [1, 2, 4]
    boost = E.hist_gradient_boosting_grid()
    assert len(boost) == 16 and values(boost, "max_iter") == [100, 200] and values(boost, "max_leaf_nodes") == [15, 7] and values(boost, "min_samples_leaf") == [10, 20] and values(boost, "l2_regularization") == [0.0, 1.0]
    assert len(E.svm_grid()) == 6 and values(E.svm_grid(), "gamma") == ["auto", "scale"]
    assert len(E.svr_grid()) == 18 and values(E.svr_grid(), "gamma") == [0.01, 0.1, "scale"] and values(E.svr_grid(), "epsilon") == [0.01, 0.1]
    assert [g["shrinkage"] for g in E.lda_grid()] == ["auto", 0.1, 0.5, 0.9]
    assert [W.default_grid(k) for k in ("elasticnet", "logistic", "random_forest", "gradient_boosting", "svm", "svr", "lda")] == [net, E.logistic_grid(), forest, boost, E.svm_grid(), E.svr_grid(), E.lda_grid()]


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 30))
    y = x @ rng.normal(size=30) + rng.normal(size=200)
    names = [f"c{k}" for k in range(30)]
    rows = [(i, f"g{i % 3}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row int, g string, " + ", ".join(f"{n} double" for n in names) + ", y double").repartition(3), names


def test_many_columns_are_summed_as_few(wide):
    rows, names = wide
    d = rows.toPandas()
    parts = {e["key"][0]: e for e in E.normal_equations(rows, names, "y", ["g"])}
    for g, own in d.groupby("g"):
        a = np.c_[np.ones(len(own)), own[names].to_numpy()]
        e = parts[g]
        assert e["n"] == len(own) and np.allclose(e["xx"], a.T @ a) and np.allclose(e["xy"], a.T @ own["y"]) and e["yy"] == pytest.approx((own["y"] ** 2).sum())
    few = E.normal_equations(rows, names[:3], "y")[0]
    assert np.allclose(E.normal_equations(rows, names, "y")[0]["xx"][:4, :4], few["xx"])
    assert E.cross_fit_ridge(rows, names, "y", "g", [1.0])[0].where("p is null").count() == 0


def test_discriminants_of_three_classes(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [6, 0], [0, 6]])
    rows = [(i, int(k), *map(float, centres[k] + rng.normal(size=2))) for i, k in enumerate(rng.integers(0, 3, 300))]
    df = spark.createDataFrame(rows, "row int, y int, a double, b double")
    for shrinkage in (0.1, "auto", 0.9):
        scores = E.class_scores(df, ["a", "b"], "y", shrinkage)
        assert df.withColumn("p", E.lda_label(["a", "b"], scores)).where("p = y").count() >= 290
    with pytest.raises(ValueError):
        E.lda(df, ["a", "b"], "y")


def test_radial_kernels_bend(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    r = (x**2).sum(axis=1)
    df = spark.createDataFrame([(i, i % 3, float(a), float(b), float(v > 1.4), float(np.sin(2 * a))) for i, ((a, b), v) in enumerate(zip(x, r))], "row int, g int, a double, b double, y double, s double").withColumn("weight", F.lit(1.0))
    out = E.cross_fit(df, [0], "g", lambda: [*E.preparation(["a", "b"]), E.classifier("svm", C=10.0, gamma="scale")], ["y"])
    assert out.where("p = y").count() >= 85
    bent = E.cross_fit(df.withColumn("y", F.col("s")), [0], "g", lambda: [*E.preparation(["a", "b"]), E.regressor("svr", C=10.0, gamma="scale")], ["y"])
    assert bent.agg(E.explained(bent, "y", "p")).first()[0] > 0.7


def test_undersampling_is_exact(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0), "x") for i in range(1000)], "row int, y int, z string").repartition(4)
    out = E.undersample(df, "row")
    assert out.columns == df.columns and {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 143, 1: 143}
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, E.undersample(df.repartition(2), "row").collect()))


def test_quantiles_are_numpys(spark):
    rng = np.random.default_rng(4)
    data = [(f"g{i % 3}", None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(rng.integers(0, 9))) for i in range(300)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    fine = lambda g: [v for k, v in data if (g is None or k == g) and v is not None and v == v]
    for r in exact_quantiles(df, "v", probabilities, ["g"]).collect():
        assert r["quantiles"] == pytest.approx(np.quantile(fine(r["g"]), probabilities))
    assert exact_quantiles(df, "v", probabilities).first()["quantiles"] == pytest.approx(np.quantile(fine(None), probabilities))


def test_recipes_tune_over_whole_grids(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 2))
    df = spark.createDataFrame([(i, i % 3, float(a), float(b), float(2 * a + rng.normal())) for i, (a, b) in enumerate(x)], "row int, g int, a double, b double, y double").cache()
    seen = []
    real = W.E.regressor
    W.E.regressor = lambda kind, **k: (seen.append(tuple(sorted(k.items()))), real(kind, **k))[1]
    try:
        W.run_model(df, W.load_model_recipe({"task": "regression", "target": "y", "group": "g", "features": ["a", "b"], "models": ["elasticnet"], "inner_splits": 2}))
    finally:
        W.E.regressor = real
    assert set(seen) == {tuple(sorted(c.items())) for c in E.elasticnet_grid()}
