"""Splits, scorers, nulls, learned features, provenance and the command line."""

import json

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from traceloom.__main__ import JsonReporter, TextReporter, main
from traceloom.functions.dims import Band
from traceloom.model import estimators as E
from traceloom.model import inference as I
from traceloom.model import learned as L
from traceloom.model import records as R
from traceloom.model import splits as S
from traceloom.model import workflow as W
from traceloom.operators import spatial_models as SM
from traceloom.operators import spectral, table
from traceloom.sources import provenance


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(96, 2))
    y = x[:, 0] + 0.5 * rng.normal(size=96)
    data = [(i, f"s{i % 4}", (i // 4) % 3, float(a), float(b), float(v), int(v > 0)) for i, ((a, b), v) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "row int, subject string, run int, a double, b double, y double, k int").cache()


def test_inner_splits(spark, rows):
    sizes = spark.createDataFrame([(g, k) for g, n in (("a", 5), ("b", 3), ("c", 3), ("d", 1)) for k in range(n)], "g string, k int")
    assert {r["g"]: r["fold"] for r in S.balanced_folds(sizes, "g", 2).collect()} == {"a": 1, "c": 2, "b": 2, "d": 1}
    with pytest.raises(ValueError):
        S.InnerSplit("planet")
    with pytest.raises(ValueError):
        S.inner_cv(rows, S.InnerSplit(stratified=True), "subject")
    with pytest.raises(ValueError):
        S.inner_cv(rows.where("subject = 's0'"), S.InnerSplit(), "subject")
    assert S.inner_cv(rows, S.InnerSplit(n_splits=9), "subject").agg(F.max("fold")).first()[0] == 4
    uneven = spark.createDataFrame([(f"g{g}", int(g % 4 == 0)) for g in range(16) for _ in range(10)], "g string, y int")
    dealt = uneven.join(S.inner_cv(uneven, S.InnerSplit(stratified=True, n_splits=4), "g", "y"), "g")
    assert {(r["fold"], r["s"], r["n"]) for r in dealt.groupBy("fold").agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()} == {(f, 10, 40) for f in range(1, 5)}
    with pytest.raises(ValueError):
        S.stratified_folds(uneven.where("y = 0"), "g", "y", 2)
    by_run, n = S.run_aware_cv(rows, "run", 2)
    assert n == 2 and by_run.count() == 3 and S.run_aware_cv(rows.where("run = 0")) == (None, 0)
    inner = S.run_aware_inner_cv(rows, 3, ["row"])
    assert inner.count() == 3 * 96 and inner.where("role = 'test'").count() == 96
    assert S.split_count(2) == 2 and S.split_count(9, 1) == 2


def test_run_columns(spark):
    assert S.find_run_column(spark.range(2)) is None
    as_is = spark.createDataFrame([("1",), ("2.0",), (None,)], "run string")
    assert [r["run"] for r in S.find_run_column(as_is).collect()] == [1.0, 2.0, None]
    mixed = spark.createDataFrame([("run-1",), ("3",), ("x",)], "run string")
    assert [r["run"] for r in S.find_run_column(mixed).collect()] == [1.0, 3.0, None]


def test_scorers_and_levels(spark, rows):
    pred = rows.withColumn("p", F.col("a"))
    r = R.pearsonr_scorer()(pred)
    assert r == pytest.approx(np.corrcoef(*(rows.toPandas()[c] for c in ("a", "y")))[0, 1]) and R.pearsonr_scorer()(pred.withColumn("p", F.lit(1.0))) == 0
    assert R.scoring_dict()["neg_mse"](pred) < 0 and set(R.scoring_dict()) == {"r", "neg_mse"}
    level = R.subject_level_r(pred, R.AggregationConfig(ci_method="fixed_effects"))
    boot = R.subject_level_r(pred, R.AggregationConfig(ci_method="bootstrap", bootstrap_iterations=50))
    assert level.r == pytest.approx(R.subject_r_scorer()(pred)) and level.ci_low < level.r < level.ci_high and boot.ci_low <= boot.r <= boot.ci_high and level.per_subject.count() == 4
    for bad in ({"subject_weighting": "x"}, {"ci_method": "x"}):
        with pytest.raises(ValueError):
            R.AggregationConfig(**bad)
    labels = pred.withColumns({"y": F.col("k"), "p": (F.col("a") > 0).cast("int"), "score": F.col("a")})
    out = R.classification_result(labels)
    assert out.scores["auc"] > 0.8 and sum(out.confusion.values()) == 96 and out.per_subject.count() == 4 and 0.5 < out.mean_subject_auc <= 1
    folds = R.fold_results([R.FoldPrediction(2, "b", pred.limit(3)), R.FoldPrediction(1, "a", pred.limit(2))])
    assert folds.folds == (1, 2) and folds.rows.where("fold = 2").count() == 3
    assert R.PredictionIntervals(pred.withColumns({"lower": F.col("y") - 1, "upper": F.col("y") + 1}), 0.1, "split").coverage() == 1.0


def test_preparations_and_names(rows):
    config = R.PreprocessingConfig(feature_selection_percentile=50.0)
    model = W.fit_untuned(rows.withColumn("c", F.lit(1.0)), config.stages(["a", "b", "c"])).estimator
    assert R.transform_feature_names(model, ["a", "b", "c"]) == ["a"]
    model = W.fit_untuned(rows, R.PreprocessingConfig(pca_n_components=1).stages(["a", "b"])).estimator
    assert R.transform_feature_names(model, ["a", "b"]) == ["component_0"]
    with pytest.raises(W.FoldFitError, match="fold 3"):
        W.fit_untuned(rows, E.preparation(["nothing"]), 3)
    with pytest.raises(ValueError):
        R.PreprocessingConfig(max_feature_missingness=2)
    assert W.fold_seed(1, 2) == W.fold_seed(1, 2) != W.fold_seed(1, 3)


def test_nulls_and_staged_targets(rows):
    score = lambda d: d.agg(F.corr("a", "y")).first()[0]
    out = R.permutation_null(rows, score, R.NullConfig(n_permutations=9), "subject", "row")
    assert out.p_value == pytest.approx(0.1) and len(out.null) == 9 and max(out.null) < out.observed and min(out.changed_fractions) > 0.5
    shifted = R.permutation_null(rows, score, R.NullConfig("circular_shift", 4, 2), "subject", "row", "run")
    assert len(shifted.null) == 4
    target = W.staged_permutation_target(rows, "subject", "s0", ["b"], 1, "subject", "row").toPandas()
    d = rows.toPandas()
    train = d[d.subject != "s0"]
    fit = np.polyfit(train["b"], train["y"], 1)
    d["rest"] = d["y"] - np.polyval(fit, d["b"])
    both = target.merge(d[["row", "rest"]], on="row")
    moved = both["target"] - np.polyval(fit, both["b"])
    for s, own in both.assign(moved=moved).groupby("subject"):
        assert np.allclose(sorted(own["moved"]), sorted(own["rest"])) and not np.allclose(own["moved"], own["rest"])


def test_draws_are_the_columns(spark):
    units = np.arange(1, 50)
    got = [r[0] for r in spark.range(1, 50).select(I.draw_number(F.lit(3), F.col("id"), seed=42)).collect()]
    assert got == I.draw_numbers(3, units, 42).tolist()


def test_permutation_test_is_the_loop(rows):
    out = W.permutation_test(rows, ["a", "b"], "subject", ["row"], 1.0, 3)
    d = rows.withColumns({"d0": F.col("y")})
    for k in (1, 2, 3):
        placed = d.withColumn("_id", F.row_number().over(I.Window.partitionBy("subject").orderBy("row")).cast("bigint"))
        w = I.Window.partitionBy("subject")
        dealt = placed.select("subject", F.row_number().over(w.orderBy(I.draw_number(F.lit(k), F.col("_id"), seed=42), "_id")).alias("_pos"), F.col("y").alias(f"d{k}"))
        d = placed.withColumn("_pos", F.col("_id")).join(dealt, ["subject", "_pos"]).drop("_pos", "_id")
    want = E.ridge_null(d, ["a", "b"], ["d0", "d1", "d2", "d3"], "subject", 1.0)
    assert out["observed"] == pytest.approx(want["d0"]) and out["null"] == pytest.approx([want[f"d{k}"] for k in (1, 2, 3)])


def test_cv_plus_is_brute_force(spark):
    rng = np.random.default_rng(10)
    residual = {f: np.abs(rng.normal(size=n)).round(2) for f, n in enumerate((30, 41, 25))}
    p = rng.normal(size=(17, 3)).round(3)
    test = spark.createDataFrame([(i, f, float(p[i, f])) for i in range(17) for f in range(3)], "row int, fold int, p double")
    held = spark.createDataFrame([(f, float(v)) for f, r in residual.items() for v in r], "fold int, r double")
    for alpha in (0.1, 0.5, 0.005):
        n = sum(map(len, residual.values()))
        lo, hi = int(np.floor(alpha * (n + 1) + 1e-9)), int(np.ceil((1 - alpha) * (n + 1) - 1e-9))
        for r in I.cv_plus(test, held, alpha).collect():
            down, up = (np.sort(np.concatenate([p[r["row"], f] + s * residual[f] for f in range(3)])) for s in (-1, 1))
            assert r["lower"] == (down[lo - 1] if lo >= 1 else -np.inf) and r["upper"] == (up[hi - 1] if hi <= n else np.inf)


def test_importance_over_folds(rows):
    fit = lambda train: (lambda w: lambda d: d.withColumn("p", E.linear_prediction(["a", "b"], w)))(E.solve_ridge(E.normal_equations(train, ["a", "b"], "y")[0], 1.0))
    out = {r["feature"]: r for r in I.importance_over_folds(rows.where("subject < 's2'"), ["a", "b"], "subject", fit, E.explained(rows, "y", "p"), "row", repeats=1).collect()}
    assert out["a"]["importance"] > 0.3 > abs(out["b"]["importance"]) and out["a"]["n_folds"] == 2
    shap = {r["feature"]: r["importance"] for r in I.shap_over_folds(rows, ["a", "b"], "subject", lambda t: E.solve_ridge(E.normal_equations(t, ["a", "b"], "y")[0], 1.0)).collect()}
    assert shap["a"] > 5 * shap["b"]


def test_votes_by_probability(spark):
    a, b = (spark.createDataFrame(list(enumerate(p)), "row int, probability double") for p in ([0.9, 0.2, 0.6], [0.4, 0.1, 0.3]))
    assert {r["row"]: (round(r["probability"], 3), r["p"]) for r in E.soft_vote([a, b], ["row"]).collect()} == {0: (0.65, 1), 1: (0.15, 0), 2: (0.45, 0)}


def test_group_designs(spark):
    cells = spark.createDataFrame([("r0", "left", "itpc", 0.5), ("r1", "left", "itpc", 0.7)], "recording string, group string, feature string, value double")
    targets = spark.createDataFrame([("r0", "left", 1, "s0"), ("r1", "left", 2, "s1")], "recording string, group string, score int, subject_id string")
    out = table.build_group_design(cells, targets, "score").collect()
    assert {(r["recording"], r["y"], r["subject_id"]) for r in out} == {("r0", 1.0, "s0"), ("r1", 2.0, "s1")}
    for bad in (targets.limit(1), targets.withColumn("score", F.lit(None).cast("int")), targets.union(targets)):
        with pytest.raises(ValueError):
            table.build_group_design(cells, bad, "score")
    with pytest.raises(ValueError):
        table.build_group_design(cells.drop("group"), targets, "score")
    assert spectral.default_fit_range(Band("g", 30, 60)) == (2.0, 60.0) and spectral.default_fit_range(Band("d", 1, 4)) == (1.0, 40.0)


def test_provenance(tmp_path):
    assert provenance.software_versions()["pyspark"] and len(provenance.implementation_hash()) == 64
    (tmp_path / "a.py").write_text("x")
    one = provenance.implementation_hash(tmp_path)
    (tmp_path / "a.py").write_text("y")
    assert provenance.implementation_hash(tmp_path) != one


@pytest.fixture(scope="module")
def epochs(spark):
    rng = np.random.default_rng(11)
    maps = np.array([[1.0, 1, -1, -1], [1, -1, 1, -1], [1, -1, -1, 1]])
    rows = []
    for e in range(48):
        y = e % 2
        order = rng.choice([0, 1, 2], 12, p=[0.7, 0.2, 0.1] if y else [0.1, 0.2, 0.7])
        m = np.concatenate([np.outer(maps[s], np.sin(np.linspace(0.1, 9, 20)) * 3) for s in order], axis=1) + 0.1 * rng.normal(size=(4, 240))
        rows.append((f"r{e % 3}", e, "e", 100.0, m.tolist(), y))
    return spark.createDataFrame(rows, "recording string, epoch int, event string, sfreq double, m array<array<double>>, y int").repartition(4).cache()


def test_microstates_use_all_peaks(epochs):
    templates, explained = SM.fit_microstates(epochs, 3, starts=4)
    unit = templates / np.linalg.norm(templates, axis=1, keepdims=True)
    truth = np.array([[1.0, 1, -1, -1], [1, -1, 1, -1], [1, -1, -1, 1]]) / 2
    assert explained > 0.95 and np.allclose(np.abs(unit @ truth.T).max(axis=1), 1, atol=0.02) and len(set(np.abs(unit @ truth.T).argmax(axis=1))) == 3
    assert SM.match_reference(templates, templates[[2, 0, 1]]) == [2, 0, 1]
    assert SM.fit_microstates(epochs.repartition(2), 3, starts=4)[1] == pytest.approx(explained)


def test_riemannian_mean_is_numpys(epochs):
    d = SM.covariance_features(epochs, 0.3)
    mean = SM.riemannian_mean(d, 4)
    covs = [np.array(r["cov"]).reshape(4, 4) for r in d.select("cov").collect()]
    back = SM._power(mean, lambda v: 1 / np.sqrt(v))
    assert np.allclose(sum(SM._power(back @ c @ back, np.log) for c in covs) / len(covs), 0, atol=1e-6)
    wide = SM._wide_covariances(epochs, "y", 4)
    few = SM.class_covariances(epochs, "y", 4)
    assert all(np.allclose(wide[k], few[k]) for k in (0, 1))


def test_filters_of_three_classes(spark):
    rng = np.random.default_rng(12)
    mix = rng.normal(size=(4, 4))
    covs = {k: mix @ np.diag([5.0 if i == k else 1.0 for i in range(4)]) @ mix.T for k in range(3)}
    w = SM.csp_filters(covs, 3)
    turned = np.abs(w @ mix)
    # Each filter reads one source, and each class has one.
    assert sorted(turned.argmax(axis=1)) == [0, 1, 2] and np.all(np.sort(turned, axis=1)[:, -2] < 0.05 * turned.max(axis=1))


def test_signals_are_cross_fitted(epochs):
    make = lambda c: LogisticRegression(labelCol="y", predictionCol="p", weightCol="weight", **c)
    for feature in (L.MicrostateTransformer(3, starts=2), L.CSPTransformer(4, 2), L.TangentSpaceTransformer(4)):
        out, chosen = L.cross_fit_signal_classification(epochs, L.learned_pipeline(feature, make), "recording")
        assert out.count() == 48 and len(chosen) == 3 and out.where("p = y").count() >= 40, feature
    with pytest.raises(ValueError):
        L.learned_pipeline([], make)


def test_command_line(spark, rows, tmp_path, capsys):
    rows.write.parquet(str(tmp_path / "rows"))
    (tmp_path / "m.toml").write_text('task = "regression"\ntarget = "y"\ngroup = "subject"\nfeatures = ["a", "b"]\nmodels = ["ridge"]\n')
    assert main(["--json", "check-model", str(tmp_path / "m.toml"), str(tmp_path / "rows")], spark) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["event"] == "check" and said["rows"] == 96 and said["groups"] == 4 and said["fits"] == {"ridge": 4}
    assert main(["model", str(tmp_path / "m.toml"), str(tmp_path / "rows"), str(tmp_path / "out")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "scores")).count() == 2 and "score" in capsys.readouterr().out
    (tmp_path / "bad.toml").write_text('task = "regression"\n')
    assert main(["--json", "check-model", str(tmp_path / "bad.toml"), str(tmp_path / "rows")], spark) == 2 and "target" in capsys.readouterr().out
    assert main(["init", str(tmp_path / "new.toml")], spark) == 0 and TextReporter.event is not JsonReporter.event
    traces = spark.createDataFrame([("r", 0, "e", "a", 0.0, 10.0, [1.0, 2.0, 4.0])], "recording string, epoch int, event string, channel string, t0 double, sfreq double, x array<double>")
    traces.write.parquet(str(tmp_path / "traces"))
    args = [str(tmp_path / "new.toml"), str(tmp_path / "traces")]
    assert main(["check", *args], spark) == 0 and main(["run", *args, str(tmp_path / "cells")], spark) == 0 and main(["status", *args, str(tmp_path / "cells")], spark) == 0
    assert "done" in capsys.readouterr().out
