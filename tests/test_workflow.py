"""Recipes, spectra models, cycles, workflows, sources and streams."""

import json
import time

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from traceloom.functions.dims import Band, Window
from traceloom.model import workflow as W
from traceloom.operators import models_of_spectra as MS
from traceloom.plans import recipe as R
from traceloom.plans import registry
from traceloom.plans.catalog_recipe import CHANNELS, RECIPE
from traceloom.sources import bundle, views
from traceloom.streaming import windows as SW


def test_recipe_collects_every_problem():
    with pytest.raises(R.RecipeError) as e:
        R.load_recipe({"bands": {"x": [5, 2]}, "oops": {}, "spectra": {"method": "fast"}, "features": [{"measure": "nothing"}, {"measure": "variance", "windows": ["w"], "frobs": 1}, {"measure": "erds_mean", "bands": ["alpha"]}]})
    said = str(e.value)
    assert all(w in said for w in ("oops", "bands.x", "fast", "nothing", "'w'", "frobs", "needs a baseline")) and len(said.splitlines()) == 7


def test_recipe_toml_and_identity(tmp_path):
    (tmp_path / "r.toml").write_text('[inputs]\npath = "a"\n[windows]\nall = []\n[[features]]\nmeasure = "variance"\n')
    a = R.load_recipe(tmp_path / "r.toml")
    b = R.load_recipe({"inputs": {"path": "b"}, "windows": {"all": []}, "features": [{"measure": "variance"}]})
    assert a.sha256() == b.sha256() and a.entries[0].measure.name == "variance"
    wide = R.load_recipe({"features": [{"measure": "aperiodic", "fit_range": [2.0, 60.0]}]})
    assert wide.spectra.fmax == 60.0
    with pytest.raises(R.RecipeError):
        R.load_recipe({"spectra": {"fmax": 50.0}, "features": [{"measure": "aperiodic", "fit_range": [2.0, 60.0]}]})


def test_run_resume_and_status(spark, tmp_path):
    traces = views.traces(spark, SMALL, gaps=False).where("epoch < 10")
    recipe = R.load_recipe({k: v for k, v in RECIPE.items() if k != "features"} | {"features": RECIPE["features"][:1]})
    path = str(tmp_path / "out")
    assert {r["state"] for r in R.status(traces, recipe, path).collect()} == {"missing"}
    R.run(traces.where("recording = 'r0'"), recipe, path, 64.0, 64, CHANNELS)
    R.run(traces, recipe, path, 64.0, 64, CHANNELS, resume=True)
    assert {r["state"] for r in R.status(traces, recipe, path).collect()} == {"done"}
    other = R.load_recipe({"features": [{"measure": "rms"}]})
    assert {r["state"] for r in R.status(traces, other, path).collect()} == {"stale"}
    found = R.check(traces, recipe, 64.0, 64, CHANNELS)
    assert found["cells"] == 2 * 3 * 2 * 3 and found["features"] == 18 and found["recordings"] == 5


def test_recipe_values_are_the_operators(spark):
    traces = views.traces(spark, SMALL, gaps=False).where("epoch < 4")
    cells, trials = R.extract(traces, R.load_recipe(RECIPE), 64.0, 64, CHANNELS)
    names = {r[0] for r in cells.select("measure").distinct().collect()}
    assert {"variance", "band_power", "ratio_theta_beta", "asymmetry", "erds_mean", "burst_count", "sampen", "higuchi_fd", "spectral_centroid"} <= names
    assert trials.where("measure = 'itpc'").count() == 2 * 5 and cells.select("feature").where("feature not like 'tl_%_p____________'").count() == 0


def test_registry_and_conversion():
    assert registry.lookup("itpc").kind == "phase" and registry.lookup("amplitude_quantile").settable() == {"q"}
    with pytest.raises(KeyError):
        registry.lookup("x")
    assert registry.convert(1, float) == 1.0 and registry.convert([1, 2], tuple[float, float]) == (1.0, 2.0) and registry.convert(None, int | None) is None
    for bad, kind in ((True, int), ("a", float), ([1], tuple[int, int])):
        with pytest.raises((TypeError, ValueError)):
            registry.convert(bad, kind)


def test_spectral_model_finds_its_parts():
    f = np.arange(2, 40.25, 0.25)
    y = 1.5 - 1.2 * np.log10(f) + 0.8 * np.exp(-((f - 10) ** 2) / (2 * 1.0**2)) + 0.5 * np.exp(-((f - 22) ** 2) / (2 * 2.0**2))
    m = MS.parameterise(f, 10**y)
    assert m["exponent"] == pytest.approx(1.2, abs=0.05) and m["offset"] == pytest.approx(1.5, abs=0.06) and m["r_squared"] > 0.99
    assert [round(p[0]) for p in sorted(m["peaks"])[:2]] == [10, 22] or {round(p[0]) for p in m["peaks"]} >= {10, 22}
    k = MS.parameterise(f, 10 ** (2 - np.log10(50 + f**2.0)), knee=True)
    assert k["exponent"] == pytest.approx(2.0, abs=0.1) and k["knee"] == pytest.approx(50, rel=0.2)
    assert np.isnan(MS.parameterise(f, np.full(len(f), np.nan))["offset"])


def test_cycles_of_a_sine():
    t = np.arange(1000) / 100
    cycles = MS.find_cycles(np.sin(2 * np.pi * 10 * t), 100.0, (8.0, 13.0))
    inner = cycles[2:-2]
    assert 90 <= len(cycles) <= 100 and all(c["burst"] for c in inner)
    assert np.mean([c["period"] for c in inner]) == pytest.approx(0.1, abs=0.005) and np.mean([c["amplitude"] for c in inner]) == pytest.approx(2.0, abs=0.15)


def test_time_resolved_connectivity_of_locked_signals(spark):
    t = np.arange(256) / 64
    rng = np.random.default_rng(0)
    rows = [("r", 0, "a", c, 0.0, 64.0, x.tolist()) for c, x in (("a", np.sin(2 * np.pi * 12 * t)), ("b", np.sin(2 * np.pi * 12 * t + 1)), ("c", rng.normal(size=256)))]
    df = spark.createDataFrame(rows, "recording string, epoch int, event string, channel string, t0 double, sfreq double, x array<double>")
    out = {(r["a"], r["b"]): r["value"] for r in MS.connectivity_over_time(df, ["plv"], [Band("m", 11, 13)], Window("all"), [12.0], 64.0, 4.0).collect()}
    assert out["a", "b"] > 0.99 > 0.8 > out["a", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    y = 2 * x[:, 0] + rng.normal(size=120)
    return spark.createDataFrame([(i, i % 4, float(a), float(b), float(i % 7), float(v)) for i, ((a, b), v) in enumerate(zip(x, y))], "row int, subject int, a double, b double, age double, y double").cache()


def test_model_recipe_runs_with_baselines(rows):
    recipe = W.load_model_recipe({"task": "regression", "target": "y", "group": "subject", "features": ["a", "b"], "covariates": ["age"], "models": ["ridge", "elasticnet"]})
    pred, scores = W.run_model(rows, recipe)
    s = {r["model"]: r["r2"] for r in scores.collect()}
    assert set(s) == {"ridge", "elasticnet", "dummy", "covariates"} and s["ridge"] > 0.6 and s["elasticnet"] > 0.6 and s["dummy"] < 0.05
    assert pred.count() == 480
    with pytest.raises(W.ModelRecipeError) as e:
        W.load_model_recipe({"task": "regression", "target": "a", "features": ["a"], "models": ["svm"], "x": 1})
    assert len(str(e.value).splitlines()) == 4


def test_lda_and_permutations(rows):
    d = rows.withColumn("k", (F.col("y") > 0).cast("int"))
    recipe = W.load_model_recipe({"task": "classification", "target": "k", "group": "subject", "features": ["a", "b"], "models": ["lda"]})
    s = {r["model"]: r["balanced_accuracy"] for r in W.run_model(d, recipe)[1].collect()}
    assert s["lda"] > 0.75
    out = W.permutation_test(rows, ["a", "b"], "subject", ["row"], 1.0, 19)
    assert out["p"] == pytest.approx(1 / 20) and max(out["null"]) < out["observed"]


def test_intervals_cover(rows):
    out = W.quantile_intervals(rows.where("subject < 2"), rows.where("subject = 2"), rows.where("subject = 3"), ["a", "b"], 0.2, bins=3).collect()
    assert np.mean([r["lower"] <= r["y"] <= r["upper"] for r in out]) >= 0.7


def test_staged_preprocessor_is_fitted_on_training_rows(rows):
    state = W.fit_staged(rows.where("subject <> 0").withColumn("c", F.lit(None).cast("double")), ["a", "b", "c"], ["age"], "subject")
    assert state.features == ("a", "b")
    out = state.transform(rows.withColumn("c", F.lit(1.0)).withColumn("a", F.when(F.col("row") != 0, F.col("a")))).where("subject <> 0").toPandas()
    assert abs(np.corrcoef(out["a"], out["age"])[0, 1]) < 1e-6 and out["target"].notna().all()


def test_bundles(spark, tmp_path):
    cells = spark.createDataFrame([("r", 0, "a", "f", 1 / 3, 1.0), ("r", 0, "a", "g", None, 0.5), ("r", 1, "b", "f", 2e-12, 1.0), ("r", 1, "b", "g", -5.0, 0.0)], "recording string, epoch int, event string, feature string, value double, coverage double")
    meta = [{"feature": "f", "unit": "V"}, {"feature": "g", "unit": "Hz"}]
    path = str(tmp_path / "b")
    bundle.write_bundle(cells, meta, path)
    assert sorted(map(str, bundle.read_bundle(spark, path).drop("support").collect())) == sorted(map(str, cells.select("recording", "epoch", "event", "feature", "value", "coverage").collect()))
    with pytest.raises(FileExistsError):
        bundle.write_bundle(cells, meta, path)
    bundle.write_bundle(cells.where("feature = 'f'"), meta[:1], str(tmp_path / "c"))
    both = bundle.read_dataset(spark, [path, str(tmp_path / "c")])
    assert both.count() == 8
    side = next((tmp_path / "b" / "sidecar").glob("part-*"))
    text = json.loads(side.read_text())
    text["features"][0]["unit"] = "mV"
    side.write_text(json.dumps(text))
    (side.parent / f".{side.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        bundle.read_sidecar(spark, path)


def test_windows_over_a_stream_are_those_over_the_batch(spark, tmp_path):
    events = views.table(spark, SMALL, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = SW.tumbling(stream, "1 day", ["event_type"], late="60 days")
    q = out.writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((r["start"], r["event_type"], r["n"]) for r in rows)
    assert key(spark.table("tumbled").collect()) == key(SW.tumbling(events, "1 day", ["event_type"]).collect())


def test_feature_meta(spark):
    from traceloom.functions.dims import Computation
    from traceloom.functions.meta import FeatureMeta, meta_table

    m = FeatureMeta("Band_Power", "C 3", "channel", "V2", "psd", Computation("welch"), Band("alpha", 8, 13), "stim", (0.0, 1.0), "db")
    other = FeatureMeta("Band_Power", "C 3", "channel", "V2", "psd", Computation("welch", '{"n":2}'), Band("alpha", 8, 13), "stim", (0.0, 1.0), "db")
    assert m.feature.startswith("tl_band-power_alpha_c-3_stim_db_p") and m.feature != other.feature
    assert meta_table(spark, [m, other]).count() == 2
    with pytest.raises(ValueError):
        meta_table(spark, [m, m])
    with pytest.raises(ValueError):
        FeatureMeta("x", "y", "planet", "V", "psd", Computation("w"))


def test_metadata_joins_by_sample_and_label(spark):
    from traceloom.operators.preprocess import attach_metadata

    e = spark.createDataFrame([("r", 10, "a"), ("r", 20, "b"), ("r", 30, "c")], "recording string, i long, label string")
    s = spark.createDataFrame([("r", 1.0, "a", 5), ("r", 2.0, "b", 6), ("r", 2.0, "x", 7)], "recording string, onset double, label string, rating int")
    assert {(r["i"], r["rating"]) for r in attach_metadata(e, s, 10.0).collect()} == {(10, 5), (20, 6), (30, None)}


def test_spectra_are_fitted_in_bulk_as_alone():
    f, rng = np.arange(2.25, 40, 0.75), np.random.default_rng(3)
    p = rng.chisquare(1, (600, len(f))) / f + 1e-6
    p[5, 3], p[6, 0] = np.nan, 0.0
    began = time.process_time()
    alone = [MS.parameterise(f, v) for v in p[:40]]
    bulk = MS.parameterise_rows(f, p)
    assert time.process_time() - began < 15  # one spectrum after another took some 60 ms each
    for i, m in enumerate(alone):
        own = bulk["peaks"][i][np.isfinite(bulk["peaks"][i, :, 0])]
        assert len(own) == len(m["peaks"]) and np.isnan(m["offset"]) == np.isnan(bulk["offset"][i]) == (i in (5, 6))
        assert np.allclose([m[k] for k in ("offset", "exponent", "r_squared", "error")], [bulk[k][i] for k in ("offset", "exponent", "r_squared", "error")], atol=1e-6, equal_nan=True)
        assert np.allclose(own, np.array(m["peaks"]).reshape(-1, 3), atol=1e-5)
    assert np.isfinite(bulk["peaks"][:, :, 0]).sum(axis=1).max() <= 6 and (np.isfinite(bulk["peaks"][:, :, 0]).sum(axis=1) > 1).any()
