"""Cleaning as one call and stage by stage, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.operators import cleaning as C
from traceloom.operators import preprocess as P

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(6)
    return {(r, c): rng.normal(size=400) + k for r in ("r0", "r1") for k, c in enumerate(NAMES)}


@pytest.fixture(scope="module")
def raw(spark, signals):
    rows = [(r, 0, "raw", c, 0.0, 100.0, x.tolist()) for (r, c), x in signals.items()]
    return spark.createDataFrame(rows, "recording string, epoch int, event string, channel string, t0 double, sfreq double, x array<double>").repartition(3)


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([(r, i, "go" if i % 2 else "stop") for r in ("r0", "r1") for i in (5, 51, 100, 201, 390)], "recording string, i long, label string")


def cells(df):
    return {(r["recording"], r["epoch"], r["event"], r["channel"]): np.array(r["x"], dtype=float) for r in df.collect()}


def test_epochs_of_whole_signals(raw, events, signals):
    got = cells(C.cut_traces(raw, events, -0.1, 0.2))
    # Events at 5 and 390 do not fit.
    assert set(got) == {(r, e, "go" if i % 2 else "stop", c) for r, c in signals for e, i in ((1, 51), (2, 100), (3, 201))}
    assert all(np.allclose(x, signals[r, c][{1: 51, 2: 100, 3: 201}[e] - 10 :][:31]) for (r, e, _, c), x in got.items())


def test_one_call_is_its_steps(raw, events, signals):
    settings = {"channels": {"drop": ["c"]}, "crop": {"tmin": 0.0, "tmax": 3.5}, "epochs": {"tmin": -0.1, "tmax": 0.2}, "rejection": {"reject": 100.0}, "reference": "average", "sampling": {"decimate": 2}, "detrend": "constant", "baseline": {"first": 0, "samples": 5}}
    got = cells(C.preprocess(raw, settings, {"events": events}))
    assert len(got) == 2 * 3 * 2
    for (r, e, _, c), x in got.items():
        at = {1: 51, 2: 100, 3: 201}[e]
        both = np.stack([signals[r, k][at - 10 :][:31] for k in "ab"])
        want = (both["ab".index(c)] - both.mean(axis=0))[::2]
        want = want - want.mean()
        assert np.allclose(x, want - want[:5].mean())


def test_recipes_name_every_problem(tmp_path):
    with pytest.raises(C.CleaningError) as e:
        C.load_config({"x": 1, "epochs": {"tmin": 1, "tmax": 0}, "filter": {"sfreq": 100, "fmin": 1, "fmax": 80}, "artifact": {"method": "magic"}, "detrend": "cubic"})
    assert len(str(e.value).splitlines()) == 5
    (tmp_path / "c.toml").write_text('detrend = "linear"\n[crop]\ntmin = 0.5\n')
    assert C.load_config(tmp_path / "c.toml") == {"detrend": "linear", "crop": {"tmin": 0.5}}


def test_stages_resume_and_go_stale(spark, raw, events, tmp_path):
    settings = {"epochs": {"tmin": -0.1, "tmax": 0.2}, "detrend": "linear"}
    w = C.open_workflow(raw, settings, str(tmp_path / "w"), "v1", {"events": events})
    assert {s for _, s in C.list_steps(w)} == {"pending"} and C.run_next(w) == "channels"
    seen = []
    out = C.run_until(w, on_step=seen.append)
    assert seen == list(C.NAMES) and {s for _, s in C.list_steps(w)} == {"done"} and C.run_next(w) is None
    assert {k: v.tolist() for k, v in cells(out).items()} == {k: v.tolist() for k, v in cells(C.preprocess(raw, settings, {"events": events})).items()}
    other = C.open_workflow(raw, settings | {"detrend": "constant"}, str(tmp_path / "w"), "v1", {"events": events})
    states = dict(C.list_steps(other))
    assert states["interpolate"] == "done" and states["detrend"] == states["baseline"] == "stale"
    decided = C.open_workflow(raw, settings, str(tmp_path / "w"), "v1", {"events": events, "bads": ["a"]}, {"review-raw": ["a"]})
    assert dict(C.list_steps(decided))["crop-raw"] == "done" and dict(C.list_steps(decided))["review-raw"] == "stale"
    with pytest.raises(C.CleaningError):
        C.read_checkpoint(decided, "baseline")
    C.write_result(w, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "epochs")).count() == out.count()
    assert C.reset_from(w, "epoch") == list(C.NAMES[C.NAMES.index("epoch") :]) and dict(C.list_steps(w))["artifact"] == "done"


def test_reviews_and_learned_limits(spark, raw, events, signals):
    spans = spark.createDataFrame([("r0", 10, 20)], "recording string, start int, stop int")
    got = cells(C.apply_raw_review(raw, ["b"], spans))
    assert {c for *_, c in got} == {"a", "c"} and np.isnan(got["r0", 0, "raw", "a"][10:20]).all() and np.isfinite(got["r1", 0, "raw", "a"]).all() and np.isfinite(got["r0", 0, "raw", "a"][20:]).all()
    epochs = C.cut_traces(raw, spark.createDataFrame([("r0", i, "e") for i in range(20, 360, 10)], "recording string, i long, label string"), -0.1, 0.1)
    loud = epochs.withColumn("x", F.when((F.col("epoch") == 7) & (F.col("channel") == "a"), F.transform("x", lambda v: v * 50)).otherwise(F.col("x")))
    model = C.fit_rejection(loud)
    assert model.count() == 3
    kept = {r[0] for r in C.apply_rejection(loud, model).select("epoch").distinct().collect()}
    assert 7 not in kept and kept


def test_projectors_take_out_a_shared_direction(spark):
    rng = np.random.default_rng(7)
    direction = np.array([1.0, 2.0, -1.0])
    x = 0.01 * rng.normal(size=(3, 500)) + np.outer(direction, rng.normal(size=500))
    df = spark.createDataFrame([("r", 0, "e", c, 0.0, 100.0, x[k].tolist()) for k, c in enumerate(NAMES)], "recording string, epoch int, event string, channel string, t0 double, sfreq double, x array<double>")
    p = C.fit_ssp(df, NAMES)
    assert np.allclose(p @ direction, 0, atol=0.01)
    got = cells(C.apply_projector(df, NAMES, p))
    assert max(np.abs(v).max() for v in got.values()) < 0.1


def test_resampling_keeps_slow_waves(spark):
    t = np.arange(500) / 100
    df = spark.createDataFrame([("r", 0, "e", "a", 0.0, 100.0, np.sin(2 * np.pi * 3 * t).tolist())], "recording string, epoch int, event string, channel string, t0 double, sfreq double, x array<double>")
    for up, down in ((1, 2), (3, 2), (2, 1)):
        out = C.resample_epochs(df, up, down).first()
        new = np.arange(len(out["x"])) / out["sfreq"]
        assert out["sfreq"] == 100 * up / down and np.allclose(np.array(out["x"])[40:-40], np.sin(2 * np.pi * 3 * new)[40:-40], atol=0.02)


def test_reference_and_interpolation_by_epoch_arrays(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2, 3, 40))
    x[0, 1, 5] = np.nan
    rows = [("r", e, "e", c, 0.0, 100.0, x[e, k].tolist()) for e in range(2) for k, c in enumerate(NAMES)]
    df = spark.createDataFrame(rows, "recording string, epoch int, event string, channel string, t0 double, sfreq double, x array<double>").repartition(3)
    got = cells(P.reference_epochs(df))
    ok = [np.nanmean(x[e], axis=0) for e in range(2)]
    assert all(np.allclose(v, x[e, NAMES.index(c)] - ok[e], equal_nan=True) for (_, e, _, c), v in got.items())
    made = cells(P.interpolate_channels(df, [("b", "a", 0.25), ("b", "c", 0.75)]))
    assert all(np.allclose(made["r", e, "e", "b"], 0.25 * x[e, 0] + 0.75 * x[e, 2]) for e in range(2)) and len(made) == 6
