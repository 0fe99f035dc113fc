"""Closed forms and edge cases of the core operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.functions import dims, kernels
from traceloom.functions.numeric import bh_adjust, runs, safe_pearson
from traceloom.operators import complexity, connectivity, events, phase, preprocess, spatial_models, spectral, table, temporal
from traceloom.operators.spatial import aggregate_space

NAN, INF = float("nan"), float("inf")
ROW = ("recording", "epoch", "event")


def traces(spark, *rows, sfreq=10.0):
    data = [("r", e, "a", ch, 0.0, sfreq, [float(v) for v in x]) for e, ch, x in rows]
    return spark.createDataFrame(data, "recording string, epoch int, event string, channel string, t0 double, sfreq double, x array<double>")


def value(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]["value"]


def test_band_weights_integrate_lines_exactly():
    f = np.arange(0.0, 20.0, 0.7)
    for lo, hi in ((1.0, 4.0), (2.3, 2.4), (0.0, 19.0)):
        w = dims.band_weights(f, lo, hi)
        assert w.sum() == pytest.approx(hi - lo)
        assert (w * 2 * f).sum() == pytest.approx(hi**2 - lo**2)
    with pytest.raises(ValueError):
        dims.band_weights(f, 1.0, 25.0)
    assert dims.trapezoid_weights([3.0]).tolist() == [1.0]


def test_names_and_hashes():
    assert dims.slug("  My_Band x ") == "my-band-x"
    assert dims.canonical_json({"b": 1, "a": INF}) == '{"a":"inf","b":1}'
    assert len(dims.Computation("welch", "{}").sha256) == 64
    with pytest.raises(ValueError):
        dims.Band("x", 4.0, 2.0)
    with pytest.raises(ValueError):
        dims.check_passband(dims.Band("g", 30, 45), None, 20.0)
    assert dims.minimum_samples(0.1, 100) == 10 and dims.minimum_samples(0.0, 100) == 1


def test_infinite_reads_as_missing(spark):
    w = [dims.Window("all")]
    a = temporal.temporal_features(traces(spark, (0, "c", [1, 2, NAN, 4, 3])), w).orderBy("measure", "space").collect()
    b = temporal.temporal_features(traces(spark, (0, "c", [1, 2, INF, 4, 3])), w).orderBy("measure", "space").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_temporal_closed_forms(spark):
    t = temporal.temporal_features(traces(spark, (0, "c", [1, -1, 1, -1, 0, 0, 1])), [dims.Window("all")], include_global=False)
    assert value(t, measure="zero_crossing_rate") == pytest.approx(4 / 0.7)
    assert value(t, measure="ptp") == 2
    assert value(t, measure="line_length") == pytest.approx(np.abs(np.diff([1, -1, 1, -1, 0, 0, 1])).mean() * 10)
    assert value(t, measure="peak_latency") == 0.0
    short = temporal.temporal_features(traces(spark, (0, "c", [1, NAN, NAN])), [dims.Window("all")], ["skewness", "kurtosis", "auc", "variance"], include_global=False)
    assert value(short, measure="skewness") is None and value(short, measure="auc") is None and value(short, measure="variance") == 0.0
    with pytest.raises(ValueError):
        temporal.temporal_channels(traces(spark, (0, "c", [1])), [dims.Window("all")], ["nothing"])


def test_coverage_of_regions(spark):
    cells = spark.createDataFrame([("r", "a", 1.0, 1.0), ("r", "b", None, 0.5), ("q", "a", None, 0.5), ("q", "b", NAN, 0.1)], "k string, channel string, value double, coverage double")
    out = {(r["k"], r["space"]): (r["value"], r["coverage"]) for r in aggregate_space(cells, ["k"]).collect()}
    assert out["r", "global"] == (1.0, 0.5) and out["q", "global"] == (None, pytest.approx(0.3))


def test_runs_and_bursts(spark):
    rows = spark.createDataFrame([([True, True, False, None, True],), ([],), ([False],)], "f array<boolean>")
    got = [[tuple(q) for q in r["r"]] for r in rows.select(runs("f").alias("r")).collect()]
    assert got == [[(0, 2), (4, 1)], [], []]
    x = [0, 0, 5, 6, 0, 0, 7, 0, 0, 0]
    out = events.burst_features(traces(spark, (0, "c", x)), [dims.Window("all")], threshold=0.5, min_ms=150.0, sfreq=10.0, include_global=False)
    assert value(out, measure="count") == 1 and value(out, measure="amp_mean") == 6 and value(out, measure="duration_mean") == pytest.approx(0.2)
    none = events.burst_features(traces(spark, (0, "c", [1] * 10)), [dims.Window("all")], sfreq=10.0, include_global=False)
    assert value(none, measure="count") == 0 and value(none, measure="duration_mean") is None


def test_degenerate_baseline_is_flagged(spark):
    out = events.erds_features(traces(spark, (0, "c", [0, 0, 1, 2, 3, 4])), dims.Window("b", 0, 0.1), [dims.Window("w", 0.2, 0.5)], ["erds_mean"], onset_samples=1, sfreq=10.0, include_global=False).collect()[0]
    assert out["baseline_degenerate"] and out["value"] is None
    up = events.erds_features(traces(spark, (0, "c", [1, 1, 10, 100, 10, 1])), dims.Window("b", 0, 0.1), [dims.Window("w", 0.2, 0.5)], onset_samples=1, sfreq=10.0, include_global=False)
    assert value(up, measure="erds_mean") == pytest.approx(10) and value(up, measure="erds_peak_latency") == pytest.approx(0.3)
    assert value(up, measure="erds_rebound_latency") == pytest.approx(0.4) and value(up, measure="erd_magnitude") == 0.0


def spectra(spark, f, p):
    return spark.createDataFrame([("r", 0, "a", "c", "stim", [float(x) for x in p])], "recording string, epoch int, event string, channel string, window string, p array<double>")


def test_power_law_fits(spark):
    f = np.arange(0.0, 45.5, 0.5)
    p = np.r_[0.0, 10 * f[1:] ** -1.7]
    fit = spectral.aperiodic_fits(spectra(spark, f, p), f).first()
    assert fit["slope"] == pytest.approx(-1.7) and fit["offset"] == pytest.approx(1.0) and fit["r_squared"] == pytest.approx(1.0)
    peak = p + np.where(np.abs(f - 10) < 3, 3 * np.exp(-((f - 10) ** 2)), 0)
    assert spectral.aperiodic_fits(spectra(spark, f, peak), f).first()["slope"] == pytest.approx(-1.7, abs=0.05)
    one = spectral.peak_frequency(spectra(spark, f, peak), f, dims.Band("alpha", 8, 13), include_global=False).first()
    assert one["value"] == pytest.approx(10.0, abs=0.3) and not one["no_peak"]
    ratio = spectral.periodic_power(spectra(spark, f, p), f, bands=[dims.Band("alpha", 8, 13)], include_global=False)
    assert value(ratio) == pytest.approx(1.0)
    missing = p.copy()
    missing[20] = NAN
    assert value(spectral.band_power(spectra(spark, f, missing), f, bands=[dims.Band("alpha", 8, 13)], include_global=False)) is None
    assert value(spectral.mean_psd(spectra(spark, f, missing), f, bands=[dims.Band("alpha", 8, 13)], include_global=False)) is not None


def test_entropy_of_equal_bins_is_one(spark):
    f = np.arange(0.0, 45.5, 0.5)
    assert value(spectral.spectral_entropy(spectra(spark, f, np.ones(len(f))), f, bands=[dims.Band("b", 5, 30)], include_global=False)) == pytest.approx(1.0)


def test_phase_of_equal_and_opposed_trials(spark):
    def rows(*pairs):
        data = [("r", i, "a", "c", 10.0, [c] * 4, [s] * 4) for i, (c, s) in enumerate(pairs)]
        return spark.createDataFrame(data, "recording string, epoch int, event string, channel string, sfreq double, re array<double>, im array<double>")

    w = [dims.Window("all")]
    assert value(phase.itpc(rows((1.0, 0.0), (2.0, 0.0)), w, include_global=False)) == pytest.approx(1)
    assert value(phase.itpc(rows((1.0, 0.0), (-1.0, 0.0)), w, include_global=False)) == pytest.approx(0)
    assert value(phase.ppc(rows((1.0, 0.0), (0.0, 1.0)), w, include_global=False)) == pytest.approx(0)
    alone = phase.itpc(rows((1.0, 0.0)), w, include_global=False).first()
    assert alone["value"] is None and alone["insufficient_trials"]
    with pytest.raises(ValueError):
        phase.check_bands((20, 30), (4, 8))


def test_graphs(spark):
    e = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "b", "c", 1.0), ("g", "a", "c", 0.0)], "graph string, a string, b string, w double")
    assert connectivity.clustering_coefficient(e, 0.5).first()["value"] == 0.0
    assert connectivity.global_efficiency(e).first()["value"] == pytest.approx((1 + 1 + 0.5) / 3)
    connectivity.check_pairs(e)
    with pytest.raises(ValueError):
        connectivity.check_pairs(e.limit(2))


def test_complexity_kernels():
    rng = np.random.default_rng(0)
    assert kernels.higuchi(np.arange(200.0)) == pytest.approx(1.0, abs=1e-6)
    assert kernels.higuchi(rng.normal(size=2000)) == pytest.approx(2.0, abs=0.1)
    assert kernels.detrended_fluctuation(rng.normal(size=5000)) == pytest.approx(0.5, abs=0.08)
    assert math.isnan(kernels.detrended_fluctuation(np.ones(100))) and math.isnan(kernels.lempel_ziv(np.ones(50)))
    assert kernels.lempel_ziv(np.tile([0.0, 1.0], 100)) < kernels.lempel_ziv(rng.normal(size=200))
    assert math.isnan(kernels.sample_entropy(np.ones(50)))


def test_estimators_find_a_sine():
    t = np.arange(512) / 128
    x = np.sin(2 * np.pi * 10 * t)
    for f, p in (kernels.welch(x, 128.0, 128), kernels.multitaper(x, 128.0, 2.0)):
        assert f[p[0].argmax()] == pytest.approx(10, abs=0.5)
        assert (p[0] * (f[1] - f[0])).sum() == pytest.approx(0.5, rel=0.1)
    z = kernels.band_analytic(x, 128.0, 8.0, 13.0)[0]
    assert np.abs(z)[100:-100] == pytest.approx(1.0, abs=0.05)
    assert np.abs(kernels.band_analytic(x, 128.0, 20.0, 30.0)[0])[100:-100].max() < 0.05
    power = np.abs(kernels.morlet(x, 128.0, np.array([5.0, 10.0, 20.0]), np.array([5.0]))[0])[:, 256]
    assert power.argmax() == 1
    assert np.isnan(kernels.welch(np.r_[x[:100], NAN, x[101:]], 128.0, 128)[1]).all()


def test_pearson_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, INF)], "x double, y double")
    assert df.agg(safe_pearson("x", "y").alias("r")).first()["r"] is None


def test_bh(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double")
    got = {r["p"]: r["q"] for r in bh_adjust(df, "p").collect()}
    assert got == {0.01: pytest.approx(0.04), 0.03: pytest.approx(0.04 * 4 / 3), 0.04: pytest.approx(0.04 * 4 / 3), 0.5: 0.5}


def test_guards(spark):
    cells = spark.createDataFrame([("r", 0, "a", "f", 1.0)], "recording string, epoch int, event string, feature string, value double")
    good = spark.createDataFrame([("r", 0, "a", 2.0, "s", 30)], "recording string, epoch int, event string, rating double, subject string, age int")
    other = spark.createDataFrame([("r", 1, "a", 2.0, "s", 30)], good.schema)
    assert table.build_design(cells, good, "rating", "subject", ["age"]).count() == 1
    for bad in (other, good.unionByName(good), good.unionByName(other)):
        with pytest.raises(table.KeyMismatch):
            table.build_design(cells, bad, "rating", "subject")
    with pytest.raises(ValueError):
        table.build_design(cells, good, "rating", "subject", ["predicted_x"])
    with pytest.raises(table.KeyMismatch):
        table.stack_rows([cells, cells], validate=True)
    with pytest.raises(ValueError):
        table.Selection({"colour": ["red"]}).condition()


def test_reliability_closed_form(spark):
    rows = [("f", s, k, v) for (s, k), v in zip([(s, k) for s in "abc" for k in "xy"], [1.0, 3.0, 2.0, 4.0, 3.0, 5.0])]
    out = table.intraclass_reliability(spark.createDataFrame(rows, "feature string, subject string, session string, value double")).first()
    assert out["icc_consistency"] == pytest.approx(1.0) and out["icc_absolute"] == pytest.approx(1 / 3)


def test_microstates():
    assert spatial_models.smooth_states(np.array([0, 0, 0, 1, 0, 0, 2, 2, 2]), 2).tolist() == [0] * 6 + [2] * 3
    order = spatial_models.match_reference(np.array([[0, 1, 0, 2.0], [1, 0, 3, 0.0]]), np.array([[-1, 0, -3, 0.1], [0, 1, 0, 2.0]]))
    assert order == [1, 0]


def test_csp_separates_planted_sources(spark):
    rng = np.random.default_rng(1)
    mix, rows = rng.normal(size=(3, 3)), []
    for e in range(40):
        s = rng.normal(size=(3, 100)) * np.array([[4.0 if e % 2 else 1.0], [1.0 if e % 2 else 4.0], [1.0]])
        rows += [("r", e, "hi" if e % 2 else "lo", f"c{k}", 0.0, 10.0, x.tolist()) for k, x in enumerate(mix @ s)]
    df = spark.createDataFrame(rows, "recording string, epoch int, event string, channel string, t0 double, sfreq double, x array<double>")
    epochs = spatial_models.channel_matrix(df, ["c0", "c1", "c2"]).withColumn("fold", F.expr("(epoch div 2) % 2"))
    out = spatial_models.cross_fit_csp(epochs, "event", "fold", [0, 1], 3, 2).collect()
    hi, lo = (np.array([r["csp"] for r in out if r["event"] == k]).mean(axis=0) for k in ("hi", "lo"))
    assert np.abs(hi - lo).max() > 2 and len(out) == 40


def test_detrending_and_cutting(spark):
    line = preprocess.detrend_epochs(traces(spark, (0, "c", [1, 3, 5, 7]))).first()["x"]
    assert line == pytest.approx([0, 0, 0, 0], abs=1e-9)
    s = spark.createDataFrame([("r", "c", i, float(i)) for i in range(50)], "recording string, channel string, i long, x double")
    e = spark.createDataFrame([("r", 0, "a", 10), ("r", 1, "a", 12), ("r", 2, "a", 49)], "recording string, epoch int, event string, i long")
    out = {r["epoch"]: r["x"] for r in preprocess.cut_epochs(s, e, 2, 3).collect()}
    assert out == {0: [8, 9, 10, 11, 12, 13], 1: [10, 11, 12, 13, 14, 15]}
    bad = spark.createDataFrame([("r", 8, 9)], "recording string, start long, stop long")
    assert {r["epoch"] for r in preprocess.cut_epochs(s, e, 2, 3, bad).collect()} == {1}
    with pytest.raises(ValueError):
        preprocess.fixed_bounds(0.33, 0.1, 10.0)


def test_custom_measure(spark):
    out = complexity.signal_measure(traces(spark, (0, "c", [1, 2, NAN])), lambda x, t: float(np.nansum(x) + t[-1]), "own", [dims.Window("all")], include_global=False)
    assert value(out) == pytest.approx(3.2)
