"""Queries of the signal measures, with SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from traceloom.functions.dims import Band, Window, band_weights, gradient_weights, trapezoid_weights
from traceloom.operators import events, spectral, temporal
from traceloom.operators.spatial import aggregate_space
from traceloom.plans.sqltools import bands_values, r, rounded, spatial
from traceloom.sources import views
from traceloom.sources.views import with_views

BASE, STIM = Window("base", 0.0, 0.234375), Window("stim", 0.25, 0.984375)
FREQS = [views.STEP_HZ * i for i in range(64)]
ALPHA = Band("alpha", 8.0, 13.0)
ROI = {"front": ("c0", "c1"), "back": ("c2", "c3")}
KEYS = ("recording", "epoch", "event", '"window"', "measure")
QUERIES, SQL = {}, {}

# Time domain ---------------------------------------------------------------

_TEMPORAL = """,
s AS (SELECT *, CASE WHEN i < 16 THEN 'base' ELSE 'stim' END AS "window" FROM samples),
d1 AS (SELECT *, lead(x) OVER (PARTITION BY epoch, channel, "window" ORDER BY i) - x AS d,
              count(*) FILTER (x IS NULL) OVER (PARTITION BY epoch, channel, "window" ORDER BY i) AS run_no FROM s),
d2 AS (SELECT *, lead(d) OVER (PARTITION BY epoch, channel, "window" ORDER BY i) - d AS d2,
              last_value(CASE WHEN x <> 0 THEN sign(x) END IGNORE NULLS) OVER (
                  PARTITION BY epoch, channel, "window", run_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d1),
per AS (SELECT recording, epoch, event, channel, "window", '{m}' AS measure, {e} AS value, count(x) * 1.0e0 / count(*) AS coverage FROM d2 GROUP BY ALL)
"""
_EXPR = {
    "variance": "var_pop(x)",
    "ptp": "max(x) - min(x)",
    "mean_amplitude": "avg(x)",
    "rms": "sqrt(avg(x * x))",
    "skewness": "CASE WHEN count(x) >= 3 THEN (avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * pow(avg(x), 3)) / nullif(pow(var_pop(x), 1.5), 0) END",
    "kurtosis": "CASE WHEN count(x) >= 4 THEN kurtosis_pop(x) END",
    "amplitude_quantile": "quantile_cont(x, 0.5)",
    "line_length": "avg(abs(d)) * 64",
    "hjorth_mobility": "CASE WHEN count(d) >= 2 THEN sqrt(var_pop(d * 64) / nullif(var_pop(x), 0)) / (2 * pi()) END",
    "hjorth_complexity": "CASE WHEN count(x) >= 3 AND count(d) >= 2 AND count(d2) >= 2 THEN sqrt(var_pop(d2) * var_pop(x)) / nullif(var_pop(d), 0) END",
    "auc": "sum((2 * x + d) / 2 / 64)",
    "peak_amplitude": "first(x ORDER BY abs(x) DESC NULLS LAST, i)",
    "peak_latency": "CASE WHEN count(x) > 0 THEN first(t ORDER BY abs(x) DESC NULLS LAST, i) END",
    "zero_crossing_rate": "CASE WHEN count(x) > 0 THEN count(*) FILTER (x <> 0 AND before <> sign(x)) / (count(*) / 64.0e0) END",
}


def _temporal(measure):
    def query(spark, sf_dir):
        out = temporal.temporal_features(views.traces(spark, sf_dir), [BASE, STIM], [measure])
        return rounded(out, "value", "coverage")

    return query


for _m, _e in _EXPR.items():
    QUERIES[f"time_{_m}"] = _temporal(_m)
    SQL[f"time_{_m}"] = with_views("samples") + _TEMPORAL.format(m=_m, e=_e) + spatial("per", KEYS)


def time_all_roi(spark, sf_dir):
    """All fourteen measures from one scan, over regions and all channels."""
    out = temporal.temporal_features(views.traces(spark, sf_dir), [BASE, STIM], temporal.MEASURES, ROI)
    return rounded(out, "value", "coverage")


QUERIES["time_fused_regions"] = time_all_roi
SQL["time_fused_regions"] = (
    with_views("samples")
    + _TEMPORAL.format(m="", e="0").rsplit("per AS", 1)[0]
    + "per AS (" + " UNION ALL ".join(f"""SELECT recording, epoch, event, channel, "window", '{m}' AS measure, CAST({e} AS DOUBLE) AS value, count(x) * 1.0e0 / count(*) AS coverage FROM d2 GROUP BY recording, epoch, event, channel, "window" """ for m, e in _EXPR.items()) + ") "
    + spatial("per", KEYS, groups=ROI)
)

# Spectra ---------------------------------------------------------------------

BKEYS = ("recording", "epoch", "event", '"window"', "band", "measure")
#: Integral over a band of the line through the bins, segment by segment.
_SEGMENTS = (
    with_views("bins")
    + ", "
    + bands_values()
    + """,
seg AS (SELECT *, lead(f) OVER w AS f2, lead(p) OVER w AS p2 FROM bins WINDOW w AS (PARTITION BY epoch, channel, "window" ORDER BY bin)),
cut AS (SELECT s.*, band, fmin, fmax, greatest(f, fmin) AS lo, least(f2, fmax) AS hi FROM seg s, bands WHERE f2 > fmin AND f < fmax),
area AS (SELECT recording, epoch, event, channel, "window", band, any_value(fmax - fmin) AS width,
                sum((hi - lo) * (p + (p2 - p) * ((lo + hi) / 2 - f) / (f2 - f))) AS total FROM cut GROUP BY ALL)"""
)


def _per(measure: str, value: str, base: str = "area") -> str:
    return f""", per AS (SELECT recording, epoch, event, channel, "window", band, '{measure}' AS measure, {value} AS value, 1.0e0 AS coverage FROM {base}) """


def _normal(measure: str, value: str, mode: str, base: str = "area") -> str:
    kept = {
        "log10": "log10(v)", "db": "10 * log10(v / b)", "log_ratio": "log10(v / b)", "percent": "100 * (raw - b) / b",
    }[mode]
    where = "" if mode == "log10" else """ WHERE "window" <> 'base'"""
    return f""", raw AS (SELECT *, {value} AS raw, max({value}) OVER (PARTITION BY epoch, channel, band) AS peak FROM {base}),
floored AS (SELECT *, greatest(raw, peak * 1e-12) AS v FROM raw),
based AS (SELECT *, max(CASE WHEN "window" = 'base' THEN v END) OVER (PARTITION BY epoch, channel, band) AS b FROM floored)
{_per(measure, kept, 'based').rstrip()[:-1]}{where}) """


def _spectral(f, **kw):
    def query(spark, sf_dir):
        return rounded(f(views.spectra(spark, sf_dir), FREQS, **kw), "value", "coverage")

    return query


for _name, _f, _value in (("mean_psd", spectral.mean_psd, "total / width"), ("mean_tfr_power", spectral.mean_tfr_power, "total / width"), ("band_power", spectral.band_power, "total")):
    QUERIES[f"spectral_{_name}"] = _spectral(_f)
    SQL[f"spectral_{_name}"] = _SEGMENTS + _per(_name, _value) + spatial("per", BKEYS)
for _mode in ("log10", "db", "log_ratio", "percent"):
    QUERIES[f"band_power_{_mode}"] = _spectral(spectral.band_power, baseline=None if _mode == "log10" else "base", normalize=_mode)
    SQL[f"band_power_{_mode}"] = _SEGMENTS + _normal("band_power", "total", _mode) + spatial("per", BKEYS)
QUERIES["band_power_regions"] = _spectral(spectral.band_power, groups=ROI, include_global=False)
SQL["band_power_regions"] = _SEGMENTS + _per("band_power", "total") + spatial("per", BKEYS, groups=ROI, include_global=False)

_PICKED = (
    with_views("bins")
    + ", "
    + bands_values()
    + """,
own AS (SELECT b.*, band FROM bins b, bands WHERE f >= fmin AND f < fmax),
ends AS (SELECT *, min(f) OVER k AS f_lo, max(f) OVER k AS f_hi, sum(p * 0.75e0) OVER (PARTITION BY epoch, channel, "window", band ORDER BY f) AS cum,
                sum(p * 0.75e0) OVER k AS mass, count(*) OVER k AS n FROM own WINDOW k AS (PARTITION BY epoch, channel, "window", band)),
moments AS (SELECT recording, epoch, event, channel, "window", band, sum(f * p) / sum(p) AS c, sqrt(sum(p * f * f) / sum(p) - pow(sum(f * p) / sum(p), 2)) AS spread,
                   -sum(CASE WHEN p > 0 THEN p / mass * 0.75e0 * ln(p / mass * 0.75e0) ELSE 0 END) / ln(any_value(n)) AS entropy,
                   min(CASE WHEN cum >= 0.95e0 * mass THEN f END) AS edge FROM ends GROUP BY ALL)"""
)
for _name, _f, _value in (
    ("spectral_centroid", spectral.spectral_centroid, "c"), ("spectral_bandwidth", spectral.spectral_bandwidth, "spread"),
    ("spectral_entropy", spectral.spectral_entropy, "entropy"), ("spectral_edge", spectral.spectral_edge, "edge"),
):
    QUERIES[_name] = _spectral(_f)
    SQL[_name] = _PICKED + _per(_name, _value, "moments") + spatial("per", BKEYS)


def band_ratio(spark, sf_dir):
    table = spectral.band_power(views.spectra(spark, sf_dir), FREQS)
    return rounded(spectral.band_ratio(table, "theta", "beta"), "value", "coverage")


def asymmetry(spark, sf_dir):
    table = spectral.band_power(views.spectra(spark, sf_dir), FREQS, include_global=False)
    return rounded(spectral.asymmetry(table, [("c0", "c1"), ("c2", "c3")]), "value", "coverage")


QUERIES |= {"band_ratio": band_ratio, "asymmetry": asymmetry}
SQL["band_ratio"] = (
    _SEGMENTS + _per("band_power", "total") + ", cells AS (" + spatial("per", BKEYS, digits=15) + f""")
    SELECT recording, epoch, event, "window", 'ratio_theta_beta' AS measure, space, space_kind, {r("max(value) FILTER (band = 'theta') / nullif(max(value) FILTER (band = 'beta'), 0)", "value")},
           {r("min(coverage)", "coverage")} FROM cells WHERE band IN ('theta', 'beta') GROUP BY ALL"""
)
SQL["asymmetry"] = (
    _SEGMENTS + f""", sides AS (SELECT *, CASE WHEN channel IN ('c0', 'c1') THEN 'c0-c1' ELSE 'c2-c3' END AS space, channel IN ('c1', 'c3') AS rgt FROM area)
    SELECT recording, epoch, event, "window", band, space, {r("(max(total) FILTER (rgt) - max(total) FILTER (NOT rgt)) / nullif(sum(total), 0)", "value")},
           1.0e0 AS coverage, 'asymmetry' AS measure, 'pair' AS space_kind FROM sides GROUP BY recording, epoch, event, "window", band, space HAVING count(*) = 2"""
)


def aperiodic_ols(spark, sf_dir):
    """The fit's first round by built-in regression; the robust rounds are in spectral.aperiodic."""
    return rounded(spectral.ols_fit(views.spectra(spark, sf_dir), FREQS), "slope", "offset", "r_squared")


QUERIES["aperiodic_first_round"] = aperiodic_ols
SQL["aperiodic_first_round"] = with_views("bins") + f"""
    SELECT recording, epoch, event, channel, "window", {r('regr_slope(log10(p), log10(f))', 'slope')}, {r('regr_intercept(log10(p), log10(f))', '"offset"')},
           {r('regr_r2(log10(p), log10(f))', 'r_squared')} FROM bins WHERE f BETWEEN 2 AND 40 AND p > 0 GROUP BY ALL HAVING count(*) >= 5"""


def aperiodic(spark, sf_dir):
    return rounded(spectral.aperiodic(views.spectra(spark, sf_dir), FREQS), "value", "coverage")


def aperiodic_ratio(spark, sf_dir):
    out = spectral.aperiodic_ratio(views.spectra(spark, sf_dir), FREQS)
    return out.select(*("recording", "epoch", "event", "channel", "window", "aperiodic_fit_failed"), F.posexplode("p").alias("bin", "p"))


def periodic_power(spark, sf_dir):
    return rounded(spectral.periodic_power(views.spectra(spark, sf_dir), FREQS), "value", "coverage")


def peak_frequency(spark, sf_dir):
    return rounded(spectral.peak_frequency(views.spectra(spark, sf_dir), FREQS, ALPHA), "value", "coverage")


QUERIES |= {"aperiodic": aperiodic, "aperiodic_ratio": aperiodic_ratio, "periodic_power": periodic_power, "peak_frequency": peak_frequency}


def axis_weights(spark, sf_dir):
    """Trapezoid, gradient and band weights of the bin axis."""
    rows = [(k, float(f), float(a), float(b), float(c)) for k, (f, a, b, c) in enumerate(zip(FREQS, trapezoid_weights(FREQS), gradient_weights(FREQS), band_weights(FREQS, 8.0, 13.0)))]
    return rounded(spark.createDataFrame(rows, "bin int, f double, trapezoid double, gradient double, alpha double"), "trapezoid", "gradient", "alpha")


QUERIES["axis_weights"] = axis_weights
SQL["axis_weights"] = f"""
    WITH a AS (SELECT CAST(i AS INT) AS bin, 0.75e0 * i AS f FROM generate_series(0, 63) AS g(i)),
    s AS (SELECT *, lead(f) OVER (ORDER BY bin) AS f2 FROM a),
    c AS (SELECT *, greatest(least(f2, 13) - greatest(f, 8), 0) AS w, (greatest(f, 8) + least(f2, 13)) / 2 - f AS m, f2 - f AS step FROM s WHERE f2 IS NOT NULL),
    e AS (SELECT bin, w * (1 - m / step) AS x FROM c UNION ALL SELECT bin + 1, w * m / step FROM c)
    SELECT bin, f, {r("(coalesce(lead(f) OVER o, f) - coalesce(lag(f) OVER o, f)) / 2", "trapezoid")}, 0.75e0 AS gradient,
           {r("(SELECT sum(x) FROM e WHERE e.bin = a.bin)", "alpha")} FROM a WINDOW o AS (ORDER BY bin)"""


def spatial_units(spark, sf_dir):
    """Mean of each trace over regions and all, with the coverage rule."""
    means = temporal.temporal_channels(views.traces(spark, sf_dir), [Window("all")], ["mean_amplitude"]).withColumnRenamed("mean_amplitude", "value")
    return rounded(aggregate_space(means, ["recording", "epoch", "event", "window"], ROI), "value", "coverage")


QUERIES["spatial_aggregate"] = spatial_units
SQL["spatial_aggregate"] = with_views("samples") + """, per AS (
    SELECT recording, epoch, event, channel, 'all' AS "window", avg(x) AS value, count(x) / 64.0e0 AS coverage FROM samples GROUP BY ALL) """ + spatial("per", KEYS[:4], groups=ROI)

# Bursts -----------------------------------------------------------------------

_BURSTS = (
    with_views("samples")
    + """,
s AS (SELECT recording, epoch, event, channel, i, abs(x) AS x, CASE WHEN i < 16 THEN 'base' ELSE 'stim' END AS "window" FROM samples),
thr AS (SELECT epoch, channel, quantile_cont(x, 0.75) AS thr FROM s GROUP BY ALL),
a AS (SELECT s.*, thr, coalesce(x > thr, false) AS above FROM s JOIN thr USING (epoch, channel)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY epoch, channel, "window", above ORDER BY i) AS island FROM a),
runs AS (SELECT epoch, channel, "window", count(*) AS len, max(x) AS top FROM g WHERE above GROUP BY epoch, channel, "window", island HAVING count(*) >= 3),
k AS (SELECT epoch, channel, "window", count(*) AS n, avg(len) / 64 AS dur, avg(top) AS amp FROM runs GROUP BY ALL),
w AS (SELECT recording, epoch, event, channel, "window", count(x) AS fin, count(*) AS n_all, count(*) FILTER (above) AS hi FROM a GROUP BY ALL),
per AS (SELECT w.recording, w.epoch, w.event, w.channel, w."window", '{m}' AS measure, CASE WHEN fin > 0 THEN CAST({e} AS DOUBLE) END AS value, fin * 1.0e0 / n_all AS coverage
        FROM w LEFT JOIN k ON k.epoch = w.epoch AND k.channel = w.channel AND k."window" = w."window")
"""
)
for _m, _e in {"count": "coalesce(n, 0)", "rate": "coalesce(n, 0) / (n_all / 64.0e0)", "duration_mean": "dur", "amp_mean": "amp", "fraction_above": "hi * 1.0e0 / fin"}.items():

    def _burst(spark, sf_dir, m=_m):
        traces = events.envelope_traces(views.traces(spark, sf_dir))
        return rounded(events.burst_features(traces, [BASE, STIM], [m], min_ms=46.0), "value", "coverage")

    QUERIES[f"burst_{_m}"] = _burst
    SQL[f"burst_{_m}"] = _BURSTS.replace("{m}", _m).replace("{e}", _e) + spatial("per", KEYS)

# Event-related power ------------------------------------------------------------

_ERDS = (
    with_views("samples")
    + """,
s AS (SELECT recording, epoch, event, channel, i, t, x * x AS p FROM samples),
ref AS (SELECT epoch, channel, avg(p) FILTER (i < 16) AS raw, stddev_pop(p) FILTER (i < 16) AS dev, avg(p) AS scale, max(p) AS top,
               count(p) FILTER (i < 16) / 16.0e0 AS base_share FROM s GROUP BY ALL),
r AS (SELECT *, coalesce(raw <= 0 OR raw <= 1e-6 * scale, true) AS degenerate FROM ref),
y AS (SELECT s.*, dev, base_share, degenerate, CASE WHEN NOT degenerate THEN raw END AS r0, coalesce(top > 1e4 * raw AND NOT degenerate, false) AS extreme,
             CASE WHEN NOT degenerate AND p > 0 THEN 10 * log10(p / raw) END AS y FROM s JOIN r USING (epoch, channel) WHERE i >= 16),
o AS (SELECT *, coalesce(abs(p - r0) > dev, false) AS far FROM y),
g AS (SELECT *, i - row_number() OVER (PARTITION BY epoch, channel, far ORDER BY i) AS island FROM o),
onset AS (SELECT epoch, channel, min(t0) AS t0 FROM (SELECT epoch, channel, min(t) AS t0 FROM g WHERE far GROUP BY epoch, channel, island HAVING count(*) >= 4) GROUP BY ALL),
pk AS (SELECT epoch, channel, first(i ORDER BY abs(y) DESC NULLS LAST, i) AS at_i FROM y WHERE y IS NOT NULL GROUP BY ALL),
reb AS (SELECT epoch, channel, first(t ORDER BY y DESC NULLS LAST, i) AS rt FROM y JOIN pk USING (epoch, channel) WHERE i > at_i AND y IS NOT NULL GROUP BY ALL),
m AS (SELECT recording, epoch, event, channel, count(y) AS n, avg(y) AS mean, CASE WHEN count(y) > 2 THEN regr_slope(y, t) END AS slope,
             coalesce(-avg(y) FILTER (y < 0), 0) AS erd, count(*) FILTER (y < 0) / 64.0e0 AS erdt, coalesce(avg(y) FILTER (y > 0), 0) AS ers, count(*) FILTER (y > 0) / 64.0e0 AS erst,
             least(count(p) / 48.0e0, any_value(base_share)) AS coverage, bool_or(degenerate) AS baseline_degenerate, bool_or(extreme) AS baseline_extreme_ratio FROM y GROUP BY ALL),
per AS (SELECT m.recording, m.epoch, m.event, m.channel, 'stim' AS "window", '{m}' AS measure, CASE WHEN n > 0 THEN CAST({e} AS DOUBLE) END AS value, coverage,
               baseline_degenerate, baseline_extreme_ratio
        FROM m LEFT JOIN onset ON onset.epoch = m.epoch AND onset.channel = m.channel LEFT JOIN pk ON pk.epoch = m.epoch AND pk.channel = m.channel
               LEFT JOIN reb ON reb.epoch = m.epoch AND reb.channel = m.channel)
"""
)
_FLAGS = ("baseline_degenerate", "baseline_extreme_ratio")
for _m, _e in {
    "erds_mean": "mean", "erds_slope": "slope", "erd_magnitude": "erd", "erd_duration": "erdt", "ers_magnitude": "ers", "ers_duration": "erst",
    "erds_peak_latency": "at_i / 64.0e0", "erds_onset_latency": "t0", "erds_rebound_latency": "rt",
}.items():

    def _erds(spark, sf_dir, m=_m):
        traces = events.power_traces(views.traces(spark, sf_dir))
        return rounded(events.erds_features(traces, BASE, [STIM], [m], onset_samples=4), "value", "coverage")

    QUERIES[_m] = _erds
    SQL[_m] = _ERDS.replace("{m}", _m).replace("{e}", _e) + spatial("per", KEYS, flags=_FLAGS)

