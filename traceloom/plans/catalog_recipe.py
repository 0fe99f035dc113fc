"""Queries of recipes: many measures from one plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.plans import recipe as R
from traceloom.plans.catalog_signal import _TEMPORAL
from traceloom.plans.sqltools import rounded, spatial
from traceloom.sources import views
from traceloom.sources.views import with_views

QUERIES, SQL = {}, {}
CHANNELS = ("c0", "c1", "c2", "c3")
RECIPE = {
    "windows": {"base": [0.0, 0.234375], "stim": [0.25, 0.984375]},
    "rois": {"front": "c[01]", "back": ["c2", "c3"]},
    "spectra": {"fmax": 30.0, "n_fft": 16, "fmin": 2.0},
    "trials": {"column": "event"},
    "defaults": {"spatial": ["channels", "global"]},
    "features": [
        {"measures": ["variance", "line_length", "ptp"], "spatial": ["rois", "global"]},
        {"measure": "band_power", "bands": ["alpha", "beta"], "baseline": "base", "normalize": "db"},
        {"measure": "band_power", "bands": ["theta", "beta"], "windows": ["stim"], "ratios": [["theta", "beta"]], "asymmetry": [["c0", "c1"]]},
        {"measure": "spectral_centroid", "bands": ["beta"], "windows": ["stim"]},
        {"measures": ["erds_mean", "erd_magnitude"], "bands": ["alpha"], "baseline": "base"},
        {"measures": ["burst_count", "burst_rate"], "bands": ["beta"], "windows": ["stim"]},
        {"measures": ["sample_entropy", "higuchi_fd"], "windows": ["stim"]},
        {"measure": "itpc", "bands": ["alpha"], "windows": ["stim"]},
    ],
}


def recipe_extract(spark, sf_dir):
    """All entries of a recipe as long cells."""
    cells, _ = R.extract(views.traces(spark, sf_dir, gaps=False), R.load_recipe(RECIPE), views.SFREQ, 64, CHANNELS)
    return cells


def recipe_cross_trial(spark, sf_dir):
    """The recipe's measures across trials, which never mix with those of epochs."""
    _, trials = R.extract(views.traces(spark, sf_dir, gaps=False), R.load_recipe(RECIPE), views.SFREQ, 64, CHANNELS)
    return trials


def recipe_time_domain(spark, sf_dir):
    """Three time-domain measures of a recipe over regions, fused into one aggregation."""
    own = {k: v for k, v in RECIPE.items() if k in ("windows", "rois")} | {"features": RECIPE["features"][:1]}
    cells, _ = R.extract(views.traces(spark, sf_dir), R.load_recipe(own), views.SFREQ, 64, CHANNELS)
    return rounded(cells.drop("feature", "band"), "value", "coverage")


def recipe_status(spark, sf_dir):
    """Recordings that no run has written yet."""
    return R.status(views.traces(spark, sf_dir), R.load_recipe(RECIPE), f"{sf_dir}/no-such-run").withColumn("n", F.lit(1))


QUERIES |= {f.__name__: f for f in (recipe_extract, recipe_cross_trial, recipe_time_domain, recipe_status)}
_PER = "SELECT recording, epoch, event, channel, \"window\", '{m}' AS measure, {e} AS value, count(x) * 1.0e0 / count(*) AS coverage FROM d2 GROUP BY recording, epoch, event, channel, \"window\""
SQL["recipe_time_domain"] = (
    with_views("samples")
    + _TEMPORAL.format(m="", e="0").rsplit("per AS", 1)[0]
    + "per AS (" + " UNION ALL ".join(_PER.format(m=m, e=e) for m, e in (("variance", "var_pop(x)"), ("line_length", "avg(abs(d)) * 64"), ("ptp", "max(x) - min(x)"))) + ") "
    + spatial("per", ("recording", "epoch", "event", '"window"', "measure"), groups={"front": ("c0", "c1"), "back": ("c2", "c3")})
)
SQL["recipe_status"] = "SELECT DISTINCT 'r' || CAST((vec_id // 4) % 5 AS VARCHAR) AS recording, 'missing' AS state, 1 AS n FROM embeddings"
