"""Queries of phase, connectivity, graph, complexity and estimation, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from traceloom.functions.dims import Band, Window
from traceloom.operators import complexity, connectivity, estimators, models_of_spectra, phase, spectral
from traceloom.plans.catalog_signal import _SEGMENTS, ALPHA, BKEYS, FREQS, KEYS, _per
from traceloom.plans.sqltools import r, rounded, spatial
from traceloom.sources import views
from traceloom.sources.views import with_views

ALL, EARLY, LATE = Window("all"), Window("early", 0.0, 0.484375), Window("late", 0.5, 0.984375)
QUERIES, SQL = {}, {}

_UNITS = with_views("analytic") + """,
z AS (SELECT *, CASE WHEN i < 32 THEN 'early' ELSE 'late' END AS "window", sqrt(re * re + im * im) AS a FROM analytic),
u AS (SELECT *, re / nullif(a, 0) AS c, im / nullif(a, 0) AS s FROM z)"""


def _consistency(f, trials):
    def query(spark, sf_dir):
        return rounded(f(views.analytic(spark, sf_dir), [EARLY, LATE], trials), "value", "coverage")

    return query


for _m, _v in (("itpc", "sqrt(cc * cc + ss * ss) / n"), ("ppc", "(cc * cc + ss * ss - n) / nullif(n * (n - 1), 0)")):
    for _t, _g in (("all", "'all'"), ("event", "event")):
        _name = _m if _t == "all" else f"{_m}_by_event"
        QUERIES[_name] = _consistency(getattr(phase, _m), None if _t == "all" else "event")
        SQL[_name] = _UNITS + f""",
        per_t AS (SELECT {_g} AS trial_group, channel, "window", i, count(c) AS n, sum(c) AS cc, sum(s) AS ss, count(*) AS k FROM u GROUP BY ALL),
        per AS (SELECT trial_group, channel, "window", '{_m}' AS measure, avg(CASE WHEN n >= 2 THEN {_v} END) AS value, sum(n) * 1.0e0 / sum(k) AS coverage,
                       max(n) < 2 AS insufficient_trials FROM per_t GROUP BY ALL) """ + spatial("per", ("trial_group", '"window"', "measure"), flags=("insufficient_trials",))


def _slow_fast(spark, sf_dir):
    z = views.analytic(spark, sf_dir)
    one = lambda n: z.where(F.col("channel") == n).withColumn("channel", F.lit("n"))
    return one("n0"), one("n1")


_PAIRED = _UNITS + """,
pr AS (SELECT x.recording, x.epoch, x.event, 'n' AS channel, x."window", x.i, x.c, x.s, y.a FROM u x JOIN u y ON x.epoch = y.epoch AND x.i = y.i AND x.channel = 'n0' AND y.channel = 'n1')"""


def pac(spark, sf_dir):
    return rounded(phase.pac(*_slow_fast(spark, sf_dir), [EARLY, LATE]), "value", "coverage")


def pac_unnormalised(spark, sf_dir):
    return rounded(phase.pac(*_slow_fast(spark, sf_dir), [EARLY, LATE], normalize=False), "value", "coverage")


QUERIES |= {"pac": pac, "pac_unnormalised": pac_unnormalised}
for _name, _den in (("pac", "sum(a)"), ("pac_unnormalised", "count(*)")):
    SQL[_name] = _PAIRED + f""", per AS (SELECT recording, epoch, event, channel, "window", 'pac' AS measure, sqrt(pow(sum(a * c), 2) + pow(sum(a * s), 2)) / {_den} AS value,
    1.0e0 AS coverage FROM pr GROUP BY ALL) """ + spatial("per", KEYS)


def _surrogates(correction):
    def query(spark, sf_dir):
        out = phase.pac_surrogates(*_slow_fast(spark, sf_dir), [EARLY, LATE], draws=20, least_shift=4, seed=3, correction=correction)
        out = out.drop("degenerate_null")
        return rounded(out, "value", "null_mean", "null_std", "p", "p_adjusted", "corrected", digits=6).withColumn("z", F.round("z", 4) + F.lit(0.0))

    return query


for _c, _adj in {
    "none": "p", "bonferroni": "least(1.0e0, p * count(*) OVER (PARTITION BY epoch))",
    "fdr": "least(1.0e0, min(p * m / rk) OVER (PARTITION BY epoch ORDER BY p DESC))", "maxstat": "(1 + (SELECT count(*) FROM tops t WHERE t.epoch = b.epoch AND t.top >= b.o - 2.220446049250313e-14 * abs(b.o))) / 21.0e0",
}.items():
    QUERIES[f"pac_surrogates_{_c}"] = _surrogates(_c)
    SQL[f"pac_surrogates_{_c}"] = _PAIRED + f""",
    n AS (SELECT *, i % 32 AS j FROM pr),
    d AS (SELECT CAST(k AS BIGINT) AS k, CASE WHEN k = 0 THEN 0 ELSE 4 + ((k * 2654435761 + 133854) % 4294967296) % 25 END AS shift FROM generate_series(0, 20) AS g(k)),
    sh AS (SELECT x.recording, x.epoch, x.event, x."window", k, sqrt(pow(sum(x.a * y.c), 2) + pow(sum(x.a * y.s), 2)) / sum(x.a) AS v
           FROM n x CROSS JOIN d JOIN n y ON y.epoch = x.epoch AND y."window" = x."window" AND y.j = (x.j + shift) % 32 GROUP BY ALL),
    un AS (SELECT sh.*, sp AS space, kind AS space_kind FROM sh, (VALUES ('n', 'channel'), ('global', 'global')) AS q(sp, kind)),
    ob AS (SELECT *, v AS o FROM un WHERE k = 0),
    tops AS (SELECT epoch, k, max(v) AS top FROM un WHERE k > 0 GROUP BY ALL),
    b0 AS (SELECT ob.recording, ob.epoch, ob.event, ob."window", ob.space, ob.space_kind, any_value(o) AS o, avg(un.v) AS mu, stddev_pop(un.v) AS sd,
                 (1 + count(*) FILTER (un.v >= o - 2.220446049250313e-14 * abs(o))) / 21.0e0 AS p
          FROM ob JOIN un ON un.epoch = ob.epoch AND un."window" = ob."window" AND un.space = ob.space AND un.k > 0 GROUP BY ALL),
    b AS (SELECT *, count(*) OVER (PARTITION BY epoch) AS m, count(*) OVER (PARTITION BY epoch ORDER BY p) AS rk FROM b0)
    SELECT recording, epoch, event, "window", space, space_kind, {r('o', 'value')}, {r('mu', 'null_mean')}, {r('sd', 'null_std')}, {r('p', 'p')}, {r('o - mu', 'corrected')},
           {r('(o - mu) / nullif(sd, 0)', 'z', 4)}, {r(_adj, 'p_adjusted')} FROM b"""

# Connectivity -------------------------------------------------------------------

_CROSS = _UNITS + """,
pq AS (SELECT x.epoch, x.event, x."window", x.i, 'n0' AS a, 'n1' AS b, x.re AS ra, x.im AS ia, y.re AS rb, y.im AS ib, x.a AS ma, y.a AS mb,
              x.re * y.re + x.im * y.im AS re, x.im * y.re - x.re * y.im AS im FROM u x JOIN u y ON x.epoch = y.epoch AND x.i = y.i AND x.channel = 'n0' AND y.channel = 'n1')"""


def _envelope(orthogonalize):
    def query(spark, sf_dir):
        out = connectivity.envelope_correlation(views.analytic(spark, sf_dir), [EARLY, LATE], "event", orthogonalize=orthogonalize)
        return rounded(out, "value")

    return query


for _name, _o, _e in (("envelope_correlation", False, "corr(ma, mb)"), ("envelope_correlation_orthogonal", True, "(abs(corr(abs(im / mb), mb)) + abs(corr(abs(im / ma), ma))) / 2")):
    QUERIES[_name] = _envelope(_o)
    SQL[_name] = _CROSS + f""", t AS (SELECT event, epoch, "window", a, b, {_e} AS r FROM pq GROUP BY ALL)
    SELECT event AS trial_group, "window", a, b, {r('tanh(avg(atanh(greatest(-0.999999, least(0.999999, r)))))', 'value')} FROM t GROUP BY ALL"""

_BANDS = (Band("low", 0.0, 12.0), Band("high", 12.0, 40.0))


def _connect(method):
    def query(spark, sf_dir):
        z = views.analytic(spark, sf_dir).withColumnRenamed("channel", "node")
        out = connectivity.spectral_connectivity(z, FREQS, [method], _BANDS, "event")
        return rounded(out, "value")

    return query


for _m, _e in {
    "coh": "sqrt(re * re + im * im) / sqrt(xx * yy)", "imcoh": "abs(im) / sqrt(xx * yy)", "plv": "sqrt(ur * ur + ui * ui) / n",
    "ciplv": "abs(ui / n) / sqrt(1 - pow(ur / n, 2))", "ppc": "(ur * ur + ui * ui - n) / (n * (n - 1))", "pli": "abs(sg) / n",
    "wpli": "abs(im) / nullif(ai, 0)", "wpli2_debiased": "(im * im - i2) / nullif(ai * ai - i2, 0)",
}.items():
    QUERIES[f"connectivity_{_m}"] = _connect(_m)
    SQL[f"connectivity_{_m}"] = _CROSS + f""",
    s AS (SELECT event, a, b, i, count(*) * 1.0e0 AS n, sum(re) AS re, sum(im) AS im, sum(ma * ma) AS xx, sum(mb * mb) AS yy, sum(abs(im)) AS ai, sum(im * im) AS i2,
                 sum(sign(im)) AS sg, sum(re / sqrt(re * re + im * im)) AS ur, sum(im / sqrt(re * re + im * im)) AS ui FROM pq GROUP BY ALL HAVING count(*) >= 2)
    SELECT event AS trial_group, a, b, CASE WHEN 0.75e0 * i < 12 THEN 'low' ELSE 'high' END AS band, '{_m}' AS method, {r('avg(' + _e + ')', 'value')}
    FROM s WHERE 0.75e0 * i < 40 GROUP BY ALL"""


def edges(spark, sf_dir):
    """Cosine similarities of the vectors of each run of eight."""
    v = views.table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("graph"), (F.col("vec_id") % 8).cast("string").alias("n"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, y: acc + y)
    both = v.alias("l").join(v.alias("r"), "graph").where("l.n < r.n")
    w = dot(F.col("l.x"), F.col("r.x")) / F.sqrt(dot(F.col("l.x"), F.col("l.x")) * dot(F.col("r.x"), F.col("r.x")))
    return both.select("graph", F.col("l.n").alias("a"), F.col("r.n").alias("b"), w.alias("w"))


_EDGES = """v AS (SELECT vec_id // 8 AS graph, CAST(vec_id % 8 AS VARCHAR) AS n, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT l.graph, l.n AS a, r.n AS b, list_cosine_similarity(l.x, r.x) AS w FROM v l JOIN v r ON l.graph = r.graph AND l.n < r.n)"""


def clustering_coefficient(spark, sf_dir):
    return rounded(connectivity.clustering_coefficient(edges(spark, sf_dir), 0.1), "value")


def global_efficiency(spark, sf_dir):
    return rounded(connectivity.global_efficiency(edges(spark, sf_dir)), "value")


QUERIES |= {"clustering_coefficient": clustering_coefficient, "global_efficiency": global_efficiency}
SQL["clustering_coefficient"] = f"""WITH {_EDGES},
    h AS (SELECT graph, a, b FROM e WHERE abs(w) > 0.1), both_ways AS (SELECT * FROM h UNION ALL SELECT graph, b, a FROM h),
    k AS (SELECT v.graph, v.n, count(b) AS k FROM v LEFT JOIN both_ways s ON s.graph = v.graph AND s.a = v.n GROUP BY ALL),
    t AS (SELECT x.graph, x.a AS n, count(*) AS t FROM both_ways x JOIN both_ways y ON y.graph = x.graph AND y.a = x.a AND x.b < y.b JOIN h ON h.graph = x.graph AND h.a = x.b AND h.b = y.b GROUP BY ALL)
    SELECT k.graph, {r('avg(CASE WHEN k.k >= 2 THEN 2.0e0 * coalesce(t, 0) / (k.k * (k.k - 1)) ELSE 0 END)', 'value')} FROM k LEFT JOIN t ON t.graph = k.graph AND t.n = k.n
    GROUP BY k.graph HAVING count(*) > 1"""
SQL["global_efficiency"] = f"""WITH {_EDGES},
    d1 AS (SELECT graph, a, b, 1 / abs(w) AS d FROM e UNION ALL SELECT graph, b, a, 1 / abs(w) FROM e UNION ALL SELECT graph, n, n, 0 FROM v),
    d2 AS (SELECT x.graph, x.a, y.b, min(x.d + y.d) AS d FROM d1 x JOIN d1 y ON y.graph = x.graph AND y.a = x.b GROUP BY ALL),
    d4 AS (SELECT x.graph, x.a, y.b, min(x.d + y.d) AS d FROM d2 x JOIN d2 y ON y.graph = x.graph AND y.a = x.b GROUP BY ALL),
    d8 AS (SELECT x.graph, x.a, y.b, min(x.d + y.d) AS d FROM d4 x JOIN d4 y ON y.graph = x.graph AND y.a = x.b GROUP BY ALL)
    SELECT graph, {r('avg(1 / d)', 'value')} FROM d8 WHERE a <> b GROUP BY graph"""

# Complexity ---------------------------------------------------------------------


def permutation_entropy(spark, sf_dir):
    return rounded(complexity.permutation_entropy(views.traces(spark, sf_dir, gaps=False), [ALL]), "value", "coverage")


def sample_entropy(spark, sf_dir):
    return rounded(complexity.sample_entropy(views.traces(spark, sf_dir), [ALL]), "value", "coverage")


def multiscale_entropy(spark, sf_dir):
    return rounded(complexity.multiscale_entropy(views.traces(spark, sf_dir, gaps=False), [ALL], 2, r=0.4), "value", "coverage")


def higuchi_fd(spark, sf_dir):
    return rounded(complexity.higuchi_fd(views.traces(spark, sf_dir, gaps=False), [ALL]), "value", "coverage")


def lempel_ziv_complexity(spark, sf_dir):
    return rounded(complexity.lempel_ziv(views.traces(spark, sf_dir, gaps=False), [ALL]), "value", "coverage")


def dfa_exponent(spark, sf_dir):
    return rounded(complexity.detrended_fluctuation(views.traces(spark, sf_dir, gaps=False), [ALL]), "value", "coverage")


def custom_signal_measure(spark, sf_dir):
    """A user's kernel: the range of the samples."""
    return rounded(complexity.signal_measure(views.traces(spark, sf_dir, gaps=False), lambda x, t: float(x.max() - x.min()), "own_range", [ALL]), "value", "coverage")


QUERIES |= {f.__name__: f for f in (permutation_entropy, sample_entropy, multiscale_entropy, higuchi_fd, lempel_ziv_complexity, dfa_exponent, custom_signal_measure)}
_WHOLE = """ AS (SELECT recording, epoch, event, channel, 'all' AS "window", '{m}' AS measure, {e} AS value, {c} AS coverage FROM {f} GROUP BY ALL) """
SQL["custom_signal_measure"] = with_views("solid") + ", per" + _WHOLE.format(m="own_range", e="max(x) - min(x)", c="1.0e0", f="solid") + spatial("per", KEYS)
SQL["permutation_entropy"] = with_views("solid") + """,
    w AS (SELECT *, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM solid WINDOW o AS (PARTITION BY epoch, channel ORDER BY i)),
    p AS (SELECT recording, epoch, event, channel, CAST(x <= y AS INT) || '' || CAST(y <= z AS INT) || CAST(x <= z AS INT) AS pat, count(*) * 1.0e0 AS n FROM w WHERE z IS NOT NULL GROUP BY ALL),
    per""" + _WHOLE.format(m="permutation_entropy", e="-sum(n / 62 * log2(n / 62)) / log2(6)", c="1.0e0", f="p") + spatial("per", KEYS)
_SAMPEN = """,
    tpl AS (SELECT *, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM {src} WINDOW o AS (PARTITION BY epoch, channel ORDER BY i)),
    ok AS (SELECT * FROM tpl WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL),
    tol AS (SELECT epoch, channel, {r} * stddev_pop(x) AS tol, count(x) / 64.0e0 AS coverage FROM {base} GROUP BY ALL),
    m AS (SELECT p.epoch, p.channel, count(*) AS b, count(*) FILTER (abs(p.z - q.z) < tol) AS a FROM ok p JOIN ok q ON q.epoch = p.epoch AND q.channel = p.channel AND p.i < q.i
          JOIN tol ON tol.epoch = p.epoch AND tol.channel = p.channel WHERE abs(p.x - q.x) < tol AND abs(p.y - q.y) < tol GROUP BY ALL),
    k AS (SELECT DISTINCT recording, epoch, event, channel FROM {base}),
    per AS (SELECT k.*, 'all' AS "window", '{m}' AS measure, CASE WHEN a > 0 AND b > 0 THEN -ln(a * 1.0e0 / b) END AS value, coverage
            FROM k JOIN tol USING (epoch, channel) LEFT JOIN m USING (epoch, channel)) """
SQL["sample_entropy"] = with_views("samples") + _SAMPEN.format(src="samples", base="samples", r="0.2e0", m="sampen") + spatial("per", KEYS)
SQL["multiscale_entropy"] = with_views("solid") + ", cg AS (SELECT recording, epoch, event, channel, i // 2 AS i, avg(x) AS x FROM solid GROUP BY ALL)" + _SAMPEN.format(src="cg", base="solid", r="0.4e0", m="mse02") + spatial("per", KEYS)
SQL["higuchi_fd"] = with_views("solid") + """,
    st AS (SELECT CAST(k AS BIGINT) AS k FROM generate_series(1, 10) AS g(k)),
    df AS (SELECT p.recording, p.epoch, p.event, p.channel, k, p.i % k AS m, sum(abs(q.x - p.x)) AS s FROM solid p CROSS JOIN st JOIN solid q ON q.epoch = p.epoch AND q.channel = p.channel AND q.i = p.i + k GROUP BY ALL),
    ln_k AS (SELECT recording, epoch, event, channel, k, sum(s * 63 / (((63 - m) // k) * k * k)) / any_value(k) AS len FROM df GROUP BY recording, epoch, event, channel, k),
    per""" + _WHOLE.format(m="higuchi_fd", e="regr_slope(ln(len), -ln(k))", c="1.0e0", f="ln_k") + spatial("per", KEYS)

# Estimation -----------------------------------------------------------------------


def welch_band_power(spark, sf_dir):
    spectra, freqs = estimators.welch(views.traces(spark, sf_dir, gaps=False), [ALL], 64.0, 32, 2.0, 30.0)
    return rounded(spectral.band_power(spectra, freqs, bands=[ALPHA]), "value", "coverage")


def welch_density(spark, sf_dir):
    spectra, freqs = estimators.welch(views.traces(spark, sf_dir, gaps=False), [ALL], 64.0, 32, 2.0, 30.0)
    f = F.get(F.array(*(F.lit(x) for x in freqs)), F.col("bin"))
    return rounded(spectra.select("epoch", "channel", F.posexplode("p").alias("bin", "p")).withColumn("f", f), "p")


QUERIES["welch_density"] = welch_density
#: The transform written out: a sum over samples for each bin of each of the three half-overlapping segments.
SQL["welch_density"] = with_views("solid") + f""",
    seg AS (SELECT epoch, channel, s, i - 16 * s AS j, x - avg(x) OVER (PARTITION BY epoch, channel, s) AS x FROM solid, generate_series(0, 2) AS g(s) WHERE i >= 16 * s AND i < 16 * s + 32),
    win AS (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * j / 32)) AS y FROM seg),
    ft AS (SELECT epoch, channel, s, k, pow(sum(y * cos(2 * pi() * k * j / 32)), 2) + pow(sum(y * sin(2 * pi() * k * j / 32)), 2) AS p FROM win, generate_series(1, 15) AS h(k) GROUP BY ALL)
    SELECT epoch, channel, CAST(k - 1 AS INT) AS bin, 2.0e0 * k AS f, {r('avg(p) * 2 / (64 * 12)', 'p')} FROM ft GROUP BY epoch, channel, k"""


def multitaper_band_power(spark, sf_dir):
    spectra, freqs = estimators.multitaper(views.traces(spark, sf_dir, gaps=False), [ALL], 64.0, 64, 4.0, 1.0, 30.0)
    return rounded(spectral.band_power(spectra, freqs, bands=[ALPHA]), "value", "coverage")


def morlet_power(spark, sf_dir):
    freqs = [10.0, 14.0, 18.0]
    out = estimators.morlet(views.traces(spark, sf_dir, gaps=False), [ALL, LATE], 64.0, freqs, [3.0, 3.0, 3.0])
    return rounded(out.select("recording", "epoch", "event", "channel", "window", F.posexplode(F.arrays_zip("p", "support")).alias("bin", "z")).select("*", "z.*").drop("z"), "p", "support")


def band_signal_itpc(spark, sf_dir):
    z = estimators.band_signal(views.traces(spark, sf_dir, gaps=False), ALPHA, 64.0)
    return rounded(phase.itpc(z, [ALL], "event"), "value", "coverage")


def spectral_connectivity_fourier(spark, sf_dir):
    rows, freqs = estimators.cross_inputs(views.traces(spark, sf_dir, gaps=False), 64.0, 64, 4.0)
    out = connectivity.spectral_connectivity(rows, freqs, connectivity.METHODS, [ALPHA], "event", keys=("recording", "epoch", "event", "taper"))
    return rounded(out, "value")


def irasa(spark, sf_dir):
    out, _ = estimators.irasa(views.traces(spark, sf_dir, gaps=False), 64.0, 32)
    return out.select("recording", "epoch", "event", "channel", F.posexplode(F.arrays_zip("aperiodic", "periodic")).alias("bin", "z")).select("*", "z.*").drop("z")


QUERIES |= {f.__name__: f for f in (welch_band_power, multitaper_band_power, morlet_power, band_signal_itpc, spectral_connectivity_fourier, irasa)}


def spectral_parameterization(spark, sf_dir):
    return models_of_spectra.spectral_parameterization(views.spectra(spark, sf_dir), FREQS, [ALPHA])


def cycle_features(spark, sf_dir):
    return models_of_spectra.cycle_features(views.traces(spark, sf_dir, gaps=False), [ALL], [ALPHA], 64.0, {"monotonicity": 0.4, "min_cycles": 1})


def connectivity_over_time(spark, sf_dir):
    return models_of_spectra.connectivity_over_time(views.traces(spark, sf_dir, gaps=False), ["coh", "plv", "wpli"], [Band("b", 12.0, 20.0)], ALL, [12.0, 14.0, 16.0, 18.0], 64.0, 3.0)


def custom_spectral_measure(spark, sf_dir):
    """A user's kernel over spectra: the band integral."""
    out = models_of_spectra.spectral_measure(views.spectra(spark, sf_dir), FREQS, lambda p, f, w: p @ w, "own_power", [ALPHA])
    return rounded(out, "value", "coverage")


_TF, _TC = [8.0, 12.0, 16.0, 24.0], [3.0, 3.0, 3.0, 3.0]


def _reduced(statistic):
    def query(spark, sf_dir):
        t = views.traces(spark, sf_dir, gaps=False).withColumn("bin", F.substring("channel", 2, 1).cast("int"))
        t = t.select("recording", "epoch", "event", "channel", "bin", "t0", "sfreq", F.transform("x", lambda v: v * v).alias("p"))
        return rounded(estimators.reduce_tfr(t, [ALL, LATE], _TF, _TC, statistic), "p", "support", digits=8)

    return query


for _s, _e in (("mean", "avg(x * x) / 64"), ("median", "quantile_cont(x * x, 0.5) / ln(2) / 64")):
    QUERIES[f"tfr_window_{_s}"] = _reduced(_s)
    SQL[f"tfr_window_{_s}"] = with_views("solid") + f""",
    f(bin, f) AS (VALUES (0, 8.0e0), (1, 12.0e0), (2, 16.0e0), (3, 24.0e0)), w(win, t0, t1, n) AS (VALUES ('all', 0.0e0, 0.984375e0, 64), ('late', 0.5e0, 0.984375e0, 32)),
    s AS (SELECT *, CAST(substr(channel, 2, 1) AS INT) AS bin FROM solid),
    k AS (SELECT DISTINCT recording, epoch, event, channel, bin FROM s)
    SELECT k.recording, k.epoch, k.event, k.channel, win AS "window", k.bin, round({_e}, 8) + 0.0e0 AS p, round(count(x) * 1.0e0 / any_value(w.n), 8) AS support
    FROM k JOIN f USING (bin) CROSS JOIN w LEFT JOIN s ON s.epoch = k.epoch AND s.channel = k.channel AND s.t >= w.t0 + 15 / (2 * pi() * f.f) - 1e-9 AND s.t <= w.t1 - 15 / (2 * pi() * f.f) + 1e-9
    GROUP BY k.recording, k.epoch, k.event, k.channel, win, k.bin"""

QUERIES |= {f.__name__: f for f in (spectral_parameterization, cycle_features, connectivity_over_time, custom_spectral_measure)}
SQL["custom_spectral_measure"] = _SEGMENTS + ", per AS (SELECT * FROM (" + _per("own_power", "total").split("AS (", 1)[1].rstrip()[:-1] + ") WHERE band = 'alpha') " + spatial("per", BKEYS)
