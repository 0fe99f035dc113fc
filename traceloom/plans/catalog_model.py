"""Queries of modelling: splits, metrics, nulls, intervals, estimators; with SQL."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from traceloom.model import estimators as E
from traceloom.model import inference as I
from traceloom.model import metrics as M
from traceloom.model import splits as S
from traceloom.model import workflow as W
from traceloom.plans.sqltools import r, rounded
from traceloom.sources import views
from traceloom.sources.views import with_views

QUERIES, SQL = {}, {}
PRED = with_views("predictions")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# Splits -----------------------------------------------------------------------------


@query("""WITH s AS (SELECT s_suppkey AS row_id, s_nationkey AS subject FROM supplier), g AS (SELECT subject AS held, row_number() OVER (ORDER BY subject) AS fold FROM (SELECT DISTINCT subject FROM s))
          SELECT CAST(fold AS INT) AS fold, row_id, CASE WHEN subject = held THEN 'test' ELSE 'train' END AS role FROM s, g""")
def loso_folds(spark, sf_dir):
    rows = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), F.col("s_nationkey").alias("subject"))
    return S.loso_folds(rows, ["row_id"])


@query("""WITH t AS (SELECT DISTINCT l_suppkey AS subject, l_linenumber AS run, l_orderkey * 10 + l_linenumber AS row_id FROM lineitem),
    runs AS (SELECT subject, run, row_number() OVER (PARTITION BY subject ORDER BY run) AS place FROM (SELECT DISTINCT subject, run FROM t)),
    f AS (SELECT subject, place AS test_place, row_number() OVER (ORDER BY subject, place) AS fold FROM runs WHERE place >= 3)
    SELECT CAST(f.fold AS INT) AS fold, t.subject, t.row_id, CASE WHEN r.place = test_place THEN 'test' ELSE 'train' END AS role FROM t JOIN runs r ON r.subject = t.subject AND r.run = t.run
    JOIN f ON f.subject = t.subject AND r.place <= test_place""")
def forward_folds(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")).distinct()
    return S.forward_folds(li, ["row_id"])


@query("""WITH t AS (SELECT l_suppkey AS subject, l_linenumber AS run, l_orderkey * 10 + l_linenumber AS row_id FROM lineitem),
    z AS (SELECT subject, run, count(*) AS size FROM t GROUP BY ALL), d AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY size DESC, run) - 1 AS rk, count(*) OVER (PARTITION BY subject) AS k FROM z),
    o AS (SELECT subject, run, rk % least(k, 3) AS own FROM d WHERE k >= 2), f AS (SELECT subject, own AS test, row_number() OVER (ORDER BY subject, own) AS fold FROM (SELECT DISTINCT subject, own FROM o))
    SELECT CAST(fold AS INT) AS fold, t.subject, row_id, CASE WHEN own = test THEN 'test' ELSE 'train' END AS role FROM t JOIN o ON o.subject = t.subject AND o.run = t.run JOIN f ON f.subject = t.subject""")
def within_subject_folds(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    return S.within_subject_folds(li, ["row_id"])


@query()
def balanced_folds(spark, sf_dir):
    """Whole groups dealt to five folds of near equal size."""
    li = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"))
    return S.balanced_folds(li, "subject", 5)


@query("""WITH x(label) AS (VALUES ('run-03'), ('Run2'), ('7'), ('4.0'), ('block 12'), ('none'), (NULL))
          SELECT label, TRY_CAST(CASE WHEN regexp_matches(label, '^\\s*[+-]?\\d+(\\.0*)?\\s*$') THEN regexp_extract(label, '([+-]?\\d+)', 1)
                 WHEN regexp_matches(label, '(?i)run-?\\d+') THEN regexp_extract(label, '(?i)run-?(\\d+)', 1) ELSE regexp_extract(label, '(\\d+)\\s*$', 1) END AS INT) AS run FROM x""")
def run_labels(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in ("run-03", "Run2", "7", "4.0", "block 12", "none", None)], "label string")
    return rows.select("label", S.run_number(F.col("label")).alias("run"))


# Metrics -----------------------------------------------------------------------------


@query(PRED + f"""SELECT condition, {r('corr(y, p)', 'pearson_r')}, {r('1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*))', 'r2')}, {r('1 - var_pop(y - p) / var_pop(y)', 'explained_variance')}, count(*) AS n
          FROM predictions GROUP BY condition""")
def regression_metrics(spark, sf_dir):
    return rounded(M.regression_metrics(views.predictions(spark, sf_dir), ["condition"]), "pearson_r", "r2", "explained_variance")


_RS = PRED + ", s AS (SELECT subject, greatest(-1, least(1, corr(y, p))) AS r, count(*) AS n FROM predictions GROUP BY subject HAVING count(*) >= 3 AND var_pop(y) > 0 AND var_pop(p) > 0) "
_Z = "atanh(greatest(-0.999999, least(0.999999, r)))"


@query(_RS + f"SELECT subject, {r('r', 'r')}, n FROM s")
def subject_correlations(spark, sf_dir):
    return rounded(M.subject_r(views.predictions(spark, sf_dir)).where("r is not null"), "r")


@query(_RS + f"SELECT {r(f'tanh(avg({_Z}))', 'subject_level_r')}, count(*) AS n_subjects FROM s")
def subject_level_r(spark, sf_dir):
    return rounded(M.subject_level_r(views.predictions(spark, sf_dir)), "subject_level_r")


@query(_RS + f"SELECT {r(f'tanh(sum((n - 3) * {_Z}) / sum(n - 3))', 'subject_level_r')}, count(*) AS n_subjects FROM s WHERE n > 3")
def subject_level_r_by_trials(spark, sf_dir):
    return rounded(M.subject_level_r(views.predictions(spark, sf_dir), "trial_count"), "subject_level_r")


@query(PRED + f""", c AS (SELECT *, y - avg(y) OVER w AS cy, p - avg(p) OVER w AS cp FROM predictions WINDOW w AS (PARTITION BY subject, fold)),
    s AS (SELECT subject, corr(cy, cp) AS r, count(*) - count(DISTINCT fold) + 1 AS n FROM c GROUP BY subject)
    SELECT {r(f'tanh(avg({_Z}))', 'subject_level_r')}, count(*) AS n_subjects FROM s WHERE n >= 3""")
def subject_level_r_by_fold(spark, sf_dir):
    return rounded(M.subject_level_r(views.predictions(spark, sf_dir), by_fold=True), "subject_level_r")


@query(PRED + f", s AS (SELECT subject, avg(abs(y - p)) AS a, sqrt(avg(pow(y - p, 2))) AS q FROM predictions GROUP BY subject) SELECT {r('avg(a)', 'mae', 4)}, {r('avg(q)', 'rmse', 4)}, count(*) AS n_subjects FROM s")
def subject_level_errors(spark, sf_dir):
    return rounded(M.subject_level_errors(views.predictions(spark, sf_dir)), "mae", "rmse", digits=4)


def _centred(cells: str) -> str:
    return PRED + f""", c AS (SELECT subject, y - avg(y) OVER w AS cy, p - avg(p) OVER w AS cp, nuisance - avg(nuisance) OVER w AS cn, count(*) OVER w AS k FROM predictions WINDOW w AS (PARTITION BY {cells})),
    s AS (SELECT subject, 1 - sum(pow(cy - cp, 2)) / sum(cy * cy) AS f, 1 - sum(pow(cy - cn, 2)) / sum(cy * cy) AS u, count(*) AS t FROM c WHERE k >= 2 GROUP BY subject HAVING sum(cy * cy) > 0)
    SELECT {r('avg(f)', 'full_r2')}, {r('avg(u)', 'nuisance_r2')}, {r('avg(f) - avg(u)', 'delta_r2')}, count(*) AS n_subjects, CAST(sum(t) AS BIGINT) AS n_trials FROM s"""


@query(_centred("subject"))
def within_subject_centred(spark, sf_dir):
    return rounded(M.centred_metrics(views.predictions(spark, sf_dir)), "full_r2", "nuisance_r2", "delta_r2")


@query(_centred("subject, condition"))
def within_condition_centred(spark, sf_dir):
    return rounded(M.centred_metrics(views.predictions(spark, sf_dir), ["subject", "condition"]), "full_r2", "nuisance_r2", "delta_r2")


def _binary(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("subject"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") > 30).cast("int").alias("p"), F.col("l_quantity").cast("double").alias("score")
    )


_BIN = "WITH b AS (SELECT l_suppkey AS subject, CAST(l_returnflag = 'R' AS INT) AS y, CAST(l_quantity > 30 AS INT) AS p, CAST(l_quantity AS DOUBLE) AS score FROM lineitem)"
_CONF = """count(*) FILTER (y = 0 AND p = 0) * 1.0e0 AS tn, count(*) FILTER (y = 0 AND p = 1) * 1.0e0 AS fp, count(*) FILTER (y = 1 AND p = 0) * 1.0e0 AS fn, count(*) FILTER (y = 1 AND p = 1) * 1.0e0 AS tp"""
_SCORES = """(tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 ELSE coalesce(tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)) END AS balanced_accuracy,
    tp / nullif(tp + fp, 0) AS "precision", tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, tn / nullif(tn + fp, 0) AS specificity"""
_AUC = """(sum(CASE WHEN y = 1 THEN rk + (ties - 1) / 2.0e0 END) - sum(y) * (sum(y) + 1) / 2.0e0) / nullif(sum(y) * (count(*) - sum(y)), 0)"""


@query(_BIN + f", x AS (SELECT {_CONF} FROM b), s AS (SELECT {_SCORES} FROM x), k AS (SELECT *, rank() OVER (ORDER BY score) AS rk, count(*) OVER (PARTITION BY score) AS ties, "
       f"""sum(y) OVER (ORDER BY score DESC) * 1.0e0 / count(*) OVER (ORDER BY score DESC) AS pr FROM b), a AS (SELECT {_AUC} AS auc, sum(y * pr) / sum(y) AS ap FROM k)
       SELECT {', '.join(r('"' + x + '"', '"' + x + '"') for x in M.SCORES)}, {r('auc', 'auc')}, {r('ap', 'average_precision')} FROM s, a""")  # fmt: skip
def classification_metrics(spark, sf_dir):
    return rounded(M.classification_metrics(_binary(spark, sf_dir)), *M.SCORES, "auc", "average_precision")


@query(_BIN + f", x AS (SELECT subject, {_CONF} FROM b GROUP BY subject), s AS (SELECT subject, {_SCORES} FROM x), k AS (SELECT *, rank() OVER (PARTITION BY subject ORDER BY score) AS rk, "
       f"""count(*) OVER (PARTITION BY subject, score) AS ties, sum(y) OVER (PARTITION BY subject ORDER BY score DESC) * 1.0e0 / count(*) OVER (PARTITION BY subject ORDER BY score DESC) AS pr FROM b),
       a AS (SELECT subject, {_AUC} AS auc, sum(y * pr) / nullif(sum(y), 0) AS ap FROM k GROUP BY subject)
       SELECT {', '.join(r('avg("' + x + '")', '"' + x + '"') for x in M.SCORES)}, {r('avg(auc)', 'auc')}, {r('avg(ap)', 'average_precision')} FROM s JOIN a USING (subject)""")  # fmt: skip
def classification_metrics_by_subject(spark, sf_dir):
    return rounded(M.classification_metrics(_binary(spark, sf_dir), "subject"), *M.SCORES, "auc", "average_precision")


@query(_BIN + f" SELECT subject, {_CONF} FROM b GROUP BY subject")
def confusion_by_subject(spark, sf_dir):
    return M.confusion(_binary(spark, sf_dir), ["subject"]).select("subject", "tn", "fp", "fn", "tp")


# Inference ---------------------------------------------------------------------------

_BLOCKS = "WITH b AS (SELECT l_suppkey AS subject, l_linenumber AS run, l_orderkey AS o, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem)"


def _blocks(spark, sf_dir):
    return views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("run"), F.col("l_orderkey").alias("o"), F.col("l_extendedprice").cast("double").alias("y"))


@query(_BLOCKS + """, k AS (SELECT *, row_number() OVER (PARTITION BY subject, run ORDER BY o, y) - 1 AS pos, count(*) OVER (PARTITION BY subject, run) AS n FROM b)
    SELECT k.subject, k.run, k.o, k.y, CASE WHEN k.n >= 8 THEN m.y ELSE k.y END AS permuted FROM k JOIN k m ON m.subject = k.subject AND m.run = k.run AND (m.pos + 3) % m.n = k.pos""")
def circular_shift_within_run(spark, sf_dir):
    return I.circular_permutation(_blocks(spark, sf_dir), ["subject", "run"], ["o", "y"], "y", 3)


@query(_BLOCKS + """, h1 AS (SELECT *, (CAST(2900899 AS BIGINT) * 1103515245 + 5 * 40692 + 12345) % 2147483648 AS a FROM b), h2 AS (SELECT *, (xor(a, a >> 13) * 69069 + 7) % 2147483648 AS c FROM h1),
    h3 AS (SELECT *, (c * 1103515245 + o * 40692 + 12345) % 2147483648 AS d FROM h2), h4 AS (SELECT *, (xor(d, d >> 13) * 69069 + 7) % 2147483648 AS e FROM h3),
    h AS (SELECT *, xor(e, e >> 15) % 2147483648 AS g, row_number() OVER (PARTITION BY subject ORDER BY o, run, y) AS pos FROM h4),
    q AS (SELECT subject, y AS permuted, row_number() OVER (PARTITION BY subject ORDER BY g, o, run, y) AS pos FROM h)
    SELECT h.subject, count(*) AS n, """ + r("sum(h.y * q.permuted) / 1e6", "product", 2) + ", " + r("avg(CASE WHEN h.y <> q.permuted THEN 1.0e0 ELSE 0 END)", "changed") + " FROM h JOIN q ON q.subject = h.subject AND q.pos = h.pos GROUP BY h.subject")
def permute_within_subject(spark, sf_dir):
    """One hashed rearrangement within subjects, and the share of rows that it changed."""
    rows = _blocks(spark, sf_dir)
    by_order = I.Window.partitionBy("subject").orderBy("o", "run", "y")
    by_draw = I.Window.partitionBy("subject").orderBy(I.draw_number(F.lit(5), F.col("o"), seed=42), "o", "run", "y")
    placed = rows.withColumn("pos", F.row_number().over(by_order)).join(rows.select("subject", F.row_number().over(by_draw).alias("pos"), F.col("y").alias("permuted")), ["subject", "pos"])
    out = placed.groupBy("subject").agg(F.count("*").alias("n"), (F.sum(F.col("y") * F.col("permuted")) / 1e6).alias("product"), F.avg((F.col("y") != F.col("permuted")).cast("int")).alias("changed"))
    return rounded(out.withColumn("product", F.round("product", 2) + F.lit(0.0)), "changed")


_UNIT = "WITH u AS (SELECT CAST(n_nationkey AS BIGINT) AS unit, CAST(n_nationkey * 7 % 11 - 4 AS DOUBLE) AS v FROM nation)"


def _units(spark, sf_dir):
    return views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("unit"), (F.col("n_nationkey") * 7 % 11 - 4).cast("double").alias("value"))


def _draw_sql(source: str, first: str, second: str, seed: int, modulus: int) -> str:
    return f"""d0 AS (SELECT *, (CAST({seed * 69069 + 1} AS BIGINT) * 1103515245 + {first} * 40692 + 12345) % 2147483648 AS a FROM {source}), d1 AS (SELECT *, (xor(a, a >> 13) * 69069 + 7) % 2147483648 AS c FROM d0),
    d2 AS (SELECT *, (c * 1103515245 + {second} * 40692 + 12345) % 2147483648 AS d FROM d1), d3 AS (SELECT *, (xor(d, d >> 13) * 69069 + 7) % 2147483648 AS e FROM d2),
    dr AS (SELECT *, xor(e, e >> 15) % {modulus} AS g FROM d3)"""


@query(_UNIT + ", s AS (SELECT CAST(k AS BIGINT) AS draw, CAST(j AS BIGINT) AS slot FROM generate_series(0, 199) AS x(k), generate_series(0, 24) AS z(j)), " + _draw_sql("s", "draw", "slot", 7, 25)
       + f", m AS (SELECT draw, avg(v) AS m FROM dr JOIN u ON u.unit = g GROUP BY draw) SELECT {r('(SELECT avg(v) FROM u)', 'mean')}, {r('quantile_cont(m, 0.025)', 'ci_low')}, {r('quantile_cont(m, 0.975)', 'ci_high')} FROM m")
def bootstrap_mean_ci(spark, sf_dir):
    return rounded(I.bootstrap_mean_ci(_units(spark, sf_dir), iterations=200, seed=7), "mean", "ci_low", "ci_high")


@query(_UNIT + ", s AS (SELECT u.*, CAST(k AS BIGINT) AS draw FROM u, generate_series(1, 200) AS x(k)), " + _draw_sql("s", "draw", "unit", 9, 2)
       + f", m AS (SELECT draw, avg(CASE WHEN g = 0 THEN -v ELSE v END) AS m FROM dr GROUP BY draw), t AS (SELECT avg(v) AS mean FROM u) SELECT {r('mean', 'mean')}, {r('(1 + count(*) FILTER (abs(m) >= abs(mean) - 2.220446049250313e-14 * abs(mean))) / 201.0e0', 'p')} FROM m, t GROUP BY mean")
def paired_sign_flip(spark, sf_dir):
    return rounded(I.sign_flip_p(_units(spark, sf_dir), iterations=200, seed=9), "mean", "p")


@query(PRED + f""", e AS (SELECT abs(y - p) AS e FROM predictions WHERE fold = 1), k AS (SELECT CAST(ceil((count(*) + 1) * 0.9 - 1e-9) AS BIGINT) AS k FROM e), q AS (SELECT e AS q FROM (SELECT e, row_number() OVER (ORDER BY e) AS rn FROM e), k WHERE rn = k)
    SELECT condition, count(*) AS n, {r('avg(CASE WHEN y BETWEEN p - q AND p + q THEN 1.0e0 ELSE 0 END)', 'covered')}, {r('avg(2 * q)', 'width', 2)} FROM predictions, q WHERE fold <> 1 GROUP BY condition""")
def split_conformal(spark, sf_dir):
    pred = views.predictions(spark, sf_dir)
    out = I.split_conformal(pred.where("fold = 1"), pred.where("fold <> 1").select("condition", "y", "p"), 0.1)
    out = out.groupBy("condition").agg(F.count("*").alias("n"), F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("int")).alias("covered"), F.avg(F.col("upper") - F.col("lower")).alias("width"))
    return rounded(out, "covered").withColumn("width", F.round("width", 2) + F.lit(0.0))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey % 3 AS fold, CAST(s_acctbal AS DOUBLE) AS y FROM supplier), t AS (SELECT n_nationkey AS row_id, f AS fold, n_nationkey * 10.0e0 + f AS p FROM nation, (VALUES (0), (1), (2)) AS v(f)),
    c AS (SELECT row_id, p - abs(y - 100) AS lo, p + abs(y - 100) AS hi FROM t JOIN s USING (fold)), k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY lo) AS rl, row_number() OVER (PARTITION BY row_id ORDER BY hi) AS rh, count(*) OVER (PARTITION BY row_id) AS n FROM c)
    SELECT row_id AS "row", max(CASE WHEN rl = CAST(floor(0.2 * (n + 1) + 1e-9) AS BIGINT) THEN lo END) AS lower, max(CASE WHEN rh = CAST(ceil(0.8 * (n + 1) - 1e-9) AS BIGINT) THEN hi END) AS upper FROM k GROUP BY row_id HAVING max(n) >= 4""")
def cv_plus_intervals(spark, sf_dir):
    s = views.table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 3).cast("int").alias("fold"), F.abs(F.col("s_acctbal").cast("double") - 100).alias("r"))
    t = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("fold")).withColumn("p", F.col("row") * 10.0 + F.col("fold"))
    return I.cv_plus(t, s, 0.2)


def _screen_cells(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(f"l_{n}").cast("double").alias("value")) for n in ("quantity", "discount", "tax"))))
    return li.select((F.col("l_suppkey") % 20).cast("bigint").alias("subject"), F.col("l_extendedprice").cast("double").alias("y"), cells.alias("c")).select("subject", "y", "c.*")


@query("""WITH c AS (SELECT l_suppkey % 20 AS subject, CAST(l_extendedprice AS DOUBLE) AS y, n AS feature, CAST(CASE n WHEN 'quantity' THEN l_quantity WHEN 'discount' THEN l_discount ELSE l_tax END AS DOUBLE) AS value
             FROM lineitem, (VALUES ('quantity'), ('discount'), ('tax')) AS v(n)),
    z AS (SELECT feature, subject, atanh(greatest(-0.999999, least(0.999999, corr(value, y)))) AS z FROM c GROUP BY ALL)
    SELECT feature, """ + f"{r('avg(z)', 'mean_z')}, {r('avg(z) / (stddev_samp(z) / sqrt(count(z)))', 't', 4)}, count(z) AS n FROM z GROUP BY feature")
def univariate_screen_statistics(spark, sf_dir):
    out = I.univariate_screen(_screen_cells(spark, sf_dir), flips=20).select("feature", "mean_z", "t", "n")
    return rounded(out, "mean_z").withColumn("t", F.round("t", 4) + F.lit(0.0))


@query()
def univariate_screen(spark, sf_dir):
    """Screen with family-wise and false-discovery adjusted p-values."""
    return I.univariate_screen(_screen_cells(spark, sf_dir), flips=100)


@query("SELECT r_name AS region, CAST(sum(n_nationkey) AS DOUBLE) AS importance FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def importance_by_field(spark, sf_dir):
    n = views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("feature"), "n_regionkey", F.col("n_nationkey").cast("double").alias("importance"))
    meta = n.join(views.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("feature", F.col("r_name").alias("region"))
    return I.importance_by(n.select("feature", "importance"), meta, "region")


# Estimators ----------------------------------------------------------------------------

_X = ("quantity", "discount", "tax")


def _design(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("row"), (F.col("l_suppkey") % 5).cast("int").alias("subject"), F.col("l_extendedprice").cast("double").alias("y"),
        *(F.col(f"l_{n}").cast("double").alias(n) for n in _X), (F.col("l_linenumber").cast("double")).alias("age"),
    )


@query(f"""SELECT {r('regr_slope(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE))', 'slope', 4)}, {r('regr_intercept(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE))', '"constant"', 2)}, count(*) AS n FROM lineitem""")
def normal_equations(spark, sf_dir):
    """Least squares of one column by the engine's normal equations."""
    e = E.normal_equations(_design(spark, sf_dir), ["quantity"], "y")[0]
    w = E.solve_ridge(e, 0.0)
    return spark.createDataFrame([(round(float(w[1]), 4) + 0.0, round(float(w[0]), 2) + 0.0, int(e["n"]))], "slope double, constant double, n bigint")


@query()
def cross_fit_ridge(spark, sf_dir):
    """Leave-one-subject-out ridge predictions with inner choice of the penalty."""
    out, _ = E.cross_fit_ridge(_design(spark, sf_dir), list(_X), "y", "subject")
    return out.select("row", "subject", "y", F.round("p", 4).alias("p"))


@query(f"""WITH d AS (SELECT CAST(l_suppkey % 5 AS INT) AS subject, CAST(l_extendedprice AS DOUBLE) AS y, CAST(l_linenumber AS DOUBLE) AS age FROM lineitem),
    f AS (SELECT subject, regr_slope(y, age) AS s, regr_intercept(y, age) AS i FROM d GROUP BY subject)
    SELECT subject, {r('sum(abs(y - i - s * age)) / 1e6', 'total', 4)}, {r('abs(sum((y - i - s * age) * age)) / 1e9', 'product', 3)} FROM d JOIN f USING (subject) GROUP BY subject""")
def residualise_within(spark, sf_dir):
    out = E.residualise_within(_design(spark, sf_dir), "y", "age", "subject")
    out = out.groupBy("subject").agg((F.sum(F.abs("residual")) / 1e6).alias("total"), (F.abs(F.sum(F.col("residual") * F.col("age"))) / 1e9).alias("product"))
    return rounded(out, "total", digits=4).withColumn("product", F.round("product", 3) + F.lit(0.0))


@query()
def residualise_targets(spark, sf_dir):
    """Target residuals of one fold, fitted on its training rows."""
    d = _design(spark, sf_dir)
    _, test = E.residualise(d.where("subject <> 0"), d.where("subject = 0"), "y", ["age", "tax"])
    return test.select("row", F.round("residual", 4).alias("residual"))


@query(f"""WITH c AS (SELECT CAST(l_suppkey % 5 AS INT) AS subject, n AS feature, CASE WHEN n = 'tax' AND (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE CAST(CASE n WHEN 'quantity' THEN l_quantity WHEN 'discount' THEN l_discount ELSE l_tax END AS DOUBLE) END AS v
             FROM lineitem, (VALUES ('quantity'), ('discount'), ('tax')) AS x(n)), w AS (SELECT feature, max(m) AS m FROM (SELECT feature, subject, 1 - count(v) * 1.0e0 / count(*) AS m FROM c GROUP BY ALL) GROUP BY feature)
    SELECT feature, count(v) AS n_finite, {r('1 - count(v) * 1.0e0 / count(*)', 'missing')}, {r('var_pop(v)', 'variance')}, min(v) = max(v) AS "constant", {r('any_value(m)', 'worst_group_missing')} FROM c JOIN w USING (feature) GROUP BY feature""")
def column_quality(spark, sf_dir):
    d = _design(spark, sf_dir).withColumn("tax", F.when((F.floor(F.col("row") / 10) + F.col("row") % 10) % 7 != 0, F.col("tax")))
    return rounded(E.column_quality(d, _X, "subject"), "missing", "variance", "worst_group_missing")


@query()
def prepared_features(spark, sf_dir):
    """Median imputation, constant columns out, selection and scaling, fitted on training rows."""
    d = _design(spark, sf_dir)
    model = Pipeline(stages=E.preparation(_X, percentile=70)).fit(d.where("subject <> 0"))
    return model.transform(d.where("subject = 0")).select("row", vector_to_array("features").alias("features"))


@query()
def random_forest(spark, sf_dir):
    d = _design(spark, sf_dir)
    make = lambda: [*E.preparation(_X, scale=False), E.regressor("random_forest", n_estimators=10, max_depth=4)]
    return E.cross_fit(d, range(5), "subject", make, ["row", "subject", "y"])


@query()
def elasticnet(spark, sf_dir):
    d = _design(spark, sf_dir)
    make = lambda: [*E.preparation(_X), E.regressor("elasticnet", alpha=0.1, l1_ratio=0.5)]
    return E.cross_fit(d, range(5), "subject", make, ["row", "subject", "y"])


@query()
def logistic_classifier(spark, sf_dir):
    d = E.balanced_weights(_design(spark, sf_dir).withColumn("y", (F.col("y") > 40000).cast("double")))
    make = lambda: [*E.preparation(_X), E.classifier("logistic", max_iter=20)]
    return E.cross_fit(d, range(5), "subject", make, ["row", "subject", "y"])


@query()
def hard_vote_ensemble(spark, sf_dir):
    d = _design(spark, sf_dir).withColumn("y", (F.col("y") > 40000).cast("double"))
    return E.counted_vote(d, range(5), "subject", _X, ["row"], [("logistic", {"max_iter": 10}), ("svm", {"max_iter": 10}), ("random_forest", {"n_estimators": 5})])


@query(f"""WITH m AS (SELECT avg(CAST(l_quantity AS DOUBLE)) AS q, avg(CAST(l_tax AS DOUBLE)) AS t FROM lineitem)
    SELECT 'quantity' AS feature, {r('avg(abs(CAST(l_quantity AS DOUBLE) - q) * 2)', 'importance')} FROM lineitem, m UNION ALL SELECT 'tax', {r('avg(abs(CAST(l_tax AS DOUBLE) - t) * 3)', 'importance')} FROM lineitem, m""")
def linear_attribution(spark, sf_dir):
    return rounded(E.shap_linear(_design(spark, sf_dir), ["quantity", "tax"], [2.0, -3.0]), "importance")


@query()
def permutation_importance(spark, sf_dir):
    return rounded(I.permutation_importance(_design(spark, sf_dir), ["quantity", "tax"], [1500.0, 10.0], 0.0, "row", repeats=2), "importance")


# Workflows -------------------------------------------------------------------------------


@query()
def run_model(spark, sf_dir):
    """Scores of a recipe's ridge model and of its baselines."""
    recipe = W.load_model_recipe({"task": "regression", "target": "y", "group": "subject", "features": list(_X), "covariates": ["age"], "models": ["ridge", "scaled_ridge"]})
    return W.run_model(_design(spark, sf_dir), recipe)[1]


@query()
def permutation_test(spark, sf_dir):
    """Observed and p of a ridge null of a few draws."""
    out = W.permutation_test(_design(spark, sf_dir), list(_X), "subject", ["row", "y"], 1.0, 5)
    return spark.createDataFrame([(out["observed"], out["p"])], "observed double, p double")


@query()
def quantile_intervals(spark, sf_dir):
    """Conformalised quantile intervals of one subject's rows."""
    d = _design(spark, sf_dir)
    out = W.quantile_intervals(d.where("subject < 3"), d.where("subject = 3"), d.where("subject = 4"), list(_X))
    return out.select("row", "y", "lower", "upper")


@query()
def staged_residuals(spark, sf_dir):
    """Features and target of a held-out subject after the staged preprocessing of the others."""
    d = _design(spark, sf_dir)
    state = W.fit_staged(d.where("subject <> 0"), list(_X), ["age"], "subject")
    return state.transform(d.where("subject = 0")).select("row", *state.features, "target")
