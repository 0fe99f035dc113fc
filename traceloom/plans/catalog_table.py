"""Queries of the feature table: naming, selection, binding, designs, quality, reliability; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions.dims import STANDARD_BANDS, feature_name_column, passband_fraction, slug_column
from traceloom.operators import table as T
from traceloom.plans.sqltools import bands_values, r, rounded
from traceloom.sources import views
from traceloom.sources.views import with_views

QUERIES, SQL = {}, {}
CELLS = with_views("cells")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def meta(spark: SparkSession) -> DataFrame:
    """The metadata dimension of the four features."""
    rows = [("quantity", "amount", "alpha", "units"), ("extendedprice", "amount", "beta", "money"), ("discount", "share", "alpha", "ratio"), ("tax", "share", "beta", "ratio")]
    df = spark.createDataFrame(rows, "feature string, measure string, band string, unit string")
    return df.withColumns({c: F.lit(v) for c, v in {"space": "line", "space_kind": "channel", "window": "all", "normalization": "raw", "source": "lines"}.items()})


@query("""SELECT lower(replace(replace(trim(n_name), '_', '-'), ' ', '-')) AS slug, 'tl_power_alpha_' || lower(replace(replace(trim(n_name), '_', '-'), ' ', '-')) || '_all_raw_p'
          || substr(sha256(n_name), 1, 12) AS name, sha256('welch' || chr(10) || n_name) AS computation FROM nation""")
def feature_names(spark, sf_dir):
    """Slugs, hashed feature names and computation hashes over names of nations."""
    n = F.col("n_name")
    return views.table(spark, sf_dir, "nation").select(
        slug_column(n).alias("slug"),
        feature_name_column(F.lit("power"), F.lit("alpha"), n, F.lit(None).cast("string"), F.lit("raw"), n).alias("name"),
        F.sha2(F.concat(F.lit("welch\n"), n), 256).alias("computation"),
    )


@query(f"""WITH {bands_values()} , p(highpass, lowpass) AS (VALUES (0.5e0, 40.0e0), (10.0e0, NULL), (NULL, 6.0e0), (30.0e0, 45.0e0))
          SELECT band, highpass, lowpass, {r("greatest(0, least(1, (least(fmax, coalesce(lowpass, fmax)) - greatest(fmin, coalesce(highpass, fmin))) / (fmax - fmin)))", "share")} FROM bands, p""")
def passband(spark, sf_dir):
    b = spark.createDataFrame([(x.name, x.fmin, x.fmax) for x in STANDARD_BANDS], "band string, fmin double, fmax double")
    p = spark.createDataFrame([(0.5, 40.0), (10.0, None), (None, 6.0), (30.0, 45.0)], "highpass double, lowpass double")
    share = passband_fraction(F.col("fmin"), F.col("fmax"), F.col("highpass"), F.col("lowpass"))
    return rounded(b.crossJoin(F.broadcast(p)).select("band", "highpass", "lowpass", share.alias("share")), "share")


@query(CELLS + f"SELECT feature, count(*) AS n, {r('sum(value)', 'total', 2)} FROM cells WHERE feature IN ('quantity', 'discount') GROUP BY feature")
def select_features(spark, sf_dir):
    own = T.select(views.features(spark, sf_dir), meta(spark), T.Selection({"band": ["alpha"]}))
    return rounded(own.groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=2)


@query(CELLS + f"SELECT feature, count(*) AS n, {r('sum(value)', 'total', 2)} FROM cells WHERE feature = 'extendedprice' GROUP BY feature")
def select_with_exclusion(spark, sf_dir):
    chosen = T.Selection({"measure": ["amount", "share"], "band": ["beta"]}, T.Selection({"measure": ["share"]}))
    own = T.select(views.features(spark, sf_dir), meta(spark), chosen)
    return rounded(own.groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=2)


@query(CELLS + "SELECT recording, epoch, event, feature, value FROM cells WHERE epoch IN (SELECT CAST(o_orderkey * 10 + 1 AS BIGINT) FROM orders WHERE o_orderstatus = 'P')")
def take_rows(spark, sf_dir):
    rows = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") * 10 + 1).cast("bigint").alias("epoch"))
    return T.take(views.features(spark, sf_dir), rows, ["epoch"]).select("recording", "epoch", "event", "feature", "value")


@query(CELLS + "SELECT feature, count(*) AS n, count(value) AS n_finite FROM cells WHERE feature <> 'tax' GROUP BY feature")
def drop_missing(spark, sf_dir):
    own = T.drop_missing(views.features(spark, sf_dir), 0.1)
    return own.groupBy("feature").agg(F.count("*").alias("n"), F.count("value").alias("n_finite"))


NAMES = ("quantity", "extendedprice", "discount", "tax")
_WIDE = "SELECT recording, epoch, event, " + ", ".join(f"max(value) FILTER (feature = '{n}') AS {n}" for n in NAMES) + " FROM cells GROUP BY recording, epoch, event"


@query(CELLS + _WIDE)
def to_wide(spark, sf_dir):
    return T.to_wide(views.features(spark, sf_dir), NAMES)


@query(CELLS + f", w AS ({_WIDE}) SELECT recording, epoch, event, feature, value FROM (UNPIVOT w ON quantity, discount INTO NAME feature VALUE value)")
def to_long(spark, sf_dir):
    wide = T.to_wide(views.features(spark, sf_dir), NAMES)
    return T.to_long(wide, ["quantity", "discount"])


@query(CELLS + "SELECT recording, epoch, event, feature, value, CASE WHEN feature = 'tax' THEN 1.0e0 ELSE support END AS support, feature = 'discount' AND flagged AS flagged FROM cells WHERE feature IN ('discount', 'tax')")
def concat_tables(spark, sf_dir):
    cells = views.features(spark, sf_dir).select("recording", "epoch", "event", "feature", "value", "support", "flagged")
    a, b = cells.where("feature = 'discount'"), cells.where("feature = 'tax'").drop("support", "flagged")
    return T.concat([a, b], flags=["flagged"])


@query(CELLS + "SELECT feature, count(*) AS n FROM cells GROUP BY feature")
def stack_identical(spark, sf_dir):
    cells = views.features(spark, sf_dir)
    return T.stack_rows([cells.where("recording < 'r3'"), cells.where("recording >= 'r3'")]).groupBy("feature").agg(F.count("*").alias("n"))


@query(CELLS + """SELECT recording, feature, CASE WHEN recording >= 'r3' AND feature = 'tax' THEN count(DISTINCT (epoch, event)) ELSE count(*) END AS n, count(value) AS n_values, sum(CASE WHEN recording >= 'r3' AND feature = 'tax' THEN 0 ELSE 1 END) AS n_covered
          FROM (SELECT recording, epoch, event, feature, CASE WHEN recording >= 'r3' AND feature = 'tax' THEN NULL ELSE value END AS value FROM cells) GROUP BY recording, feature""")
def stack_union(spark, sf_dir):
    cells = views.features(spark, sf_dir)
    out = T.stack_rows([cells.where("recording < 'r3'"), cells.where("recording >= 'r3' and feature <> 'tax'")], "union")
    return out.groupBy("recording", "feature").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.count_if(F.col("coverage") > 0).alias("n_covered"))


@query(CELLS + f"""SELECT l_linestatus AS "group", feature, count(*) AS n, {r('sum(c.value * l.l_extendedprice)', 'product', 0)} FROM cells c JOIN lineitem l ON c.epoch = l.l_orderkey * 10 + l.l_linenumber
          WHERE feature = 'discount' GROUP BY ALL""")
def build_design(spark, sf_dir):
    li = views.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("epoch"), "l_extendedprice", "l_linestatus", "l_shipdate")
    cells = views.features(spark, sf_dir).where("feature = 'discount'")
    design = T.build_design(cells, li, "l_extendedprice", "l_linestatus", ["l_shipdate"], ["epoch"], validate=False)
    return rounded(design.groupBy("group", "feature").agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("y")).alias("product")), "product", digits=0)


@query("SELECT CAST(o_orderkey AS BIGINT) AS epoch, o_orderstatus AS status, CAST(o_totalprice AS DOUBLE) AS rating FROM orders")
def merge_targets(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    left = o.select(F.col("o_orderkey").cast("bigint").alias("epoch"), F.col("o_orderstatus").alias("status"))
    right = o.select(F.col("o_orderkey").cast("bigint").alias("epoch"), F.col("o_totalprice").cast("double").alias("rating"))
    return T.merge_targets(left, right, ["epoch"], validate=False)


@query(CELLS + """, g AS (SELECT feature, CASE WHEN feature = 'quantity' AND recording = 'r3' THEN NULL ELSE value END AS value, recording FROM cells)
          SELECT feature FROM g GROUP BY feature HAVING count(DISTINCT CASE WHEN value IS NOT NULL THEN recording END) = (SELECT count(DISTINCT recording) FROM g)""")
def intersection_features(spark, sf_dir):
    cells = views.features(spark, sf_dir)
    cells = cells.withColumn("value", F.when(~((F.col("feature") == "quantity") & (F.col("recording") == "r3")), F.col("value")))
    return T.in_every_group(cells, "recording")


@query(CELLS + f"""SELECT feature, count(*) AS n, {r("sum(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM cells m WHERE m.feature = c.feature AND m.recording <> 'r0')))", 'total', 2)}
          FROM cells c WHERE recording = 'r0' GROUP BY feature""")
def harmonize_union(spark, sf_dir):
    cells = views.features(spark, sf_dir)
    _, test = T.harmonize(cells.where("recording <> 'r0'"), cells.where("recording = 'r0'"), "union_impute", "recording")
    return rounded(test.groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=2)


_POLICY = T.QualityPolicy(0.75, 0.9, ("flagged",))
_REASONS = "concat_ws(';', CASE WHEN coverage < 0.75 THEN 'coverage' END, CASE WHEN support < 0.9 THEN 'support' END, CASE WHEN flagged THEN 'flagged' END)"


@query(CELLS + f"SELECT recording, epoch, event, feature, CASE WHEN {_REASONS} = '' THEN value END AS value, {_REASONS} <> '' AS quality_rejected FROM cells")
def apply_quality(spark, sf_dir):
    masked, _ = T.apply_quality(views.features(spark, sf_dir), _POLICY)
    return masked.select("recording", "epoch", "event", "feature", "value", "quality_rejected")


@query(CELLS + f"SELECT reasons, count(*) AS n FROM (SELECT {_REASONS} AS reasons FROM cells) WHERE reasons <> '' GROUP BY reasons")
def quality_ledger(spark, sf_dir):
    _, ledger = T.apply_quality(views.features(spark, sf_dir), _POLICY)
    return ledger.groupBy("reasons").agg(F.count("*").alias("n"))


_FQ = f"""count(*) AS n_rows, count(value) AS n_finite, {r('1 - count(value) * 1.0e0 / count(*)', 'missing_fraction')}, {r('avg(coverage)', 'mean_coverage')},
          {r('avg(CASE WHEN flagged THEN 1.0e0 ELSE 0 END)', 'flagged_fraction')}"""


@query(CELLS + f"SELECT feature, {_FQ} FROM cells GROUP BY feature")
def feature_quality(spark, sf_dir):
    return rounded(T.feature_quality(views.features(spark, sf_dir), ["flagged"]), "missing_fraction", "mean_coverage", "flagged_fraction").withColumn("n_finite", F.col("n_finite").cast("bigint"))


@query(CELLS + f"SELECT recording, event, feature, {_FQ} FROM cells GROUP BY recording, event, feature")
def cohort_quality(spark, sf_dir):
    return rounded(T.feature_quality(views.features(spark, sf_dir), ["flagged"], ["recording", "event"]), "missing_fraction", "mean_coverage", "flagged_fraction")


@query("""SELECT 'r' || CAST(o_custkey % 9 AS VARCHAR) AS recording, max(o_custkey % 9 + 40) AS original, max(o_custkey % 9 + 31) AS retained, CAST(9 AS BIGINT) AS rejected FROM orders GROUP BY ALL""")
def recording_quality(spark, sf_dir):
    k = F.col("o_custkey") % 9
    rows = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), k.cast("string")).alias("recording"), (k + 40).alias("original"), (k + 31).alias("retained"))
    return T.recording_quality(rows).withColumn("rejected", F.col("rejected").cast("bigint"))


_ICC = """WITH s AS (SELECT user_id AS subject, event_type AS session, 'value' AS feature, avg(value) AS value FROM events GROUP BY ALL),
    full_s AS (SELECT *, count(*) OVER (PARTITION BY subject) AS k FROM s), b AS (SELECT * FROM full_s WHERE k = (SELECT count(DISTINCT event_type) FROM events)),
    g AS (SELECT feature, avg(value) AS mean, count(DISTINCT subject) AS n, count(DISTINCT session) AS k FROM b GROUP BY feature),
    rs AS (SELECT feature, sum(pow(m - gm, 2)) AS ss FROM (SELECT feature, subject, avg(value) AS m FROM b GROUP BY ALL) JOIN (SELECT feature, mean AS gm FROM g) USING (feature) GROUP BY feature),
    cs AS (SELECT feature, sum(pow(m - gm, 2)) AS ss FROM (SELECT feature, session, avg(value) AS m FROM b GROUP BY ALL) JOIN (SELECT feature, mean AS gm FROM g) USING (feature) GROUP BY feature),
    ts AS (SELECT feature, sum(pow(value - mean, 2)) AS ss FROM b JOIN g USING (feature) GROUP BY feature),
    m AS (SELECT g.feature, n, g.k, g.k * rs.ss / (n - 1) AS r, n * cs.ss / (g.k - 1) AS c, (ts.ss - g.k * rs.ss - n * cs.ss) / ((n - 1) * (g.k - 1)) AS e
          FROM g JOIN rs USING (feature) JOIN cs USING (feature) JOIN ts USING (feature)) """


@query(_ICC + f"SELECT feature, n, k, {r('(r - e) / (r + (k - 1) * e)', 'icc_consistency')}, {r('(r - e) / (r + (k - 1) * e + k * (c - e) / n)', 'icc_absolute')} FROM m")
def intraclass_reliability(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    s = e.groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("session")).agg(F.avg("value").alias("value")).withColumn("feature", F.lit("value"))
    whole = s.groupBy("subject").agg(F.count("*").alias("k"))
    kinds = e.agg(F.count_distinct("event_type").alias("k"))
    s = s.join(whole.join(F.broadcast(kinds), "k", "left_semi"), "subject", "left_semi")
    return rounded(T.intraclass_reliability(s), "icc_consistency", "icc_absolute")
