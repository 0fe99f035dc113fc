"""From documents to packed training sequences: five stages, each one operator of traceloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's rows as Parquet to the shared folder and reads them as the next one's; what
a stage has read and what it keeps there for itself goes when its rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import decontaminate, near_copies, packing, quality_rules, toxicity
from traceloom.llm.shared import cut, release, scratch_path, scratch_scope, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.7").select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the certified cutoffs reject."""
    # The verdict belongs to the row, not to its id: the measures are written beside the text, and
    # the calibration reads their columns only.
    measured = cut(spark, quality_rules.measure(docs.select(*COLUMNS), keep=("lang", "source", "n_chars"), keep_text=True), "measures")
    cutoffs = quality_rules.calibrate(measured, table(spark, sf_dir, "labels"))
    return quality_rules.judge(measured, cutoffs).where("kept").withColumnRenamed("id", "doc_id").select(*COLUMNS)


def keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with row, a key of each row that is written beside it."""
    return cut(spark, docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "keyed")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: of the smallest id, that of least hash; and one without an id, if there are such."""
    docs = keyed(spark, docs)
    groups = near_copies.groups(spark, docs)
    place = docs.select("row", "doc_id", F.xxhash64("text", "lang", "source", "n_chars").alias("hash")).join(groups, "row")
    first = place.groupBy("component", F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", "hash", "row")).alias("one"))
    return docs.join(first.select("one.row"), "row", "left_semi").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Each row is judged by its own text, so a digest of the text carries the verdict and no copy with row keys is written."""
    docs = docs.select(*COLUMNS)
    marked = docs.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    found = decontaminate.contaminated(spark, marked, table(spark, sf_dir, "benchmark"), id_col="digest")
    # What was found is written first, so that its size is known when the texts are held against it.
    found = cut(spark, found.select(F.col("id").alias("digest")).distinct(), "contaminated")
    return marked.join(found, "digest", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, placed in sequences."""
    out = packing.pack(spark, docs.select(*COLUMNS))
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The classifier, the calibration and the tokenizer cannot be told in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        with scratch_scope(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        # The stage's rows are whole; what it read is not needed again.
        release(spark, before)
        before = path
    return docs
