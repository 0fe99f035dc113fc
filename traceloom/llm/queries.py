"""The driver's queries for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm import decontaminate, html_text, packing, quality_rules, quotations, sharding, simhash_dedup, toxicity, url_filter, warc
from traceloom.llm.shared import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link(spark, table(spark, sf_dir, "conversations"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_id", F.round("coverage", 6).alias("coverage"), "covered_tokens", "kind")


def op4_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out_column().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_composite_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op7_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    return out.select(F.col("id").alias("doc_id"), *names)


def op8_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(spark, table(spark, sf_dir, "documents"), with_ids=False)
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(spark, table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_url_ngram_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_dedup, op2_quotation_linking, op3_template_decontamination, op4_weak_supervision_toxicity, op5_composite_text_density,
        op6_arc_to_warc, op7_risk_controlled_rules, op8_power_of_two_packing, op9_hilbert_sharding, op10_url_ngram_filter,
    )
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op2_quotation_linking": rf"""
        WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
        q AS (SELECT *, regexp_matches(text, '(?m){quotations.MARKS}') AS quoted FROM m),
        l AS (SELECT id, conv_id, turn, regexp_split_to_array(text, '\r?\n') AS ls FROM q WHERE quoted),
        u AS (SELECT id, conv_id, turn, unnest(ls) AS raw, unnest(range(len(ls))) AS n FROM l),
        p AS (SELECT *, length(regexp_replace(regexp_extract(raw, '{quotations.MARKS}', 1), '[^>]', '', 'g')) AS level, regexp_replace(raw, '{quotations.MARKS}', '') AS line FROM u),
        r AS (SELECT *, lead(level, 1, 0) OVER (PARTITION BY id ORDER BY n) AS after, n - row_number() OVER (PARTITION BY id, level ORDER BY n) AS island FROM p),
        own AS (SELECT id, string_agg(line, chr(10) ORDER BY n) AS body FROM r WHERE level = 0 AND NOT (after > 0 AND regexp_matches(line, '{quotations.ATTRIBUTION}')) GROUP BY id),
        b AS (SELECT q.id, conv_id, turn, role, regexp_replace(CASE WHEN quoted THEN coalesce(body, '') ELSE text END, '^\s+|\s+$', '', 'g') AS body FROM q LEFT JOIN own USING (id)),
        ps AS (SELECT id, conv_id, turn, level, trim(regexp_replace(lower(string_agg(line, chr(10) ORDER BY n)), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS t FROM r WHERE level > 0 GROUP BY id, conv_id, turn, level, island),
        asked AS (SELECT DISTINCT conv_id, turn, level, t FROM ps WHERE t <> ''),
        parts AS (SELECT conv_id, turn, unnest([body] || regexp_split_to_array(body, '\n\s*\n') || string_split(body, chr(10))) AS x FROM b WHERE turn IS NOT NULL),
        told AS (SELECT conv_id, t, min(turn) AS origin FROM (SELECT conv_id, turn, trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS t FROM parts) WHERE t <> '' GROUP BY conv_id, t),
        f AS (SELECT a.conv_id, a.turn, coalesce(max(origin) FILTER (level = 1), max(origin)) AS parent, count(*) AS n FROM asked a JOIN told o ON a.conv_id IS NOT DISTINCT FROM o.conv_id AND a.t = o.t AND o.origin < a.turn GROUP BY a.conv_id, a.turn),
        chain AS (SELECT conv_id, turn, parent AS root FROM f UNION ALL SELECT c.conv_id, c.turn, f.parent FROM chain c JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.turn = c.root),
        roots AS (SELECT conv_id, turn, min(root) AS root FROM chain GROUP BY conv_id, turn),
        k AS (SELECT id, count(*) AS n_quotes, max(level) AS max_level FROM ps WHERE t <> '' GROUP BY id),
        o AS (SELECT b.conv_id, b.turn, b.role, b.body AS text, CAST(coalesce(k.n_quotes, 0) AS INT) AS n_quotes, coalesce(f.n, 0) AS n_linked, CAST(coalesce(k.max_level, 0) AS INT) AS max_level,
                     f.parent AS parent_turn, coalesce(roots.root, b.turn) AS thread_turn
              FROM b LEFT JOIN k USING (id) LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.turn = b.turn LEFT JOIN roots ON roots.conv_id IS NOT DISTINCT FROM b.conv_id AND roots.turn = b.turn)
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text) - 1 AS reply_order FROM o
    """,
    "op6_arc_to_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS holder FROM p
        ), g AS (
            SELECT *, payload_bytes >= 100 AND holder < page_id AS again FROM f
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN holder END AS refers_to
        FROM g
    """,
}
