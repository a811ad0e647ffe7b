"""Cleaning filters, text measures and report aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.plans.registry import query
from loomstone.sources.tables import table


@query(
    f"""SELECT lang, source, count(*) AS n_seen, count(*) FILTER (keep) AS n_kept,
    CAST(coalesce(sum(length(text)) FILTER (keep), 0) AS BIGINT) AS kept_chars
    FROM (SELECT *, {tx.DUCK_KEEP} AS keep FROM documents) GROUP BY lang, source"""
)
def clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents seen and kept by language and source; one scan, one partial and final aggregation."""
    docs = table(spark, sf_dir, "documents").withColumn("keep", tx.keep_document("text", tx.LATIN))
    return docs.groupBy("lang", "source").agg(
        F.count("*").alias("n_seen"),
        F.count_if("keep").alias("n_kept"),
        F.coalesce(F.sum(F.when(F.col("keep"), F.length("text"))), F.lit(0)).cast("bigint").alias("kept_chars"),
    )


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents WHERE length(text) >= 200")
def min_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).where("n >= 200")


@query(f"SELECT doc_id, round({tx.DUCK_LATIN}, 9) AS ratio FROM documents")
def script_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(tx.script_ratio("text", tx.LATIN), 9).alias("ratio"))


@query(f"SELECT doc_id, round({tx.DUCK_REPETITION}, 9) AS ratio FROM documents")
def repetition_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(tx.gram_repetition("text"), 9).alias("ratio"))


@query(f"SELECT doc_id FROM documents WHERE {tx.DUCK_KEEP}")
def kept_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(tx.keep_document("text", tx.LATIN)).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE text IS NOT NULL AND text <> '' AND length(text) > 300")
def training_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL AND text <> '' AND length(text) > 300").select("doc_id", "lang")


@query(
    f"""SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(strlen(text) AS INTEGER) AS bytes,
    CAST(length(text) - length({tx.DUCK_SOLID}) AS INTEGER) AS spaces, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS INTEGER) AS digits,
    md5(trim(text)) AS trimmed, md5(replace(text, 'the', '<end>')) AS marked FROM documents"""
)
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points, UTF-8 bytes, white space, digits, trimming and replacement."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"),
        F.regexp_count("text", F.lit(rf"(?U)[{tx.SPACE}]")).alias("spaces"), F.regexp_count("text", F.lit("[0-9]")).alias("digits"),
        F.md5(F.trim("text")).alias("trimmed"), F.md5(F.replace("text", F.lit("the"), F.lit("<end>"))).alias("marked"),
    )


@query(f"SELECT doc_id, CAST(len({tx.DUCK_WORDS}) AS INTEGER) AS n_words, {tx.DUCK_WORDS}[1] AS first_word FROM documents")
def word_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.words("text").alias("w"))
    return docs.select("doc_id", F.size("w").alias("n_words"), F.get("w", F.lit(0)).alias("first_word"))


@query(
    """SELECT doc_id, CAST(CASE WHEN length(text) < 5 THEN 0 ELSE len(list_distinct(list_transform(range(1, length(text) - 3),
    lambda i: substr(text, i::BIGINT, 5)))) END AS INTEGER) AS n_shingles FROM documents"""
)
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.shingles("text")).alias("n_shingles"))


@query(
    """SELECT source, CAST(count(*) AS BIGINT) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
    round(sum(length(text))::DOUBLE / sum(strlen(text))::DOUBLE, 9) AS chars_per_byte FROM documents GROUP BY ROLLUP (source)"""
)
def compression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters per byte-level token by source, with the grand total as the row of the null source."""
    docs = table(spark, sf_dir, "documents").rollup("source").agg(
        F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes")
    )
    return docs.withColumn("chars_per_byte", F.round(F.col("chars").cast("double") / F.col("bytes").cast("double"), 9))


@query(
    f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
    per AS (SELECT source, count(*) AS n_docs, count(*) FILTER (rn <= 200) AS seen, count(*) FILTER (rn <= 200 AND {tx.DUCK_KEEP}) AS kept,
        CAST(coalesce(sum(strlen(text)) FILTER (rn <= 200 AND {tx.DUCK_KEEP}), 0) AS BIGINT) AS toks FROM ranked GROUP BY source),
    est AS (SELECT source, n_docs, seen, kept, toks, n_docs * (CASE WHEN seen > 0 THEN kept::DOUBLE / seen ELSE 0 END) * (CASE WHEN kept > 0 THEN toks::DOUBLE / kept ELSE 0 END) AS est FROM per)
    SELECT source, n_docs, seen, kept, toks, CAST(round(est) AS BIGINT) AS est FROM est
    UNION ALL SELECT 'total', CAST(sum(n_docs) AS BIGINT), CAST(sum(seen) AS BIGINT), CAST(sum(kept) AS BIGINT), CAST(sum(toks) AS BIGINT), CAST(sum(CAST(round(est) AS BIGINT)) AS BIGINT) FROM est"""
)
def source_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens available by source, estimated from the first 200 documents of each: rows x pass rate x tokens per kept row."""
    from loomstone.operators.estimates import estimate_sources

    return estimate_sources(table(spark, sf_dir, "documents"), sample=200, letters=tx.LATIN)
