"""Packing documents into shards and drawing training windows; byte counts and word lengths stand in for token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import shards as sh
from loomstone.operators.prefix import global_running_sum
from loomstone.plans.registry import query
from loomstone.sources.tables import table

SHARD, CHUNK, SEQ, STEPS, BATCH = 50_000, 1000, 64, 8, 8
_OFFSETS = "o AS (SELECT doc_id, strlen(text) + 1 AS n_tok, CAST(coalesce(sum(strlen(text) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM documents)"


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length("text") + 1).cast("bigint").alias("n_tok"))
    return global_running_sum(docs, ["doc_id"], "n_tok", "start")


@query(f"WITH {_OFFSETS} SELECT doc_id, CAST(n_tok AS BIGINT) AS n_tok, start, start // {SHARD} AS shard_idx, start % {SHARD} AS shard_off FROM o")
def pack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _offsets(spark, sf_dir)
    return docs.select("doc_id", "n_tok", "start", F.expr(f"start div {SHARD}").alias("shard_idx"), F.expr(f"start % {SHARD}").alias("shard_off"))


_PIECES = f"""p AS (SELECT doc_id, s AS shard_idx, greatest(start, s * {SHARD}) - s * {SHARD} AS shard_off, greatest(start, s * {SHARD}) - start AS doc_off,
    least(start + n_tok, (s + 1) * {SHARD}) - greatest(start, s * {SHARD}) AS length FROM (SELECT *, unnest(range(start // {SHARD}, (start + n_tok - 1) // {SHARD} + 1)) AS s FROM o))"""


@query(f"WITH {_OFFSETS}, {_PIECES} SELECT doc_id, shard_idx, shard_off, doc_off, CAST(length AS BIGINT) AS length FROM p")
def shard_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sh.pieces(_offsets(spark, sf_dir), SHARD).select("doc_id", "shard_idx", "shard_off", "doc_off", "length")


@query(f"WITH {_OFFSETS}, {_PIECES} SELECT concat('train_', lpad(shard_idx::VARCHAR, 6, '0'), '.bin') AS file, CAST(sum(length) AS BIGINT) AS n, count(*) AS pieces FROM p GROUP BY shard_idx")
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = sh.pieces(_offsets(spark, sf_dir), SHARD).groupBy("shard_idx").agg(F.sum("length").alias("n"), F.count("*").alias("pieces"))
    return parts.select(sh.uint16_file_names(F.lit("train"), F.col("shard_idx")).alias("file"), "n", "pieces")


@query(
    """WITH w AS (SELECT doc_id, pos, length(word) AS tok FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents))
    SELECT doc_id, CAST(count(*) AS BIGINT) AS n_pairs, CAST(sum(tok * next) AS BIGINT) AS dot FROM (SELECT *, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM w) WHERE next IS NOT NULL GROUP BY doc_id"""
)
def next_token_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs and next-token targets of each document by slicing; summarised by their dot product."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", " "), F.length).alias("t")).where(F.size("t") > 1)
    xy = docs.select("doc_id", F.expr("slice(t, 1, size(t) - 1)").alias("x"), F.expr("slice(t, 2, size(t) - 1)").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: (a * b).cast("bigint")), F.lit(0).cast("bigint"), lambda s, e: s + e)
    return xy.select("doc_id", F.size("x").cast("bigint").alias("n_pairs"), dot.alias("dot"))


_STREAM = """w AS (SELECT CAST(length(word) AS INTEGER) AS tok, row_number() OVER (ORDER BY doc_id, pos) - 1 AS off
    FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents))"""


@query(
    f"""WITH {_STREAM}, t AS (SELECT count(*) AS total FROM w),
    s AS (SELECT step, row, (('0x' || substr(md5(concat_ws(':', '42', step, row)), 1, 12))::BIGINT) % (total - {SEQ} - 1) AS start
        FROM (SELECT unnest(range({STEPS})) AS step), (SELECT unnest(range({BATCH})) AS row), t)
    SELECT CAST(step AS INTEGER) AS step, CAST(row AS INTEGER) AS row, start, list(tok ORDER BY off) FILTER (off < start + {SEQ}) AS x, list(tok ORDER BY off) FILTER (off > start) AS y
    FROM s JOIN w ON w.off BETWEEN s.start AND s.start + {SEQ} GROUP BY step, row, start"""
)
def window_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random training windows over the global stream: chunks of 1000 tokens, windows that may cross them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", " "), F.length).alias("t"))
    stream = global_running_sum(docs.withColumn("n_tok", F.size("t").cast("bigint")), ["doc_id"], "n_tok", "start")
    cut = sh.pieces(stream, CHUNK).withColumn("tok", F.expr("slice(t, CAST(doc_off + 1 AS INT), CAST(length AS INT))"))
    chunks = sh.chunked(cut, ["shard_idx"]).withColumnRenamed("shard_idx", "chunk_idx")
    total = docs.agg(F.sum(F.size("t"))).first()[0]
    return sh.gather(sh.window_starts(spark, 42, STEPS, BATCH, total, SEQ), chunks, CHUNK, SEQ)
