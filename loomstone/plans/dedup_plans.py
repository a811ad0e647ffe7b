"""Exact and MinHash near-duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import minhash as mh, mixture as mx
from loomstone.operators.prefix import global_running_sum
from loomstone.plans.registry import query
from loomstone.sources.tables import table

_SIGNATURES = (
    """g AS (SELECT DISTINCT doc_id, substr(text, i::BIGINT, 5) AS g FROM (SELECT doc_id, text, unnest(range(1, length(text) - 3)) AS i FROM documents WHERE length(text) >= 5)),
    h AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 7))::BIGINT AS h FROM g),
    s AS (SELECT d.doc_id, """
    + ", ".join(f"coalesce(min(({a}::BIGINT * h + {b}) % {mh.MERSENNE31}), 0) AS h{i}" for i, (a, b) in enumerate(mh.permutations(mh.PERMUTATIONS, mh.MERSENNE31)))
    + " FROM documents d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id)"
)


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text; grouped by a 256-bit digest, so the text itself isn't shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("d"))
    return docs.groupBy("d").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("d")


@query(f"WITH {_SIGNATURES} SELECT * FROM s")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mh.native_signatures(table(spark, sf_dir, "documents"))


@query(
    f"WITH {_SIGNATURES} SELECT doc_id, CAST(b AS INTEGER) AS band, md5(array_to_string(list_slice([{', '.join(f'h{i}' for i in range(64))}], b * 8 + 1, b * 8 + 8), ',')) AS key FROM s, (SELECT unnest(range(8)) AS b)"
)
def lsh_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mh.native_bands(mh.native_signatures(table(spark, sf_dir, "documents")))


@query()
def near_dup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents the greedy first-come filter keeps, with exact BLAKE2b signatures; tests hold it against the loop."""
    return mh.greedy_keep(mh.exact_band_keys(table(spark, sf_dir, "documents")))


@query()
def budgeted_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate filter and source budgets settled together, over all documents in the joint order of turns."""
    docs = table(spark, sf_dir, "documents")
    turned = mx.turns(docs.select("doc_id", "source", F.octet_length("text").alias("n_tok")), ["doc_id"]).withColumn("one", F.lit(1))
    rows = global_running_sum(turned, ["rn", "source"], "one", "ord").select("ord", "doc_id", "source", F.lit(0.05).alias("ratio"), "n_tok")
    bands = mh.exact_band_keys(docs).join(rows.select("ord", "doc_id"), "doc_id").select("ord", "band", "key")
    return mx.unique_within_budget(rows, bands, 1_000_000).select("doc_id", "source", "n_tok")
