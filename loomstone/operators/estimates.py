"""Sizing sources from a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import text as tx


def estimate_sources(docs: DataFrame, sample: int = 200, letters: str | None = tx.HANGUL, tokens: Column | None = None) -> DataFrame:
    """(source, n_docs, seen, kept, toks, est) and a row 'total'. The sample is the first `sample` ids of a source; the
    rank is limited before the costly filter (a group limit, no full sort of a hot source)."""
    keys = Window.partitionBy("source").orderBy("doc_id")
    sampled = docs.select("source", "doc_id", "text").withColumn("rn", F.row_number().over(keys)).where(F.col("rn") <= sample)
    keep = tx.keep_document("text", letters)
    counted = sampled.select("source", keep.alias("keep"), (F.octet_length("text") if tokens is None else tokens).alias("t")).groupBy("source").agg(
        F.count("*").alias("seen"), F.count_if("keep").alias("kept"), F.coalesce(F.sum(F.when(F.col("keep"), F.col("t"))), F.lit(0)).cast("bigint").alias("toks")
    )
    sizes = docs.groupBy("source").agg(F.count("*").alias("n_docs"))
    rate = F.coalesce(F.try_divide(F.col("kept").cast("double"), F.col("seen")), F.lit(0.0))
    per = F.coalesce(F.try_divide(F.col("toks").cast("double"), F.col("kept")), F.lit(0.0))
    each = sizes.join(counted, "source").withColumn("est", F.round(F.col("n_docs") * rate * per).cast("bigint"))
    total = each.agg(F.lit("total").alias("source"), *(F.sum(c).alias(c) for c in ("n_docs", "seen", "kept", "toks", "est")))
    return each.select(total.columns).unionByName(total)
