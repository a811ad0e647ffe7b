"""Streaming forms, run to the end of what has arrived; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.plans.registry import query
from loomstone.sources.tables import table
from loomstone.streaming import incremental as inc


@query(f"SELECT lang, count(*) AS kept, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE {tx.DUCK_KEEP} GROUP BY lang")
def stream_clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forward pass over the documents as a stream of files, kept rows counted from the sink."""
    sink = inc.scratch(spark, "clean")
    stream = inc.clean_stream(inc.file_stream(spark, f"{sf_dir}/documents.parquet"))
    inc.run_once(stream.select("lang", F.length("text").alias("n")), sink)
    return spark.read.schema("lang string, n int").parquet(sink).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("chars"))


@query()
def stream_duplicate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents the stateful filter keeps; for one batch, what near_dup_kept keeps."""
    folder = inc.scratch(spark, "dedup")
    stream = inc.file_stream(spark, f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return inc.DuplicateFilter(spark, folder).run(stream, f"{folder}/state")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and hour: the throughput table that progress reports are made of."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
