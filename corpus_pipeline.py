"""The corpus pipeline: quality classifier, near-duplicate removal, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import gbdt, mixing, packing, simhash
from loomstone.llm.common import shared_dir

#: SQL can express neither the trees nor the fingerprints; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those the trees, trained on the labelled ones of docs, give less than 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return gbdt.keep_good(docs, gbdt.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one row stays, of the smallest id; rows with repeated or null ids are compared too."""
    return simhash.keep_first(docs, null_ids=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order under the curriculum's weights: sources with more tokens than their share are cut
    where it ends, those with fewer are repeated (up to four passes)."""
    return mixing.mix(docs, positions=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens in the training order of docs' rows: (pack_group, bin, n_tokens, pieces)."""
    return packing.pack_in_order(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
