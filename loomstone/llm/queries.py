"""One query for each training-data operator, over its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import chat, gbdt, hmm, hnsw, media, mixing, packing, sharding, simhash, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, sha256, chunks, restored) with the whole texts as payloads."""
    return media.deduplicate(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, keep) for all documents."""
    docs = _table(spark, sf_dir, "documents")
    forest = gbdt.train(docs, _table(spark, sf_dir, "labels"))
    return gbdt.score(docs, forest).withColumn("keep", F.col("score") >= 0.5)


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, group_id, keep) for all documents with a text: the near-duplicate group and whether this one stays."""
    groups = simhash.duplicates(_table(spark, sf_dir, "documents"))
    return groups.withColumn("keep", F.col("doc_id") == F.col("group_id"))


def op3_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, n_turns, n_tokens, n_trained, input_ids, loss_mask) for all conversations."""
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op4_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, position) in training order, for a run as long as the corpus."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.token_estimate().alias("n"))
    mixed = mixing.mix(docs, n_tokens=F.col("n"))
    return mixed.select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_position").alias("position"))


def op6_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, neighbours) for the vectors whose id is divisible by 20, of all vectors."""
    return hnsw.neighbours(_table(spark, sf_dir, "embeddings"), asked=F.col("vec_id") % 20 == 0)


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack_group, bin, n_tokens, pieces) for sequences of 4096 tokens of all documents."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents; (doc_id, part, part_row, n_tokens, start, stop, file) tells where they are."""
    return tokens.write_tokens(_table(spark, sf_dir, "documents"))


SHARDS, GROWN = 64, 80


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their shard of 64, each shard one partition, and the shard they have if 16 are appended."""
    docs = _table(spark, sf_dir, "documents")
    both = sharding.assign(docs, "doc_id", [SHARDS, GROWN], ["shard", "shard_grown"])
    return both.repartitionById(SHARDS, F.col("shard"))


def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, log_likelihood, per_word, perplexity) for all documents, under the model of all documents."""
    return hmm.score_documents(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_media_chunks, op2_quality_classifier, op3_chat_masks, op4_curriculum_mixing, op5_simhash_dedup,
        op6_hnsw_neighbours, op7_sum_of_squares_packing, op8_token_files, op9_jump_sharding, op10_hmm_scores,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_curriculum_mixing": mixing.duck_sql(),
        "op9_jump_sharding": sharding.duck_sql(["doc_id", "text", "lang", "source", "n_chars"], SHARDS, GROWN),
    }
