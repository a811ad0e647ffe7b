"""Pretokens, pair counts and BPE over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import bpe as bp
from loomstone.plans.registry import query
from loomstone.sources.tables import table

_PAIRS = """w AS (SELECT word, count(*) AS n, hex(encode(word)) AS x FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word),
    p AS (SELECT n, ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::INTEGER AS a, ('0x' || substr(x, (2 * i + 3)::BIGINT, 2))::INTEGER AS b
        FROM (SELECT n, x, unnest(range(0, length(x) // 2 - 1)) AS i FROM w)),
    c AS (SELECT a, b, CAST(sum(n) AS BIGINT) AS cnt FROM p GROUP BY a, b)"""


def _word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("cnt"))


@query()
def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pretokens; no SQL, as the oracle's regular expressions have no lookahead (tests compare with Python)."""
    return bp.pretoken_counts(table(spark, sf_dir, "documents"))


@query("SELECT word AS chunk, count(*) AS cnt FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _word_counts(spark, sf_dir)


@query(f"WITH {_PAIRS} SELECT a, b, cnt FROM c")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bp.pair_counts(_word_counts(spark, sf_dir))


@query(f"WITH {_PAIRS} SELECT a, b, cnt FROM c ORDER BY cnt DESC, a, b LIMIT 1")
def best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bp.pair_counts(_word_counts(spark, sf_dir)).orderBy(F.desc("cnt"), "a", "b").limit(1)


@query(f"WITH {_PAIRS} SELECT a, b, CAST(count(DISTINCT word) AS BIGINT) AS words FROM (SELECT word, ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::INTEGER AS a, ('0x' || substr(x, (2 * i + 3)::BIGINT, 2))::INTEGER AS b FROM (SELECT word, x, unnest(range(0, length(x) // 2 - 1)) AS i FROM w)) GROUP BY a, b")
def pair_index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct words hold each byte pair: the inverted index, counted."""
    return bp.pair_index(_word_counts(spark, sf_dir))


@query("SELECT doc_id, text FROM documents")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns a small vocabulary, encodes all documents and decodes the ids by table lookup: the texts come back."""
    docs = table(spark, sf_dir, "documents")
    model = bp.train(docs, 1024)
    return bp.decode_documents(bp.encode_documents(docs, model, eos=False), model)


@query()
def bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and characters per token of each source under the learned vocabulary."""
    docs = table(spark, sf_dir, "documents")
    ids = bp.encode_documents(docs, bp.train(docs, 1024)).select("doc_id", F.size("ids").alias("n"))
    return ids.join(docs.select("doc_id", "source", F.length("text").alias("c")), "doc_id").groupBy("source").agg(
        F.sum("n").alias("tokens"), (F.sum("c") / F.sum("n")).alias("chars_per_token")
    )
