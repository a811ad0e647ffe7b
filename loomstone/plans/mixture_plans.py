"""Mixing, sampling, splitting and set operations over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.functions.hashing import seeded_order
from loomstone.operators import mixture as mx
from loomstone.operators.prefix import global_running_sum
from loomstone.plans.registry import query
from loomstone.sources.tables import table

TARGET, VAL = 400_000, 0.005
SOURCES = [mx.Source(f"src{i}", r, t, k, False, k == 1, ins) for i, (r, t, k, ins) in enumerate(
    [(0.33, None, 3, False), (0.15, None, 2, False), (0.15, 0.9, 2, False), (0.23, 0.9, 1, False), (0.10, None, 1, False), (0.04, None, 4, True)]
)]
_MIX = "(VALUES " + ", ".join(
    f"('src{i}', {i}, {s.ratio!r}::DOUBLE, {'NULL' if s.threshold is None else s.threshold}::DOUBLE, {s.repeat}, {s.instruction})" for i, s in enumerate(SOURCES)
) + ") mix(source, source_idx, ratio, threshold, repeat, instruction)"
_SCORE = "(1.0::DOUBLE - " + tx.DUCK_REPETITION + ")"


@query("SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS rn FROM documents")
def round_robin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.turns(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"])


_REPEATED = f"SELECT d.*, mix.* EXCLUDE (source), p.pass_idx FROM documents d JOIN {_MIX} USING (source) JOIN (SELECT unnest(range(10)) AS pass_idx) p ON p.pass_idx < mix.repeat"


@query(f"SELECT doc_id, source, CAST(pass_idx AS INTEGER) AS pass_idx FROM ({_REPEATED})")
def repeat_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mx.repeated(table(spark, sf_dir, "documents").select("doc_id", "source"), mx.mix_table(spark, SOURCES))
    return docs.select("doc_id", "source", "pass_idx")


_MIXED = f"""turned AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pass_idx, doc_id) AS rn, strlen(text) + 1 AS n_tok,
        (instruction OR ({tx.DUCK_KEEP} AND (threshold IS NULL OR {_SCORE} >= threshold))) AS ok FROM ({_REPEATED})),
    spent AS (SELECT *, coalesce(sum(n_tok) OVER (PARTITION BY source ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM turned WHERE ok),
    kept AS (SELECT * FROM spent WHERE spent < floor({TARGET} * ratio)),
    placed AS (SELECT *, CAST(coalesce(sum(n_tok) OVER (ORDER BY rn, source_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM kept)"""


@query(f"WITH {_MIXED} SELECT doc_id, source, CAST(rn AS INTEGER) AS rn, CAST(n_tok AS INTEGER) AS n_tok, CAST(spent AS BIGINT) AS spent FROM kept")
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered documents of each source up to its token budget (byte-level tokens and an end token)."""
    return _budgeted(spark, sf_dir).select("doc_id", "source", "rn", "n_tok", "spent")


@query(f"WITH {_MIXED} SELECT doc_id, source, before, CASE WHEN before < {TARGET * VAL}::DOUBLE THEN 'val' ELSE 'train' END AS split FROM placed")
def val_prefix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole mixing plan: turns, filters, budgets, joint order, running offset and validation prefix."""
    return mx.validation_prefix(_budgeted(spark, sf_dir), TARGET, VAL, ["rn", "source_idx"]).select("doc_id", "source", "before", "split")


@query(
    f"""WITH {_MIXED}, split AS (SELECT *, CASE WHEN before < {TARGET * VAL}::DOUBLE THEN 'val' ELSE 'train' END AS split FROM placed)
    SELECT source, split, CAST(sum(n_tok) AS BIGINT) AS got, count(*) AS kept FROM split GROUP BY source, split"""
)
def split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mx.validation_prefix(_budgeted(spark, sf_dir), TARGET, VAL, ["rn", "source_idx"])
    return docs.groupBy("source", "split").agg(F.sum("n_tok").alias("got"), F.count("*").alias("kept"))


@query(
    f"""WITH {_MIXED} SELECT t.source, count(*) AS seen, count(*) FILTER (NOT ok) AS filtered, count(k.rn) AS kept
    FROM turned t LEFT JOIN (SELECT source, rn FROM kept) k ON t.source = k.source AND t.rn = k.rn GROUP BY t.source"""
)
def source_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows seen, filtered and kept by source."""
    turned = _turned(spark, sf_dir)
    kept = mx.within_budget(turned.where("ok"), TARGET, ["rn"]).groupBy("source").agg(F.count("*").alias("kept"))
    seen = turned.groupBy("source").agg(F.count("*").alias("seen"), F.count_if(~F.col("ok")).alias("filtered"))
    return seen.join(kept, "source", "left").select("source", "seen", "filtered", F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"))


def _turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mx.repeated(table(spark, sf_dir, "documents"), mx.mix_table(spark, SOURCES))
    ok = mx.passes_quality(tx.keep_document("text", tx.LATIN), F.lit(1.0) - tx.gram_repetition("text"))
    narrow = docs.select("doc_id", "source", "source_idx", "ratio", "pass_idx", (F.octet_length("text") + 1).alias("n_tok"), ok.alias("ok"))
    return mx.turns(narrow, ["pass_idx", "doc_id"])


def _budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.within_budget(_turned(spark, sf_dir).where("ok"), TARGET, ["rn"])


@query(
    """SELECT doc_id, source FROM (SELECT *, coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 20000"""
)
def byte_budget_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("n"))
    return mx.byte_budget(docs, 20_000, ["doc_id"], F.col("n")).select("doc_id", "source")


@query("SELECT doc_id FROM (SELECT doc_id, text FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 300 OFFSET 50) WHERE length(text) > 300 ORDER BY doc_id LIMIT 100)")
def skip_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip, limit, filter, limit: how samples for a classifier are drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"))
    return docs.orderBy("doc_id").offset(50).limit(300).where("n > 300").orderBy("doc_id").limit(100).select("doc_id")


@query(
    """WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) AS rn, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CAST(rn AS INTEGER) AS rn, CASE WHEN rn <= greatest(64, n // 100) THEN 'val' ELSE 'train' END AS split FROM s"""
)
def shuffled_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded full shuffle, then the first max(64, n // 100) rows are held out. The rank is a global running sum."""
    docs = table(spark, sf_dir, "documents").select("doc_id", seeded_order("42", "doc_id").alias("h"), F.lit(1).alias("one"))
    ranked = global_running_sum(docs, ["h", "doc_id"], "one", "rn", inclusive=True)
    n = docs.agg(F.count("*").alias("n"))
    held = F.greatest(F.lit(64), F.expr("n div 100"))
    return ranked.crossJoin(F.broadcast(n)).select("doc_id", F.col("rn").cast("int").alias("rn"), F.when(F.col("rn") <= held, "val").otherwise("train").alias("split"))


@query(
    """SELECT CAST(epoch AS INTEGER) AS epoch, doc_id, CAST(row_number() OVER (PARTITION BY epoch ORDER BY md5(concat(epoch, ':', doc_id)), doc_id) AS INTEGER) AS pos
    FROM labels, (SELECT unnest(range(3)) AS epoch)"""
)
def epoch_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded permutation of the labelled rows for each epoch."""
    rows = table(spark, sf_dir, "labels").select("doc_id").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(2))))
    key = F.md5(F.concat(F.col("epoch").cast("string"), F.lit(":"), F.col("doc_id").cast("string")))
    numbered = global_running_sum(rows.withColumn("h", key).withColumn("one", F.lit(1)), ["h", "doc_id"], "one", "pos", inclusive=True, keys=["epoch"])
    return numbered.select("epoch", "doc_id", F.col("pos").cast("int").alias("pos"))


@query("SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark UNION ALL SELECT 'turn', conv_id, text FROM conversations")
def sequential_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda name, kind, key: table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "text")
    return part("documents", "doc", "doc_id").unionByName(part("benchmark", "item", "item_id")).unionByName(part("conversations", "turn", "conv_id"))


@query("SELECT source, lang FROM documents EXCEPT SELECT source, lang FROM documents WHERE length(text) < 200")
def pairs_without_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("source", "lang").subtract(docs.where(F.length("text") < 200).select("source", "lang"))
