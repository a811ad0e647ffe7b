"""Hashed word features, the linear quality model, and reports on scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.functions.hashing import duck_fnv1a
from loomstone.operators import linear_quality as lq
from loomstone.plans.registry import query
from loomstone.sources.tables import table

THRESHOLDS = tuple(tenths / 10 for tenths in (3, 5, 7, 8, 9))
_TERMS = f"""w AS (SELECT doc_id, {tx.DUCK_WORDS} AS w FROM documents),
    t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], chr(0), w[i + 1])))) AS term FROM w),
    h AS (SELECT term, {duck_fnv1a('term')} AS idx FROM (SELECT DISTINCT term FROM t)),
    c AS (SELECT doc_id, idx, CAST(count(*) AS BIGINT) AS n FROM t JOIN h USING (term) GROUP BY doc_id, idx)"""
_SCORED = f"s AS (SELECT d.doc_id, l.quality, round({tx.DUCK_LATIN} * (1.0::DOUBLE - {tx.DUCK_REPETITION}), 9) AS score FROM documents d JOIN labels l USING (doc_id))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a plain stand-in score (script share times non-repetition)."""
    score = tx.script_ratio("text", tx.LATIN) * (F.lit(1.0) - tx.gram_repetition("text"))
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", F.round(score, 9).alias("score"))


@query(f"WITH {_TERMS} SELECT idx, CAST(sum(n) AS BIGINT) AS n FROM c WHERE true GROUP BY idx")
def fnv_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lq.bucket_totals(table(spark, sf_dir, "documents"))


@query(f"WITH {_TERMS} SELECT doc_id, count(*) AS n_features, CAST(sum(n) AS BIGINT) AS terms, round(sqrt(sum(n)::DOUBLE), 6) AS norm FROM c GROUP BY doc_id")
def word_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets, terms and norm (of the square-root counts) of every document."""
    sizes = lq.feature_sizes(table(spark, sf_dir, "documents"))
    return sizes.groupBy("doc_id").agg(
        F.sum("n_features").alias("n_features"), F.sum("terms").alias("terms"), F.round(F.sqrt(F.sum("terms").cast("double")), 6).alias("norm")
    )


@query()
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score) of all documents under the linear model trained on labelled ones by sequential SGD."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, bias = lq.train(docs, table(spark, sf_dir, "labels"))
    return lq.score_texts(docs, weights, bias)


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query(f"WITH {_SCORED} SELECT th, round(avg(CASE WHEN score >= th THEN 1.0 ELSE 0.0 END), 9) AS pass_rate FROM s, (SELECT unnest({list(THRESHOLDS)}::DOUBLE[]) AS th) GROUP BY th")
def threshold_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = _scored(spark, sf_dir).withColumn("th", F.explode(F.array(*map(F.lit, THRESHOLDS))))
    return rates.groupBy("th").agg(F.round(F.avg((F.col("score") >= F.col("th")).cast("double")), 9).alias("pass_rate"))


@query(f"WITH {_SCORED} SELECT quality, round(quantile_cont(score, 0.5), 9) AS median, count(*) AS n FROM s GROUP BY quality")
def score_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("quality").agg(F.round(F.percentile("score", 0.5), 9).alias("median"), F.count("*").alias("n"))


@query(f"WITH {_SCORED} SELECT round(avg(CASE WHEN (score > 0.5) = (quality = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(avg(-ln(greatest(CASE WHEN quality = 1 THEN score ELSE 1 - score END, 1e-9))), 9) AS log_loss FROM s")
def balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.greatest(F.when(F.col("quality") == 1, F.col("score")).otherwise(1 - F.col("score")), F.lit(1e-9))
    hit = ((F.col("score") > 0.5) == (F.col("quality") == 1)).cast("double")
    return _scored(spark, sf_dir).agg(F.round(F.avg(hit), 9).alias("accuracy"), F.round(F.avg(-F.log(p)), 9).alias("log_loss"))


@query(f"WITH {_SCORED}, b AS (SELECT 'bottom' AS side, doc_id, score FROM s ORDER BY score, doc_id LIMIT 2), t AS (SELECT 'top' AS side, doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 2) SELECT * FROM b UNION ALL SELECT * FROM t")
def extreme_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).select("doc_id", "score")
    low = s.orderBy("score", "doc_id").limit(2).select(F.lit("bottom").alias("side"), "doc_id", "score")
    return low.unionByName(s.orderBy(F.desc("score"), "doc_id").limit(2).select(F.lit("top").alias("side"), "doc_id", "score"))
