"""Vector functions over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.operators import vectors as vx
from loomstone.plans.registry import query
from loomstone.sources.tables import table

_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_SOFT = "s AS (SELECT vec_id, label, list_transform(v, lambda x: exp(x - list_max(v))) AS e, v FROM v), p AS (SELECT vec_id, label, v, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def _round(v, n: int = 6):
    return F.transform(v, lambda x: F.round(x, n) + F.lit(0.0))


@query(f"WITH {_V}, {_SOFT} SELECT vec_id, list_transform(p, lambda x: round(x, 6)) AS p FROM p")
def softmax_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", _round(vx.softmax(F.col("v"))).alias("p"))


@query(f"WITH {_V}, {_SOFT} SELECT vec_id, round(-ln(p[label + 1]), 6) AS loss FROM p")
def vector_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of each vector as logits with the label as target."""
    return _vectors(spark, sf_dir).select("vec_id", F.round(vx.cross_entropy(F.col("v"), F.col("label")), 6).alias("loss"))


@query(f"WITH {_V} SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y)) / len(v) + 1e-5), 6) + 0.0) AS v FROM v")
def rmsnorm_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", _round(vx.rms_norm(F.col("v"))).alias("v"))


@query(
    f"""WITH {_V} SELECT vec_id, list_transform(range(0, len(v)), lambda i: round(v[i + 1] * cos((vec_id % 128) * pow(10000.0::DOUBLE, -(2.0::DOUBLE * (i // 2)) / len(v)))
    + (CASE WHEN i % 2 = 0 THEN -v[i + 2] ELSE v[i] END) * sin((vec_id % 128) * pow(10000.0::DOUBLE, -(2.0::DOUBLE * (i // 2)) / len(v))), 6) + 0.0) AS v FROM v"""
)
def rope_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", _round(vx.rotate_pairs(F.col("v"), F.col("vec_id") % 128)).alias("v"))


@query(f"WITH {_V} SELECT vec_id, list_transform(range(1, 33), lambda i: round(v[i] / (1.0::DOUBLE + exp(-v[i])) * v[i + 32], 6) + 0.0) AS g FROM v")
def swiglu_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", _round(vx.swish_gate(F.slice("v", 1, 32), F.slice("v", 33, 32))).alias("g"))


_RANKED = f"""{_V}, {_SOFT}, x AS (SELECT vec_id, CAST(unnest(range(0, len(p))) AS INTEGER) AS tok, unnest(p) AS p FROM p),
    r AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, tok ROWS UNBOUNDED PRECEDING) AS cum FROM x)"""


def _cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode(vx.softmax(F.col("v"))).alias("tok", "p"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("p"), "tok").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cum", F.sum("p").over(w))


@query(f"WITH {_RANKED} SELECT vec_id, count(*) AS kept, min(tok) AS low FROM r WHERE cum - p <= 0.9 GROUP BY vec_id")
def nucleus_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in the nucleus of mass 0.9; the first always stays."""
    return _cumulative(spark, sf_dir).where("cum - p <= 0.9D").groupBy("vec_id").agg(F.count("*").alias("kept"), F.min("tok").alias("low"))


@query(f"WITH {_RANKED} SELECT vec_id, CAST(arg_min(tok, cum) AS INTEGER) AS drawn FROM (SELECT *, (('0x' || substr(md5(vec_id::VARCHAR), 1, 7))::BIGINT / 268435456.0) AS u FROM r) WHERE cum >= u GROUP BY vec_id")
def inverse_cdf_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token for each vector: the first, by falling probability, whose cumulative mass reaches a hashed uniform."""
    u = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 7), 16, 10).cast("bigint") / F.lit(268435456.0)
    return _cumulative(spark, sf_dir).where(F.col("cum") >= u).groupBy("vec_id").agg(F.min_by("tok", "cum").alias("drawn"))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings")
def greedy_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int").alias("best"))


@query(
    """WITH w AS (SELECT doc_id, unnest(list_slice(string_split(text, ' '), 1, 8)) AS word, generate_subscripts(list_slice(string_split(text, ' '), 1, 8), 1) AS pos FROM documents)
    SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, round(embedding[1]::DOUBLE, 6) AS first FROM w JOIN embeddings ON vec_id = length(word)""".replace("list_slice(string_split(text, ' '), 1, 8)", "string_split(text, ' ')")
)
def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's vector by id (its length here); only the column asked for is read."""
    docs = table(spark, sf_dir, "documents")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))
    return _looked_up(docs, rows)


def _looked_up(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Words have few lengths, so a join that shuffles them by length puts most in a few tasks: the rows of lengths that
    occur are broadcast instead, and words stay where they are."""
    asked = docs.select(F.explode(F.array_distinct(F.transform(F.split("text", " "), F.length))).alias("n")).distinct()
    held = F.broadcast(rows.join(asked, F.col("vec_id") == F.col("n"), "left_semi"))
    words = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    return words.join(held, F.length("word") == F.col("vec_id")).select("doc_id", "pos", "first")


@query(
    f"""WITH {_V}, q AS (SELECT a.vec_id, b.vec_id AS k, list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) / 8.0 AS s, b.v[1] AS y
    FROM v a JOIN v b ON a.vec_id // 32 = b.vec_id // 32 AND b.vec_id <= a.vec_id)
    SELECT vec_id, count(*) AS keys, round(sum(exp(s) * y) / sum(exp(s)), 6) + 0.0 AS first FROM q GROUP BY vec_id"""
)
def causal_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention of each vector over those before it in its block of 32 (the first component of the result)."""
    v = _vectors(spark, sf_dir).withColumn("block", F.expr("vec_id div 32"))
    a, b = v.select("block", "vec_id", "v"), v.select("block", F.col("vec_id").alias("k"), F.col("v").alias("kv"))
    pairs = a.join(b, "block").where("k <= vec_id").select("vec_id", (vx.dot(F.col("v"), F.col("kv")) / 8.0).alias("s"), F.col("kv")[0].alias("y"))
    return pairs.groupBy("vec_id").agg(F.count("*").alias("keys"), (F.round(F.sum(F.exp("s") * F.col("y")) / F.sum(F.exp("s")), 6) + F.lit(0.0)).alias("first"))
