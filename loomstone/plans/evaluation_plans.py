"""Evaluation aggregates; line items stand in for tokens, orders for items, clerks' priorities for labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import evaluation as ev
from loomstone.plans.registry import query
from loomstone.sources.tables import table


@query("SELECT round(avg(m), 9) AS mean_loss, round(exp(avg(m)), 9) AS ppl FROM (SELECT avg(CAST(l_discount * 100 AS INTEGER)) AS m FROM lineitem GROUP BY l_orderkey)")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    losses = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_discount") * 100).cast("int").alias("loss"))
    return ev.perplexity(losses, "l_orderkey", "loss").select(F.round("mean_loss", 9).alias("mean_loss"), F.round("ppl", 9).alias("ppl"))


@query(
    """SELECT l_linestatus, round(coalesce(sum(CAST(round(l_quantity) AS BIGINT)) FILTER (l_returnflag <> 'A'), 0)::DOUBLE / greatest(count(*) FILTER (l_returnflag <> 'A'), 1), 9) AS loss
    FROM lineitem GROUP BY l_linestatus"""
)
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.when(F.col("l_returnflag") == "A", -100).otherwise(1)
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(ev.masked_mean(F.round("l_quantity").cast("bigint"), target), 9).alias("loss"))


_CHOICES = """s AS (SELECT l_orderkey AS item, CAST(l_suppkey % 4 AS INTEGER) AS choice, CAST(sum(-CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS score FROM lineitem GROUP BY 1, 2),
    c AS (SELECT item, choice, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, choice) AS r FROM s) WHERE r = 1)"""


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    logp = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item"), (F.col("l_suppkey") % 4).cast("int").alias("choice"), (-F.round(F.col("l_discount") * 100).cast("bigint")).alias("logp")
    )
    return ev.choose(logp)


@query(f"WITH {_CHOICES} SELECT item, choice, score FROM c")
def choice_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed log-probabilities of each choice, the best one, ties to the first."""
    return _chosen(spark, sf_dir)


@query(f"WITH {_CHOICES} SELECT round(avg(CASE WHEN choice = o_custkey % 4 THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS total FROM c JOIN orders ON item = o_orderkey")
def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 4).alias("label"))
    return ev.accuracy(_chosen(spark, sf_dir), labels).select(F.round("accuracy", 9).alias("accuracy"), "total")


@query("SELECT o_orderkey AS step, CAST(o_orderkey * 2 * 256 * 2048 AS BIGINT) AS tokens FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def done_step_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps without a finished row, and their token counts."""
    steps = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"))
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("step"))
    return ev.pending(steps, done).select("step", (F.col("step") * 2 * 256 * 2048).cast("bigint").alias("tokens"))


_ITEMS = """i AS (SELECT item_id AS id, concat(text, ' ') AS ctx, [substr(text, 1, 10), substr(text, 11, 10), substr(text, 21, 10), substr(text, 31, 10)] AS choices, CAST(item_id % 4 AS INTEGER) AS label FROM benchmark),
    p AS (SELECT string_agg(concat(ctx, choices[label + 1], chr(10), chr(10)), '' ORDER BY id) AS prefix FROM (SELECT * FROM i ORDER BY id LIMIT 5))"""


@query(
    f"""WITH {_ITEMS} SELECT id, CAST(k - 1 AS INTEGER) AS choice, md5(concat(prefix, ctx)) AS context_md5, choices[k] AS answer, CAST(length(concat(prefix, ctx)) AS INTEGER) AS start
    FROM i, p, (SELECT unnest(range(1, 5)) AS k)"""
)
def few_shot_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-shot prompts for each of four endings of every benchmark item."""
    raw = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.col("text").alias("context"), *(F.substring("text", 1 + 10 * i, 10).alias(f"ending_{i + 1}") for i in range(4)),
        (F.col("item_id") % 4).cast("int").alias("label"),
    )
    items = ev.formatted(raw, "hellaswag")
    made = ev.prompts(ev.few_shot(items, 5), items)
    return made.select("id", "choice", F.md5("context").alias("context_md5"), "answer", "start")


@query("SELECT task, round(acc - chance, 9) AS gain FROM (VALUES ('copa', 0.61), ('boolq', 0.5), ('hellaswag', 0.4)) a(task, acc) JOIN (VALUES ('copa', 0.5), ('boolq', 0.5), ('hellaswag', 0.25)) c(task, chance) USING (task)".replace("round(acc - chance, 9)", "round(acc::DOUBLE - chance::DOUBLE, 9)"))
def task_chance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spark.createDataFrame([("copa", 0.61), ("boolq", 0.5), ("hellaswag", 0.4)], "task string, acc double")
    chance = spark.createDataFrame(list(ev.CHANCE.items()), "task string, chance double")
    return got.join(F.broadcast(chance), "task").select("task", F.round(F.col("acc") - F.col("chance"), 9).alias("gain"))
