"""Evaluation aggregates over token log-probabilities and losses; the scores themselves come from a model elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One over the number of choices.
CHANCE = {task: 1 / choices for task, choices in (("copa", 2), ("boolq", 2), ("hellaswag", 4))}


def perplexity(losses: DataFrame, batch: str, loss: str) -> DataFrame:
    """exp of the mean of batch means, as batches are of equal size in use."""
    return losses.groupBy(batch).agg(F.avg(loss).alias("m")).agg(F.avg("m").alias("mean_loss")).withColumn("ppl", F.exp("mean_loss"))


def masked_mean(loss: Column, target: Column, ignore: int = -100) -> Column:
    """Mean loss over targets that aren't ignored; the denominator is at least 1."""
    live = target != ignore
    return F.coalesce(F.sum(F.when(live, loss)), F.lit(0.0)) / F.greatest(F.count_if(live), F.lit(1))


def choose(logp: DataFrame) -> DataFrame:
    """(item, choice, score): the choice with the largest summed log-probability, the first of equal ones."""
    scores = logp.groupBy("item", "choice").agg(F.sum("logp").alias("score"))
    w = Window.partitionBy("item").orderBy(F.desc("score"), "choice")
    return scores.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def accuracy(chosen: DataFrame, labels: DataFrame) -> DataFrame:
    return chosen.join(labels, "item").agg(F.avg((F.col("choice") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("total"))


def formatted(items: DataFrame, task: str) -> DataFrame:
    """(id, ctx, choices, label) for one of the tasks: cause or effect with two alternatives, a yes/no question on a
    paragraph, four endings of a context."""
    if task == "copa":
        joiner = F.when(F.col("question") == "원인", "왜냐하면").otherwise("그래서")
        return items.select("id", F.concat("premise", F.lit(" "), joiner, F.lit(" ")).alias("ctx"), F.array("alternative_1", "alternative_2").alias("choices"), "label")
    if task == "boolq":
        ctx = F.concat("paragraph", F.lit("\n질문: "), "question", F.lit("\n답: "))
        return items.select("id", ctx.alias("ctx"), F.array(F.lit("아니오"), F.lit("예")).alias("choices"), "label")
    if task == "hellaswag":
        return items.select("id", F.concat("context", F.lit(" ")).alias("ctx"), F.array(*(f"ending_{i}" for i in range(1, 5))).alias("choices"), "label")
    raise ValueError(f"unknown task {task!r}")


def few_shot(train: DataFrame, shots: int) -> DataFrame:
    """One row: the first `shots` items with their right choices, a blank line after each; '' for none."""
    head = train.orderBy("id").limit(shots)
    shot = F.concat("ctx", F.element_at("choices", F.col("label") + 1), F.lit("\n\n"))
    return head.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", shot.alias("s")))), lambda e: e["s"]), "").alias("prefix"))


def prompts(prefix: DataFrame, items: DataFrame) -> DataFrame:
    """(id, choice, context, answer, start): every choice of every item behind the prefix; `start` is the character at
    which the choice begins, so its tokens are found by offset whatever the tokenizer merges at the seam."""
    rows = items.crossJoin(F.broadcast(prefix)).select("id", F.concat("prefix", "ctx").alias("context"), F.posexplode("choices").alias("choice", "answer"))
    return rows.withColumn("start", F.length("context"))


def pending(steps: DataFrame, done: DataFrame) -> DataFrame:
    """Steps that no finished row names."""
    return steps.join(done.where("step IS NOT NULL").select("step"), "step", "left_anti")
