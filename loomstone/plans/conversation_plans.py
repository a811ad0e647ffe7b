"""Instruction pairs, chat templates, masked and padded examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions.text import DUCK_POINTS
from loomstone.operators import conversations as cv
from loomstone.plans.registry import query
from loomstone.sources.tables import table

MAX_LEN, BATCH = 1024, 8
_PAIRS = """pairs AS (SELECT conv_id, turn, text AS user, na AS assistant FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS na FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant' AND text <> '' AND na <> '')"""
_POINTS = lambda c: DUCK_POINTS.replace("text", c)
_EXAMPLES = f"""{_PAIRS}, coded AS (SELECT conv_id, turn, list_concat([{cv.IM_START}], {_POINTS("concat('user', chr(10), user)")}, [{cv.IM_END}], [{cv.IM_START}], {_POINTS("concat('assistant', chr(10))")}) AS ctx,
        list_append({_POINTS("assistant")}, {cv.IM_END}) AS ans FROM pairs),
    ex AS (SELECT conv_id, turn, len(ctx) AS c, list_slice(list_concat(ctx, ans), 1, {MAX_LEN}) AS ids FROM coded),
    kept AS (SELECT conv_id, turn, ids, c, list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i > c THEN 1 ELSE 0 END) AS mask FROM ex WHERE len(ids) >= c + 4)"""


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.examples(cv.turn_pairs(table(spark, sf_dir, "conversations")), MAX_LEN)


@query(f"WITH {_PAIRS} SELECT conv_id, turn, user, assistant FROM pairs")
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.turn_pairs(table(spark, sf_dir, "conversations"))


@query(
    f"""WITH {_PAIRS}, s AS (SELECT conv_id, any_value(text) AS sys FROM conversations WHERE role = 'system' GROUP BY conv_id)
    SELECT conv_id, turn, concat('<|im_start|>user', chr(10), CASE WHEN coalesce(sys, '') <> '' THEN concat(sys, chr(10), chr(10), user) ELSE user END, '<|im_end|>', chr(10),
    '<|im_start|>assistant', chr(10), assistant, '<|im_end|>') AS text FROM pairs LEFT JOIN s USING (conv_id)"""
)
def chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt with its optional part (here the system turn) in the chat template."""
    turns = table(spark, sf_dir, "conversations")
    system = turns.where("role = 'system'").groupBy("conv_id").agg(F.any_value("text").alias("sys"))
    pairs = cv.turn_pairs(turns).join(system, "conv_id", "left")
    user = F.when(F.coalesce("sys", F.lit("")) != "", cv.prompt(F.col("sys"), F.col("user"))).otherwise(F.col("user"))
    return pairs.select("conv_id", "turn", cv.template(user, F.col("assistant")).alias("text"))


@query(f"WITH {_EXAMPLES} SELECT conv_id, turn, ids, mask FROM kept")
def sft_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir)


@query(
    f"""WITH {_EXAMPLES}, b AS (SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // {BATCH} AS batch FROM kept),
    f AS (SELECT *, count(*) OVER (PARTITION BY batch) AS n, max(len(ids)) OVER (PARTITION BY batch) AS l FROM b)
    SELECT batch, conv_id, turn, list_concat(list_slice(ids, 1, len(ids) - 1), list_transform(range(0, l - len(ids)), lambda i: {cv.PAD})) AS x,
        list_concat(list_transform(range(2, len(ids) + 1), lambda i: CASE WHEN mask[i] = 1 THEN ids[i] ELSE {cv.IGNORE} END), list_transform(range(0, l - len(ids)), lambda i: {cv.IGNORE})) AS y
    FROM f WHERE n = {BATCH}"""
)
def batch_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.batches(_examples(spark, sf_dir), BATCH, ["conv_id", "turn"])


@query(
    """SELECT conv_id, turn, string_agg(concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)), '')
    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS history FROM conversations"""
)
def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.history(table(spark, sf_dir, "conversations"))
