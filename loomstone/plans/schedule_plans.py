"""Schedules, periodic steps and metrics tables."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import schedule as sc
from loomstone.plans.registry import query
from loomstone.sources.presets import PRESETS, presets

MAX_LR, MIN_LR, WARM, TOTAL = 3e-4, 3e-5, 2000, 24_000


@query(
    f"""SELECT step, round(CASE WHEN step < {WARM} THEN {MAX_LR!r}::DOUBLE * (step + 1) / {WARM} WHEN step < {int(TOTAL * 0.8)} THEN {MAX_LR!r}::DOUBLE
    ELSE {MAX_LR!r}::DOUBLE + ({MIN_LR!r}::DOUBLE - {MAX_LR!r}::DOUBLE) * ((step - {int(TOTAL * 0.8)})::DOUBLE / {TOTAL - int(TOTAL * 0.8)}) END, 12) AS lr
    FROM (SELECT unnest(range({TOTAL})) AS step)"""
)
def lr_schedule_wsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    lr = sc.warmup_stable_decay(F.col("step"), MAX_LR, MIN_LR, WARM, TOTAL)
    return sc.steps(spark, TOTAL).select("step", F.round(lr, 12).alias("lr"))


@query(
    f"""SELECT step, round(CASE WHEN step < 50 THEN 1e-5::DOUBLE * (step + 1) / 50 ELSE 1e-6::DOUBLE + {0.5 * (1e-5 - 1e-6)!r}::DOUBLE * (1 + cos({pi!r}::DOUBLE * ((step - 50)::DOUBLE / 950))) END, 12) AS lr
    FROM (SELECT unnest(range(1000)) AS step)"""
)
def lr_schedule_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lr = sc.warmup_cosine(F.col("step"), 1e-5, 1e-6, 50, 1000)
    return sc.steps(spark, 1000).select("step", F.round(lr, 12).alias("lr"))


@query(
    f"""SELECT step, step % 10 = 0 AS logs, (step > 0 AND step % 500 = 0) OR step = {TOTAL - 1} AS saves, (step > 0 AND step % 4000 = 0) AS milestone,
    step * 256 * 2 * 2048 AS tokens, CASE WHEN step >= 19200 THEN 'anneal' ELSE 'main' END AS phase, concat('step_', lpad(step::VARCHAR, 6, '0')) AS name
    FROM (SELECT unnest(range({TOTAL})) AS step)"""
)
def periodic_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logging, saving and milestone steps, tokens seen, the data phase, and zero-padded names."""
    s = F.col("step")
    return sc.steps(spark, TOTAL).select(
        "step", (F.pmod(s, F.lit(10)) == 0).alias("logs"), sc.periodic(s, 500, TOTAL - 1).alias("saves"), sc.periodic(s, 4000).alias("milestone"),
        (s * 256 * 2 * 2048).alias("tokens"), sc.data_phase(s, 19_200).alias("phase"), F.format_string("step_%06d", s).alias("name"),
    )


@query(f"SELECT step, step * 256 + micro AS key, (step * 37 + 63) // 64 * 64 AS rounded FROM (SELECT unnest(range(100)) AS step), (SELECT unnest(range(256)) AS micro)")
def micro_batch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = sc.steps(spark, 100).withColumn("micro", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return grid.select("step", sc.micro_batch_key(F.col("step"), 256, F.col("micro")).alias("key"), F.expr("(step * 37 + 63) div 64 * 64").alias("rounded"))


@query(
    """SELECT name, CAST(batch AS BIGINT) * accumulate * seq_len AS tokens_per_step, CAST(batch AS BIGINT) * accumulate * seq_len * steps AS tokens, CAST(dim // heads AS INTEGER) AS head_dim, CAST((vocab + 63) // 64 * 64 AS INTEGER) AS padded_vocab
    FROM (VALUES """
    + ", ".join(f"('{p[0]}', {', '.join(map(str, p[1:9]))}, {p[12]})" for p in PRESETS)
    + ") v(name, vocab, dim, layers, heads, kv_heads, seq_len, batch, accumulate, steps)"
)
def preset_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens for a step and a whole run of each preset, and derived sizes."""
    step = F.col("batch").cast("bigint") * F.col("accumulate") * F.col("seq_len")
    return presets(spark).select("name", step.alias("tokens_per_step"), (step * F.col("steps")).alias("tokens"), F.expr("CAST(dim div heads AS INT)").alias("head_dim"), F.expr("CAST((vocab + 63) div 64 * 64 AS INT)").alias("padded_vocab"))
