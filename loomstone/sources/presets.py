"""Run presets and generated inputs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "name string, vocab int, dim int, layers int, heads int, kv_heads int, seq_len int, batch int, accumulate int, max_lr double, min_lr double, warmup int, steps int"
PRESETS = [
    ("1b", 65_536, 2048, 24, 16, 4, 2048, 2, 256, 3e-4, 3e-5, 2000, 24_000),
    ("400m", 65_536, 1024, 24, 16, 4, 2048, 4, 64, 3e-4, 3e-5, 2000, 24_000),
    ("125m", 65_536, 768, 12, 12, 4, 1024, 8, 32, 6e-4, 6e-5, 1000, 10_000),
    ("30m", 65_536, 384, 8, 8, 2, 512, 8, 4, 1e-3, 1e-4, 100, 2000),
    ("smoke", 2048, 256, 4, 4, 2, 256, 8, 2, 1e-3, 1e-4, 10, 60),
]
PROMPTS = [("오늘 날씨는", 0.7), ("대한민국의 수도는", 0.3), ("인공지능이란", 0.8), ("Once upon a time", 0.9)]


def presets(spark: SparkSession) -> DataFrame:
    """One row for each run size; heads must divide dim, and key heads the heads."""
    for p in PRESETS:
        if p[2] % p[4] or p[4] % p[5]:
            raise ValueError(f"preset {p[0]} doesn't divide")
    return spark.createDataFrame(PRESETS, FIELDS)


def prompts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROMPTS, "prompt string, temperature double")


def random_batches(spark: SparkSession, steps: int, batch: int, length: int, vocab: int, seed: int = 0) -> DataFrame:
    """(step, row, ids): uniform ids, the same for the same seed whatever the partitioning."""
    grid = spark.range(steps).select(F.col("id").cast("int").alias("step")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(batch - 1))))
    at = lambda i: F.pmod(F.xxhash64(F.lit(seed), "step", "row", i), F.lit(vocab)).cast("int")
    return grid.withColumn("ids", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at))
