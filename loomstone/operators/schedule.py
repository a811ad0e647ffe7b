"""Learning-rate schedules and periodic steps as tables over steps."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def steps(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("step"))


def warmup_stable_decay(step: Column, max_lr: float, min_lr: float, warmup: int, total: int, decay_from: float = 0.8) -> Column:
    """Linear rise over `warmup` steps, then constant, then a linear fall from decay_from * total to min_lr."""
    start = int(total * decay_from)
    fall = (step - start) / F.lit(float(max(1, total - start)))
    return F.when(step < warmup, F.lit(max_lr) * (step + 1) / F.lit(float(warmup))).when(step < start, F.lit(max_lr)).otherwise(
        F.lit(max_lr) + (F.lit(min_lr) - F.lit(max_lr)) * fall
    )


def warmup_cosine(step: Column, max_lr: float, min_lr: float, warmup: int, total: int) -> Column:
    share = (step - warmup) / F.lit(float(max(1, total - warmup)))
    return F.when(step < warmup, F.lit(max_lr) * (step + 1) / F.lit(float(warmup))).otherwise(
        F.lit(min_lr) + F.lit(0.5 * (max_lr - min_lr)) * (F.lit(1.0) + F.cos(F.lit(pi) * share))
    )


def periodic(step: Column, every: int, last: int | None = None) -> Column:
    """True at positive multiples of `every`, and at the last step."""
    hit = (step > 0) & (F.pmod(step, F.lit(every)) == 0)
    return hit if last is None else hit | (step == last)


def micro_batch_key(step: Column, accumulate: int, micro: Column) -> Column:
    """Position of a micro-batch in the whole run: windows keyed by it are the same after a restart."""
    return step * accumulate + micro


def data_phase(step: Column, switch: int) -> Column:
    """Which shards a step reads: the main ones, from `switch` on the annealing ones."""
    return F.when(step >= switch, "anneal").otherwise("main")
