"""Running sums over a whole table without a single-partition window.

A global `sum() OVER (ORDER BY ...)` puts every row in one task. Here rows are range-partitioned and sorted, every
partition's total is added up first (one row each), and a partition's running sum starts at its base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.lineage import cut


def global_running_sum(
    df: DataFrame, order: list[str | Column], value: str, out: str, partitions: int | None = None, inclusive: bool = False, keys: list[str] | None = None,
) -> DataFrame:
    """df with `out`: the sum of `value` over all earlier rows in the given order (and this one, if inclusive), of the
    same `keys` where these are given. The order has to be unique (within the keys). A key with any share of the rows is
    spread over the partitions like the others. Range bounds are sampled, so a second evaluation could draw others: the
    ranged rows are written once with their partition's number, and both the totals and the rows are read from there.
    Keep df narrow."""
    keys = keys or []
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part", *keys).agg(F.sum(value).alias("_total"))  # a row for each partition and key in it
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_part", *keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    rows = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(rows), F.lit(0)))
    if keys:  # null keys are a key
        base = base.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_base")
        same = F.col("_part") == F.col("_p")
        for i, k in enumerate(keys):
            same = same & local[k].eqNullSafe(F.col(f"_k{i}"))
        joined = local.join(base, same).drop("_p", *(f"_k{i}" for i in range(len(keys))))
    else:
        joined = local.join(base, "_part")
    return joined.withColumn(out, (F.col("_base") + F.col("_local")).cast("bigint")).drop("_part", "_base", "_local")
