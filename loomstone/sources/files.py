"""Listings, metadata counts, step tables and raw token shards."""

from __future__ import annotations

from functools import reduce

import pyarrow.dataset as pads
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def row_count(path: str) -> int:
    """Rows of a local Parquet file or folder from the footers alone; no column is read."""
    return pads.dataset(path, format="parquet").count_rows()


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables of a data directory, sorted: what can be configured as a source."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    entries = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(e.getPath().getName().removesuffix(".parquet") for e in entries if e.getPath().getName().endswith(".parquet"))


def read_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The union of all parts that can be opened, with `part` as their position; a missing part is left out, and it is
    an error if none is left."""
    frames = []
    for i, path in enumerate(paths):
        try:
            frames.append(spark.read.parquet(path).withColumn("part", F.lit(i)))
        except AnalysisException:
            continue
    if not frames:
        raise FileNotFoundError(f"none of {len(paths)} parts can be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def finished_steps(spark: SparkSession, path: str) -> DataFrame:
    """(step INT) from a CSV of results; rows without a step don't count."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.expr("try_cast(step AS INT)").alias("step")).where("step IS NOT NULL")


def step_files(spark: SparkSession, folder: str, glob: str = "step_*") -> DataFrame:
    """(step, path) of snapshot files, sorted by path; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.select(F.regexp_extract("path", r"step_(\d+)", 1).cast("int").alias("step"), "path").orderBy("path")


def raw_shards(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """(file, shard_idx, n, tok ARRAY<INT>) of `{split}_NNNNNN.bin` files of little-endian uint16 ids; an error if there
    is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{split}_*.bin").load(folder)

    @F.pandas_udf("array<int>")
    def unpack(content):
        import numpy as np

        return content.map(lambda b: np.frombuffer(b, dtype="<u2").astype("int32"))

    shards = files.select(
        F.regexp_extract("path", r"[^/]+$", 0).alias("file"), F.regexp_extract("path", r"_(\d+)\.bin$", 1).cast("bigint").alias("shard_idx"),
        (F.col("length") / 2).cast("bigint").alias("n"), unpack("content").alias("tok"),
    )
    if shards.isEmpty():
        raise FileNotFoundError(f"no {split} shards in {folder}")
    return shards
