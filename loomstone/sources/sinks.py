"""Sinks: raw token shards, run summaries, metric tables, versioned snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_raw_shards(chunks: DataFrame, folder: str, split: str) -> DataFrame:
    """Writes (shard_idx, tok) rows as `{split}_NNNNNN.bin` of little-endian uint16 and returns (file, n). Ids must be
    below 65,536. Files are written under the attempt's name and renamed, so a repeated task leaves whole files."""
    folder = folder if "://" in folder else f"file://{folder}"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for shard, tok in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.asarray(tok.values, dtype=np.int64)
                if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 16:
                    raise ValueError("an id doesn't fit 16 bits")
                name = f"{split}_{shard:06d}.bin"
                with fs.open_output_stream(f"{root}/_{attempt}-{name}") as out:
                    out.write(ids.astype("<u2").tobytes())
                fs.move(f"{root}/_{attempt}-{name}", f"{root}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)], pa.int64())], names=["file", "n"])

    return chunks.select("shard_idx", "tok").mapInArrow(written, "file string, n bigint")


def write_summary(counters: DataFrame, path: str, **facts: str | int | float) -> None:
    """One JSON object: totals of (source, got, seen, kept) rows, the rows themselves as a nested list, and facts."""
    total = counters.agg(
        F.sum("got").alias("tokens"), F.sum("seen").alias("docs"), F.sum("kept").alias("kept"),
        F.array_sort(F.collect_list(F.struct("source", "got", "seen", "kept"))).alias("sources"),
    )
    for name, value in facts.items():
        total = total.withColumn(name, F.lit(value))
    total.coalesce(1).write.mode("overwrite").json(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Appends metric rows as CSV files with a header each; nulls are empty fields."""
    rows.coalesce(1).write.mode("append").option("header", True).csv(path)


def snapshot_path(root: str, step: int) -> str:
    """Place of a snapshot that later ones don't overwrite."""
    return f"{root}/step_{step:06d}"


def save_snapshot(df: DataFrame, root: str, step: int) -> str:
    """Writes a snapshot; it's there only once the job is committed, and an existing one is left alone."""
    path = snapshot_path(root, step)
    df.write.mode("ignore").parquet(path)
    return path


def observed(df: DataFrame, name: str, token_column: str):
    """df with counters that are filled while it is written (no second pass): rows and tokens."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(token_column), F.lit(0)).alias("tokens")), seen
