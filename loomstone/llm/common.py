"""Helpers shared by the operators: durable lineage cuts and bounded slicing of Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir. Where none is set, a temporary one in local
    mode; on a cluster that is an error, as no executor could read another's."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomstone-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes `df` once to the shared checkpoint folder and reads on from there; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark reads it: one without a scheme is on the session's default file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{full[5:]}" if full.startswith("file:/") and not full.startswith("file://") else full


def quoted(name: str) -> str:
    """A column's name for F.col(): dots and backticks in it are part of the name."""
    return "`" + name.replace("`", "``") + "`"


def slices(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the values of one string or binary column (or the sizes, if it holds integers) stay
    near max_bytes; a longer single value comes alone. Bounds the memory of a Python worker whatever the batch size of the session."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column(column)
        sizes = (values if pa.types.is_integer(values.type) else pc.binary_length(values)).fill_null(0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)
