"""Incremental forms: one forward pass over arriving files, duplicate filter with stored keys, polling for new files."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.operators import minhash as mh
from loomstone.operators.lineage import cut


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stream's state under spark.checkpoint.dir; a temporary one where that isn't set, in local
    mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"loomstone-{name}-")
    return f"{base.rstrip('/')}/{name}-{os.urandom(8).hex()}"


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A Parquet table (a folder or one file) as a stream of its files, with the schema of what is there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).option("recursiveFileLookup", False).parquet(str(place.getParent()))
    return reader.parquet(path)


def run_once(stream: DataFrame, sink: str, mode: str = "append", **options) -> None:
    """Processes all that has arrived and stops; a restart with the same checkpoint goes on from there."""
    checkpoint = options.pop("checkpoint", None) or f"{sink}-state"
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start().awaitTermination()


def clean_stream(docs: DataFrame, letters: str = tx.LATIN) -> DataFrame:
    """Rows of a stream that pass the cleaning filters; stateless, so nothing is stored but the offset."""
    return docs.where(tx.keep_document("text", letters))


class DuplicateFilter:
    """First-come duplicate filter over micro-batches. Keys of kept documents are appended to a Parquet table; a batch
    is first held against the table, then filtered in itself. A batch that is repeated after a failure overwrites its
    own part of the table, so the result is the same."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.keys, self.kept = spark, f"{folder}/keys", f"{folder}/kept"

    def _before(self, batch_id: int) -> DataFrame | None:
        if batch_id == 0:
            return None
        return self.spark.read.parquet(self.keys).where(F.col("batch") < batch_id)

    def __call__(self, docs: DataFrame, batch_id: int) -> None:
        bands = cut(mh.exact_band_keys(docs))  # the signatures are computed once
        known = self._before(batch_id)
        if known is not None:
            hit = bands.join(known.select("band", "key").distinct(), ["band", "key"], "left_semi").select("doc_id").distinct()
            bands = bands.join(hit, "doc_id", "left_anti")
        if bands.isEmpty():
            kept = bands.select("doc_id")
        else:
            kept = mh.greedy_keep(bands)
        kept.write.mode("overwrite").parquet(f"{self.kept}/batch={batch_id}")
        bands.join(kept, "doc_id", "left_semi").select("band", "key").write.mode("overwrite").parquet(f"{self.keys}/batch={batch_id}")

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(self.kept).select("doc_id")


def new_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(step, path) of the files that match, as a stream: with a trigger of an hour it polls for new snapshots."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return stream.select(F.regexp_extract("path", r"step_(\d+)", 1).cast("int").alias("step"), "path")
