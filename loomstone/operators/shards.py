"""Packing a token stream into fixed-size shards, and reading windows back.

The stream is the documents' tokens in a given order. A document may straddle shards: its row is cut at the boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pieces(docs: DataFrame, shard_tokens: int) -> DataFrame:
    """From rows with `start` (stream offset) and `n_tok`: one row for each shard a document touches, with the offset
    in the shard, the piece's first token in the document and its length."""
    first = F.expr(f"start div {shard_tokens}")
    last = F.expr(f"(start + n_tok - 1) div {shard_tokens}")
    cut = docs.where("n_tok > 0").withColumn("shard_idx", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("shard_idx") * shard_tokens)
    end = F.least(F.col("start") + F.col("n_tok"), (F.col("shard_idx") + 1) * shard_tokens)
    return cut.withColumn("shard_off", (begin - F.col("shard_idx") * shard_tokens)).withColumn("doc_off", begin - F.col("start")).withColumn("length", end - begin)


def chunked(pieces_with_tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `keys` with the ordered tokens of their pieces: (keys, tok ARRAY<INT>)."""
    lists = pieces_with_tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("shard_off", "tok"))).alias("p"))
    return lists.select(*keys, F.flatten(F.transform("p", lambda e: e["tok"])).alias("tok"))


def window_starts(spark, seed: int, steps: int, batch: int, total: int, length: int) -> DataFrame:
    """Reproducible starts (step, row, start) from (seed, step, row) alone, in [0, total - length - 1): the last legal
    start is never drawn, and a stream that is too short is an error."""
    if total - length - 1 <= 0:
        raise ValueError(f"a stream of {total} tokens is too short for windows of {length}")
    grid = spark.range(steps).select(F.col("id").cast("int").alias("step")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(batch - 1))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("step").cast("string"), F.col("row").cast("string")))
    return grid.withColumn("start", F.pmod(F.conv(F.substring(key, 1, 12), 16, 10).cast("bigint"), F.lit(total - length - 1)))


def gather(starts: DataFrame, chunks: DataFrame, chunk_tokens: int, length: int) -> DataFrame:
    """(step, row, x, y) from windows of length + 1 tokens that may cross chunks; an equi-join on the chunk number
    instead of a range join. chunks: (chunk_idx, tok), all but the last of chunk_tokens tokens."""
    touched = starts.withColumn("chunk_idx", F.explode(F.sequence(F.expr(f"start div {chunk_tokens}"), F.expr(f"(start + {length}) div {chunk_tokens}"))))
    first = F.greatest(F.col("start") - F.col("chunk_idx") * chunk_tokens, F.lit(0)).cast("int")
    end = F.least(F.col("start") + length + 1 - F.col("chunk_idx") * chunk_tokens, F.lit(chunk_tokens)).cast("int")
    got = touched.join(chunks, "chunk_idx").select("step", "row", "start", F.struct("chunk_idx", F.slice("tok", first + 1, end - first).alias("t")).alias("p"))
    whole = got.groupBy("step", "row", "start").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda e: e["t"])).alias("w"))
    return whole.select("step", "row", "start", F.slice("w", 1, length).alias("x"), F.slice("w", 2, length).alias("y"))


def uint16_file_names(split: Column, shard: Column) -> Column:
    return F.format_string("%s_%06d.bin", split, shard)
