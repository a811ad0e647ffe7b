"""Sum-of-squares packing of documents into training sequences.

Of all open bins, N(g) are those with a residual gap of g tokens. A piece of s tokens goes where the sum of N(g)^2 over
all gaps becomes smallest: into a bin of gap g (then N(g) falls and N(g - s) rises; a bin filled to the brim leaves the
sum) or into a new bin. Of equal choices the smaller gap wins, and any open bin before a new one. So bins are left with
diverse gaps, for which later pieces exist.

A document longer than a sequence is cut: whole sequences of it are bins of their own, the rest is packed. Documents are
spread over independent packing groups by a hash of their id, each of about `group_docs` documents, which bounds a task
whatever the size of the corpus; within a group they come in the order of that hash. Where the order of the rows is the
training order, groups are contiguous ranges of it instead, and bins are numbered in the order of their first pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import cut

PIECES = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]))
SCHEMA = "pack_group bigint, bin bigint, n_tokens bigint, pieces array<struct<doc_id:bigint,start:bigint,length:bigint>>"


class SumOfSquares:
    """Places pieces of 1..capacity tokens one after the other; bins[i] lists the numbers of the pieces in bin i."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # of open bins by gap; index 0 isn't used
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins: list[list[int]] = []

    def place(self, number: int, size: int) -> int:
        n, c = self.count, self.capacity
        gaps = np.arange(size, c)  # a gap of c would be an empty bin
        rest = gaps - size
        change = np.where(n[gaps] > 0, 1 - 2 * n[gaps] + np.where(rest > 0, 2 * n[rest] + 1, 0), np.iinfo(np.int64).max)
        fresh = 2 * int(n[c - size]) + 1 if size < c else 0
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and change[best] <= fresh:
            gap = size + best
            at = self.open[gap].pop()
            n[gap] -= 1
        else:
            gap, at = c, len(self.bins)
            self.bins.append([])
        self.bins[at].append(number)
        if gap > size:
            n[gap - size] += 1
            self.open[gap - size].append(at)
        return at


def pack_group(doc_ids: list[int | None], lengths: list[int], capacity: int) -> list[list[tuple[int | None, int, int]]]:
    """Bins of (doc_id, start, length) pieces for documents in the given order; every token is in exactly one piece."""
    packer, pieces, full = SumOfSquares(capacity), [], []
    for doc, length in zip(doc_ids, lengths):
        whole = length // capacity * capacity
        full += [[(doc, s, capacity)] for s in range(0, whole, capacity)]
        if length > whole:
            packer.place(len(pieces), length - whole)
            pieces.append((doc, whole, length - whole))
    return full + [[pieces[i] for i in b] for b in packer.bins]


def _bin_rows(group: int, bins: list[list[tuple[int | None, int, int]]]) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(bins), 10_000):
        part = bins[s : s + 10_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([group] * len(part), pa.int64()), pa.array(range(s, s + len(part)), pa.int64()),
                pa.array([sum(p[2] for p in b) for b in part], pa.int64()),
                pa.array([[{"doc_id": d, "start": a, "length": n} for d, a, n in b] for b in part], PIECES),
            ],
            names=["pack_group", "bin", "n_tokens", "pieces"],
        )


def pack(sizes: DataFrame, capacity: int = 4096, group_docs: int = 8192, seed: int = 7) -> DataFrame:
    """Packs (doc_id, n_tokens) rows: one row for each bin with its group, number within the group, tokens and pieces.

    Rows with a null, zero or negative n_tokens have nothing to pack and are in no bin; null ids and repeated rows are
    documents of their own, spread over the groups like others by their length and number, so that any number of them
    fits; ties in the order (equal id and length) are the same piece either way; an empty table gives no bins. Only
    doc_id and n_tokens are read. `sizes` is read twice, to count and to pack."""
    rows = sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("n_tokens").cast("bigint").alias("n_tokens")).where("n_tokens > 0")
    groups = max(1, -(-rows.count() // group_docs))
    block = 100_000  # equal rows are numbered without a list of them all
    equal = rows.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("n"))
    equal = equal.withColumn("b", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {block}"))))
    equal = equal.withColumn("i", F.explode(F.sequence(F.col("b") * block, F.least(F.col("n"), (F.col("b") + 1) * block) - 1)))
    of_id = F.xxhash64(F.lit(seed), "doc_id")
    h = F.when(F.col("doc_id").isNull() | (F.col("i") > 0), F.xxhash64(F.lit(seed), "doc_id", "n_tokens", "i")).otherwise(of_id)
    hashed = equal.select("doc_id", "n_tokens", h.alias("h")).withColumn("g", F.pmod("h", F.lit(groups)))

    def packed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("h", "ascending"), ("doc_id", "ascending"), ("n_tokens", "ascending")])
        yield from _bin_rows(key[0].as_py(), pack_group(table["doc_id"].to_pylist(), table["n_tokens"].to_pylist(), capacity))

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        made = list(packed(key, iter(table.to_batches())))
        return pa.Table.from_batches(made)

    return hashed.groupBy("g").applyInArrow(whole, SCHEMA)


def row_order(docs: DataFrame) -> dict[str, Column]:
    """part and row, in which docs' rows lie: file and row in it where docs is read from Parquet files, whose partitions
    follow the files' sizes rather than their order; elsewhere the partition and the row in it."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
        return {"part": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")}
    except AnalysisException:
        at = F.monotonically_increasing_id()
        return {"part": F.format_string("part-%d", F.shiftright(at, 33)), "row": at.bitwiseAND(F.lit((1 << 33) - 1))}


def _written(part: str) -> tuple[int, str]:
    """Spark's files in the order of the partitions that wrote them."""
    name = part.rpartition("/")[2]
    return int(m[1]) if (m := re.match(r"part-(\d+)", name)) else -1, name


def pack_in_order(docs: DataFrame, capacity: int = 4096, group_docs: int = 8192, path: str | None = None) -> DataFrame:
    """pack_documents() in the order of docs' rows: pack_group g holds the documents of one contiguous range of at most
    `group_docs`, ranges ascend with g, and the rows come by group and bin.

    Every row is a document of its own, so repeated ids and null ids keep their places; an empty table gives no bins."""
    from loomstone.llm.tokens import count_tokens

    rows = cut(count_tokens(docs, path, row_order(docs)))
    parts = sorted(((*_written(r["part"]), r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()))  # a row for each file
    bases, total = [], 0
    for *_, part, n in parts:
        bases.append((part, total))
        total += n
    groups = max(1, -(-total // group_docs))
    placed = (
        rows.join(docs.sparkSession.createDataFrame(bases, "part string, base bigint"), "part")
        .withColumn("rank", F.col("base") + F.col("row"))
        .select(F.floor(F.col("rank") * F.lit(groups) / F.lit(max(1, total))).cast("int").alias("g"), "rank", "doc_id", "n_tokens")
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).sort_by("rank")
        group = table["g"].to_numpy()
        for g in np.unique(group).tolist():
            own = table.filter(pa.array(group == g))
            ids = own["doc_id"].to_pylist()
            bins = sorted(pack_group(list(range(len(ids))), own["n_tokens"].to_pylist(), capacity), key=lambda b: b[0][:2])
            yield from _bin_rows(g, [[(ids[i], start, length) for i, start, length in b] for b in bins])

    return placed.repartitionById(groups, F.col("g")).mapInArrow(packed, SCHEMA)


def pack_documents(docs: DataFrame, capacity: int = 4096, group_docs: int = 8192, path: str | None = None) -> DataFrame:
    """pack() of the token counts of whole texts, each with its end-of-document token; a null text is that token."""
    from loomstone.llm.tokens import count_tokens

    return pack(cut(count_tokens(docs, path)), capacity, group_docs)
