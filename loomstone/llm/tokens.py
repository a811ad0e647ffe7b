"""Token ids with a public byte-level BPE vocabulary, and flat binary token files.

Files: each partition writes `part-NNNNN-ATTEMPT.bin`, the ids of its documents one after the other as little-endian
unsigned integers (uint16 up to 65,536 ids, else uint32), each document followed by the end-of-document id, and a file
`.idx` of int64 offsets (documents + 1 of them) within it. Prefix sums over the partitions' totals give every partition's
base, so a document's global 64-bit offset is base + local offset; `bases.json` keeps them for the reader. The rows of
a partition name the task attempt that wrote them, and only files named by committed rows are in `bases.json`: a lost
or repeated task leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import cut, qualified, shared_dir, slices

VOCABULARY = "byte_bpe_50k.tiktoken"
END = 50_256


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The encoder of a rank file; read once in a Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts: list[str | None], path: str) -> list[list[int]]:
    """Ids of whole texts without the end id; a null text has none. Lone surrogates are replaced by the encoder."""
    tok = encoding(path)
    return [tok.encode_ordinary(t) if t else [] for t in texts]


def count_tokens(docs: DataFrame, path: str | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, n_tokens) for every row, the end id counted: 1 for a null or empty text; and the columns `more`."""
    more = more or {}
    names = ["doc_id", "n_tokens", *more]
    path = path or vocabulary_path()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            n = [len(ids) + 1 for ids in encode(batch.column(1).to_pylist(), path)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *batch.columns[2:]], names=names)

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", *(c.alias(k) for k, c in more.items()))
    kinds = "".join(f", {k} {kind}" for k, kind in rows.dtypes[2:])
    return rows.mapInArrow(counted, "doc_id bigint, n_tokens bigint" + kinds)


def write_tokens(docs: DataFrame, folder: str | None = None, path: str | None = None, end: int = END, vocabulary: int = 50_257) -> DataFrame:
    """Writes all documents' ids to `folder` (default: a new one in the shared folder; without a scheme it is on
    the session's default file system) and returns one row for each
    row of docs: doc_id, part, part_row, n_tokens (with the end id), start and stop (global 64-bit token offsets),
    file.

    A null or empty text is just the end id; a null doc_id and repeated rows are documents of their own; an empty table
    gives no rows and no ids. Only doc_id and text are read. The ids are checked to fit the integer type."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    folder = qualified(spark, folder)
    dtype = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{part:05d}-{attempt}"
        at, row, offsets = 0, 0, [np.zeros(1, dtype="<i8")]
        with fs.open_output_stream(name + ".bin") as out:
            for batch in slices(batches, 1):
                lists = encode(batch.column(1).to_pylist(), path)
                n = np.fromiter((len(x) + 1 for x in lists), np.int64, len(lists))
                ids = np.full(int(n.sum()), end, dtype=np.int64)
                stops = np.cumsum(n)
                for x, stop, size in zip(lists, stops.tolist(), n.tolist()):
                    ids[stop - size : stop - 1] = x
                if len(ids) and int(ids.max()) >= vocabulary:
                    raise ValueError(f"id {int(ids.max())} is outside a vocabulary of {vocabulary}")
                out.write(ids.astype(dtype).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(np.full(len(n), attempt), pa.int64()), pa.array(np.arange(row, row + len(n)), pa.int64()), pa.array(n), pa.array(at + stops - n)],
                    names=["doc_id", "part", "attempt", "part_row", "n_tokens", "local"],
                )
                offsets.append((at + stops).astype("<i8"))
                at, row = at + int(n.sum()), row + len(n)
        with fs.open_output_stream(name + ".idx") as out:
            out.write(np.concatenate(offsets).tobytes())

    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(written, "doc_id bigint, part int, attempt bigint, part_row bigint, n_tokens bigint, local bigint")
    rows = cut(rows)  # the files are written once, here
    totals = rows.groupBy("part", "attempt").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    name = F.format_string("part-%05d-%d", "part", "attempt")
    bases = cut(totals.select("part", name.alias("name"), "n", "docs", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/bases.json") as out:
        parts = [r.asDict() for r in bases.orderBy("part").toLocalIterator()]
        out.write(json.dumps({"dtype": dtype.str, "end": end, "parts": parts}).encode())
    start = F.col("base") + F.col("local")
    return rows.join(bases.select("part", "name", "base"), "part").select(
        "doc_id", "part", "part_row", "n_tokens", start.alias("start"), (start + F.col("n_tokens")).alias("stop"),
        F.concat(F.lit(f"{folder}/"), "name", F.lit(".bin")).alias("file"),
    )


class TokenFiles:
    """Memory-mapped reader of a local folder of token files; nothing is read but the pages that are asked for."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")
        with open(f"{self.folder}/bases.json") as f:
            meta = json.load(f)
        self.dtype, self.parts = np.dtype(meta["dtype"]), meta["parts"]
        self.bases = np.array([p["base"] for p in self.parts], dtype=np.int64)
        self.first = np.cumsum([0, *(p["docs"] for p in self.parts)])
        self.total = sum(p["n"] for p in self.parts)

    def _map(self, i: int, kind: str, dtype: np.dtype) -> np.memmap:
        return np.memmap(f"{self.folder}/{self.parts[i]['name']}.{kind}", dtype=dtype, mode="r")

    def __len__(self) -> int:
        return int(self.first[-1])

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document over all files."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        p = int(np.searchsorted(self.first, i, side="right") - 1)
        index = self._map(p, "idx", np.dtype("<i8"))
        k = i - int(self.first[p])
        return np.array(self._map(p, "bin", self.dtype)[index[k] : index[k + 1]])

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids of a global range of offsets, across files where needed."""
        got, stop = [], min(stop, self.total)
        while start < stop:
            p = int(np.searchsorted(self.bases, start, side="right") - 1)
            end = min(stop, int(self.bases[p]) + self.parts[p]["n"])
            got.append(np.array(self._map(p, "bin", self.dtype)[start - int(self.bases[p]) : end - int(self.bases[p])]))
            start = end
        return np.concatenate(got) if got else np.zeros(0, self.dtype)
