"""Content-defined chunking of payload columns, with deduplicated chunks and verified reconstruction.

Cuts: a gear hash rolls over the payload; as it is shifted by one bit with every byte, it depends on the last 32 bytes
only, so all its values come from five vectorised doubling steps. A chunk ends where the hash's top bits are zero, not
before `min_size` and at `max_size` at the latest. An insertion moves only the cuts near it.

A payload is kept as the ordered list of its chunks' SHA-256 digests and lengths. Equal digests are one stored chunk.
`restore` joins the lists to the store, puts the chunks of every payload together in their order and compares the SHA-256
of the result with that of the payload. Chunks are small, so they are compressed with a common dictionary, which belongs
to the store.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import shared_dir, slices

GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear" + bytes([i])).digest()[:4], "little") for i in range(256)], dtype=np.uint32)
SPAN = 32
SIZES = (1024, 4096, 32_768)
CHUNKS = "array<struct<digest:binary,length:int>>"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sum of GEAR[byte k back] << k over the last 32 bytes, modulo 2^32."""
    h = GEAR[data]
    k = 1
    while k < SPAN:
        n = h.copy()
        n[k:] += h[:-k] << np.uint32(k)
        h, k = n, 2 * k
    return h


def candidates(payload: bytes, bits: int, window: int = 1 << 20) -> list[int]:
    """Positions after which the hash allows a cut, ascending; windows overlap by 31 bytes."""
    data = np.frombuffer(payload, dtype=np.uint8)
    found = []
    for s in range(0, len(data), window):
        lead = min(s, SPAN - 1)
        hit = np.flatnonzero(gear_hashes(data[s - lead : s + window])[lead:] >> np.uint32(32 - bits) == 0)
        found += (hit + (s + 1)).tolist()
    return found


def chunk_lengths(payload: bytes, sizes: tuple[int, int, int] = SIZES) -> list[int]:
    """Lengths of the payload's chunks in order; they add up to its length, an empty payload has none."""
    low, mean, high = sizes
    if not SPAN <= low <= mean <= high:
        raise ValueError(f"sizes must be {SPAN} <= min <= mean <= max")
    allowed, lengths, s, n = candidates(payload, max(1, round(np.log2(mean)))), [], 0, len(payload)
    while s < n:
        i = bisect_left(allowed, s + low)
        e = min(allowed[i] if i < len(allowed) else n, s + high, n)
        lengths.append(e - s)
        s = e
    return lengths


def chunk_bytes(payload: bytes, sizes: tuple[int, int, int] = SIZES) -> list[bytes]:
    out, s = [], 0
    for n in chunk_lengths(payload, sizes):
        out.append(payload[s : s + n])
        s += n
    return out


def _payload(value: str | bytes) -> bytes:
    return value.encode("utf-8", "surrogatepass") if isinstance(value, str) else value


def manifests(df: DataFrame, key: str, payload: str, sizes: tuple[int, int, int] = SIZES) -> DataFrame:
    """(key, n_bytes, sha256, chunks) for every row: the payload's digest and its ordered chunk list. A null payload has
    nulls, an empty one no chunks; repeated rows give repeated rows."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = [None if v is None else _payload(v) for v in batch.column(1).to_pylist()]
            chunks = [None if v is None else [{"digest": hashlib.sha256(c).digest(), "length": len(c)} for c in chunk_bytes(v, sizes)] for v in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([None if v is None else len(v) for v in rows], pa.int64()),
                    pa.array([None if v is None else hashlib.sha256(v).digest() for v in rows], pa.binary()),
                    pa.array(chunks, pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32())]))),
                ],
                names=["id", "n_bytes", "sha256", "chunks"],
            )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("id"), F.col(payload).alias("payload"))
    return rows.mapInArrow(listed, f"id {kind}, n_bytes bigint, sha256 binary, chunks {CHUNKS}")


def dictionary(df: DataFrame, payload: str, sizes: tuple[int, int, int] = SIZES, samples: int = 1500, size: int = 110 << 10) -> bytes | None:
    """A compression dictionary of `size` bytes, trained on at most `samples` chunks, one of each of the payloads with the
    smallest hashes. It decides how small a store is, not what is in it. None where the payloads are too few or too
    short to train one."""
    share = min(1.0, 1.3 * samples / max(1, df.count()))  # of the hashes, so that a task sends no more than it has to

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = [(h, chunk_bytes(_payload(v), sizes)) for h, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rows = [(h, c[h % len(c)]) for h, c in rows if c]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.int64()), pa.array([c for _, c in rows], pa.binary())], names=["h", "chunk"])

    rows = df.select(F.xxhash64(F.col(payload)).alias("h"), F.col(payload).alias("payload")).where(F.col("payload").isNotNull() & (F.col("h").cast("double") <= (2 * share - 1) * 2.0**63))
    some = [bytes(r["chunk"]) for r in rows.mapInArrow(picked, "h bigint, chunk binary").distinct().orderBy("h", "chunk").limit(samples).collect()]
    try:
        return zstandard.train_dictionary(size, some).as_bytes() if sum(map(len, some)) >= 8 * size else None
    except zstandard.ZstdError:
        return None


def chunk_store(df: DataFrame, payload: str, sizes: tuple[int, int, int] = SIZES, level: int = 19, book: bytes | None = None) -> DataFrame:
    """(digest, packed): each distinct chunk once, compressed, with the dictionary `book` if there is one. A task sends a
    chunk only once; one shuffle by digest leaves one row for each. A null or empty payload has no chunks, repeated
    chunks are one row, an empty table gives none. Other columns aren't read."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, seen = zstandard.ZstdCompressor(level=level, dict_data=book and zstandard.ZstdCompressionDict(book)), set()
        for batch in slices(batches, 0):
            digests, packed = [], []
            for v in batch.column(0).to_pylist():
                for c in chunk_bytes(_payload(v), sizes):
                    d = hashlib.sha256(c).digest()
                    if d not in seen:
                        if len(seen) >= 1 << 20:
                            seen.clear()  # only saves traffic
                        seen.add(d)
                        digests.append(d)
                        packed.append(squeeze.compress(c))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "packed"])

    rows = df.select(F.col(payload).alias("payload")).where("payload IS NOT NULL")
    return rows.mapInArrow(stored, "digest binary, packed binary").dropDuplicates(["digest"])


def new_chunks(store: DataFrame, existing: DataFrame) -> DataFrame:
    """The chunks of `store` that an `existing` store lacks: what an incremental load has to write. Both have distinct
    digests that aren't null; other columns of `existing` aren't read; an empty store gives no rows, an empty `existing`
    all. Both stores need the same dictionary."""
    return store.join(existing.select("digest"), "digest", "left_anti")


def restore(lists: DataFrame, store: DataFrame, with_payload: bool = True, book: bytes | None = None) -> DataFrame:
    """(sha256, payload, restored) for each distinct payload of `lists`, put together from the store (and its dictionary).
    restored is true only if all chunks are there and the SHA-256 of what they make is the payload's; a payload that
    isn't restored, or any without `with_payload`, has a null payload.

    Equal payloads are put together once; one without chunks (the empty payload) is restored; rows with a null sha256
    give no row; an empty table gives none. Of `lists` only sha256 and chunks are read, of `store` digest and packed."""
    distinct = lists.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.first("chunks").alias("chunks"))
    wanted = distinct.select("sha256", F.posexplode_outer("chunks").alias("seq", "c")).select("sha256", "seq", F.col("c.digest").alias("digest"))
    located = wanted.join(store.select("digest", "packed"), "digest", "left")
    there = F.every(F.col("packed").isNotNull() | F.col("seq").isNull())
    found = located.groupBy("sha256").agg(F.collect_list(F.struct("seq", "packed")).alias("parts"), there.alias("there"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor(dict_data=book and zstandard.ZstdCompressionDict(book))

        def put_together(digest: bytes, parts: list[dict]) -> bytes | None:
            try:
                payload = b"".join(expand.decompress(p["packed"]) for p in sorted((p for p in parts if p["seq"] is not None), key=lambda p: p["seq"]))
            except zstandard.ZstdError:  # a damaged chunk
                return None
            return payload if hashlib.sha256(payload).digest() == digest else None

        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                whole, good = [], []
                for digest, parts, there in zip(*(part.column(i).to_pylist() for i in range(3))):
                    payload = put_together(digest, parts) if there else None
                    good.append(payload is not None)
                    whole.append(payload if with_payload else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(whole, pa.binary()), pa.array(good, pa.bool_())], names=["sha256", "payload", "restored"])

    return found.mapInArrow(joined, "sha256 binary, payload binary, restored boolean")


def deduplicate(df: DataFrame, key: str, payload: str, sizes: tuple[int, int, int] = SIZES) -> DataFrame:
    """(key, n_bytes, sha256, chunks, restored) for every row of df: its ordered chunk list, and whether putting the
    stored chunks together gives the payload back, which is done for every distinct payload. Nothing is restored for a
    null payload (restored is null); key may be null or repeated; columns other than key and payload aren't read; an
    empty table gives no rows. The lists are written once; payloads are read for them, for the store and, a sample, for
    its dictionary."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/lists-{uuid.uuid4().hex}"
    manifests(df, key, payload, sizes).write.parquet(path)
    lists = df.sparkSession.read.parquet(path)
    book = dictionary(df, payload, sizes)
    checked = restore(lists, chunk_store(df, payload, sizes, book=book), with_payload=False, book=book).select("sha256", "restored")
    return lists.join(checked, "sha256", "left").select(F.col("id").alias(key), "n_bytes", "sha256", "chunks", "restored")
