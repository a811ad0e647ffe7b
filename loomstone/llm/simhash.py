"""Near-duplicate removal by SimHash and covering locality-sensitive hashing.

Fingerprint: the distinct lower-case words of the whole text vote on 256 bits (four blocks of 64), each word by the
bits of its 64-bit hash mixed four ways. Two texts that differ in a few per cent of their words differ in a few per
cent of the bits.

Candidates: the 256 bits are cut into blocks with radii r such that the sum of all r + 1 is accept + 1 (for 40: five blocks
of radius 6, one of 5). By the pigeonhole principle two fingerprints within `accept` bits differ in at most r positions of
some block. Non-zero vectors m(i) of GF(2)^(r+1) are given to a block's positions, each about as often as any other; table v
(each non-zero v) looks at the positions with <m(i), v> = 1, about half of them. Positions in which two blocks differ, if at
most r, span at most r dimensions, so some v is orthogonal to all of them and that table sees equal bits. So every pair
within `accept` shares a key in one of the 5 * 127 + 63 tables, and none is left to chance.

Search: fingerprints are dealt into groups of about `held`, and each pair of groups is searched table by table, by tasks
that hold both groups and sort their keys. No bucket is capped: those of up to SMALL members are compared pair by pair,
larger ones breadth first, where members already joined come along without a comparison. Pairs of up to `accept` differing
bits are links; a task sends those that join two of its components. The work grows as the square of the fingerprints
over 2^21, the bits that a table sees. Connected components of the links are the groups, and of a group one row stays, of
the smallest doc_id.

links() is an older search, which no query uses: its work grows in proportion to the fingerprints, but only pairs within
BLOCKS * (radius + 1) - 1 bits are guaranteed, and others found with a probability that falls with their distance.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomstone.llm.common import cut, shared_dir, slices

BLOCKS, WIDTH = 4, 64
_WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_FP = [f"f{b}" for b in range(BLOCKS)]


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the distinct lower-case words; of the text itself where it has no word."""
    words = set(_WORD.findall(text.lower())) or {text}
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def _spread(h: np.ndarray) -> np.ndarray:
    """(n,) hashes to (n, 4) independent ones: a multiplicative mix and two xor shifts for each block."""
    with np.errstate(over="ignore"):
        x = h[:, None] * _MIX[None, :]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def fingerprints(texts: list[str]) -> np.ndarray:
    """(n, 4) uint64 fingerprints. Votes are added as packed 8-bit counters, 255 words at a time; a tie gives 1."""
    out = np.zeros((len(texts), BLOCKS), dtype=np.uint64)
    for i, text in enumerate(texts):
        h = _spread(word_hashes(text))
        votes = np.zeros(BLOCKS * WIDTH, dtype=np.int64)
        for s in range(0, len(h), 255):
            bits = np.unpackbits(h[s : s + 255].view(np.uint8), axis=1)
            votes += bits.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
        out[i] = np.packbits(2 * votes >= len(h)).view(np.uint64)
    return out


def covering_masks(radius: int, seed: int = 1) -> list[int]:
    """The 2 ** (radius + 1) - 1 masks of 64 bits for one block, of equal size but for a position or two."""
    n = 2 ** (radius + 1) - 1
    order = np.random.default_rng(seed).permutation(n) + 1
    m = [int(order[i % n]) for i in range(WIDTH)]
    return [sum(1 << i for i in range(WIDTH) if (m[i] & v).bit_count() & 1) for v in range(1, n + 1)]


def sample_masks(samples: int, bits: int, seed: int = 1) -> np.ndarray:
    """(samples, 4) uint64 masks of `bits` positions out of all 256."""
    rng, out = np.random.default_rng(seed), np.zeros((samples, BLOCKS), dtype=np.uint64)
    for mask in out:
        for at in rng.choice(BLOCKS * WIDTH, bits, replace=False).tolist():
            mask[at // WIDTH] |= np.uint64(1 << at % WIDTH)
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of (.., 4) uint64 fingerprints."""
    bits = np.bitwise_count(a ^ b)
    return sum(bits[..., k].astype(np.int64) for k in range(BLOCKS))


def _signed(rows: DataFrame) -> DataFrame:
    """(first column, f0..f3) for rows of two columns, the second a text that isn't null."""
    name = rows.columns[0]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fp = fingerprints(batch.column(1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fp[:, b]) for b in range(BLOCKS))], names=[name, *_FP])

    return rows.mapInArrow(signed, StructType([rows.schema[0], *(StructField(f, LongType()) for f in _FP)]))


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, f0..f3) for rows with a text; the id may be null."""
    return _signed(docs.select(F.col("doc_id").cast("bigint"), "text").where("text IS NOT NULL"))


def _runs(*keys: np.ndarray) -> list[np.ndarray]:
    """Starts and lengths of the runs of equal keys in sorted arrays."""
    n = len(keys[0])
    if not n:
        return [np.zeros(0, np.int64)] * 2
    new = np.ones(n, dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return [starts, np.diff(np.append(starts, n))]


def _columns(batches: Iterator[pa.RecordBatch], width: int) -> list[np.ndarray]:
    got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    return [np.concatenate([g[i] for g in got]) for i in range(width)] if got else [np.zeros(0, np.int64)] * width


KEY_BYTES = 6  # of a key's 64 bits, within a partition that the others chose


def table_masks(radius: int, samples: int, bits: int) -> np.ndarray:
    """(tables, 4) masks of both families."""
    covering = np.zeros((BLOCKS, 2 ** (radius + 1) - 1, BLOCKS), dtype=np.uint64)
    for b in range(BLOCKS):
        covering[b, :, b] = covering_masks(radius, seed=b + 1)
    return np.concatenate([covering.reshape(-1, BLOCKS), sample_masks(samples, bits)])


def table_keys(fp: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """(n, tables) 64-bit hashes of the masked fingerprints and the table's number."""
    with np.errstate(over="ignore"):
        key = np.arange(1, len(masks) + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
        for b in range(BLOCKS):
            key = key + (fp[:, b, None] & masks[None, :, b]) * _MIX[b]
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return key ^ (key >> np.uint64(29))


def _packed(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """(n, width) bytes as binary values that end at rows `ends`."""
    width = rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes_of(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<i8" if values.dtype.kind == "i" else "<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def _entries(masks: np.ndarray, parts: int, rows: int = 8192):
    """(rep, f0..f3) to (part, reps, keys): the table entries of up to `rows` fingerprints that go to one of `parts`
    partitions, packed; ids that aren't negative take as many bytes as the largest needs."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, rows):
                some = batch.slice(s, rows)
                fp = np.stack([some.column(1 + b).to_numpy() for b in range(BLOCKS)], axis=1).astype(np.int64).view(np.uint64)
                rep = some.column(0).to_numpy()
                width = 8 if rep.min() < 0 else max(1, (int(rep.max()).bit_length() + 7) // 8)
                key = table_keys(fp, masks).ravel()
                part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
                order = np.argsort(part, kind="stable")
                part = part[order]
                starts, _ = _runs(part)
                ends = np.append(starts, len(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[starts].astype(np.int32)), _packed(_bytes_of(rep, width)[order // len(masks)], ends), _packed(_bytes_of(key, KEY_BYTES)[order], ends)],
                    names=["part", "reps", "keys"],
                )

    return made


def _shared_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets (sorted arrays of representatives) with more than one member, of a partition that holds whole buckets."""
    keys, reps = [], []
    for batch in batches:
        for rep, key in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            n = len(key) // KEY_BYTES
            for data, out in ((key, keys), (rep, reps)):
                wide = np.zeros((n, 8), dtype=np.uint8)
                wide[:, : len(data) // n] = np.frombuffer(data, dtype=np.uint8).reshape(n, -1)
                out.append(wide.view(np.uint64 if out is keys else np.int64).ravel())
    if not keys:
        return
    key, rep = np.concatenate(keys), np.concatenate(reps)
    order = np.argsort(key, kind="stable")
    starts, sizes = _runs(key[order])
    many = np.flatnonzero(sizes > 1)
    for s in range(0, len(many), 50_000):
        part = many[s : s + 50_000]
        ends = np.concatenate([[0], np.cumsum(sizes[part])])
        within = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes[part])
        members = rep[order[np.repeat(starts[part], sizes[part]) + within]]
        members = members[np.lexsort((members, np.repeat(np.arange(len(part)), sizes[part])))]
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(members))], names=["members"])


def _links_of(ids: np.ndarray, fp: np.ndarray, accept: int) -> Iterator[tuple[int, int, int]]:
    """Links (a, b, distance) that join every pair of the bucket within `accept` in one tree: breadth-first search over
    the members not yet reached, which looks at each pair at most once."""
    left = np.arange(len(ids))
    queue: list[int] = []
    while len(left):
        here, left = (queue.pop(), left) if queue else (int(left[0]), left[1:])
        d = distance(fp[left], fp[here])
        near = d <= accept
        for j, dist in zip(left[near].tolist(), d[near].tolist()):
            yield int(ids[here]), int(ids[j]), dist
            queue.append(j)
        left = left[~near]


def _verify(accept: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rep, *f = _columns(batches, 2 + BLOCKS)
        fp = np.stack(f, axis=1).astype(np.int64).view(np.uint64) if len(rep) else np.zeros((0, BLOCKS), np.uint64)
        order = np.lexsort((rep, bucket))
        bucket, rep, fp = bucket[order], rep[order], fp[order]
        starts, sizes = _runs(bucket)
        two = starts[sizes == 2]
        d = distance(fp[two], fp[two + 1])
        found = {(int(a), int(b)): int(x) for a, b, x in zip(rep[two][d <= accept], rep[two + 1][d <= accept], d[d <= accept])}
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            for a, b, x in _links_of(rep[s : s + n], fp[s : s + n], accept):
                found[min(a, b), max(a, b)] = x
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(list(found.values()), pa.int32())], names=["a", "b", "bits"]
            )

    return links


def links(reps: DataFrame, radius: int = 5, accept: int = 40, samples: int = 128, held: int = 1 << 20) -> DataFrame:
    """(a, b, bits): distinct links between representatives whose fingerprints collide in a table and differ in at most
    `accept` bits; they connect every pair within the guaranteed BLOCKS * (radius + 1) - 1 bits. The number of partitions
    follows the number of table entries, about `held` in each."""
    count = reps.count()
    masks = table_masks(radius, samples, min(max(16, count.bit_length() + 6), BLOCKS * WIDTH))
    parts = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * len(masks) // held))
    entries = reps.select("rep", *_FP).mapInArrow(_entries(masks, parts), "part int, reps binary, keys binary")
    shared = entries.repartitionById(parts, F.col("part")).mapInArrow(_shared_buckets, "members array<bigint>").distinct()
    members = shared.select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("rep"))
    signed = members.join(reps, "rep").select("bucket", "rep", *_FP)
    return signed.repartition("bucket").mapInArrow(_verify(accept), "a bigint, b bigint, bits int").distinct()


SMALL = 64  # members of a bucket whose pairs are all compared


def _even_vectors(dims: int, width: int, seed: int, rounds: int = 4000) -> np.ndarray:
    """(tables, width): whether a table sees a position, for `width` vectors of GF(2)^dims. One at a time is exchanged where
    that brings the tables with the fewest bits, in which unrelated fingerprints pile up, closer to the others."""
    rng, n = np.random.default_rng(seed), 2**dims - 1
    sees = (np.bitwise_count(np.arange(1, n + 1)[:, None] & np.arange(1, n + 1)[None]) & 1).astype(np.int64)
    chosen = np.resize(rng.permutation(n), width)
    size = sees[:, chosen].sum(axis=1)
    cost = np.exp2(-size).sum()
    for at, new in zip(rng.integers(0, width, rounds).tolist(), rng.integers(0, n, rounds).tolist()):
        other = size - sees[:, chosen[at]] + sees[:, new]
        if (c := np.exp2(-other).sum()) < cost:
            chosen[at], size, cost = new, other, c
    return sees[:, chosen].astype(bool)


def exact_masks(accept: int, radius: int) -> np.ndarray:
    """(tables, 4) masks of which one at least sees no difference between any two fingerprints within `accept` bits."""
    n = -(-(accept + 1) // (radius + 1))
    radii = [(accept + 1) // n - 1 + (k < (accept + 1) % n) for k in range(n)]
    ends = np.round(np.cumsum([r + 1 for r in radii]) / (accept + 1) * BLOCKS * WIDTH).astype(int).tolist()
    masks = []
    for r, start, end in zip(radii, [0, *ends], ends):
        for table in _even_vectors(r + 1, end - start, seed=start):
            bits = np.zeros(BLOCKS * WIDTH, dtype=bool)
            bits[start:end] = table
            masks.append(np.packbits(bits, bitorder="little").view("<u8"))
    return np.array(masks, dtype=np.uint64)


def _large_bucket(at: np.ndarray, fp: np.ndarray, label: np.ndarray, accept: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Links (rows, rows, distances) that, with what the labels have joined, connect all pairs within `accept` of the rows
    `at`: breadth first, some reached rows against all not yet reached at a time."""
    left, queue = at, at[:0]
    while len(left):
        if not len(queue):
            mine = label[left] == label[left[0]]
            queue, left = left[mine], left[~mine]
            continue
        k = max(1, (1 << 18) // len(left))
        some, queue = queue[:k], queue[k:]
        d = distance(fp[some][:, None], fp[left][None])
        hit = np.flatnonzero((d <= accept).any(axis=0))
        if len(hit):
            of = (d[:, hit] <= accept).argmax(axis=0)
            yield some[of], left[hit], d[of, hit]
            reached = np.isin(label[left], label[left[hit]])
            queue, left = np.concatenate([queue, left[reached]]), left[~reached]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Joins the labels of linked rows; those of the links that form a tree with what was joined before."""
    while True:
        differ = label[a] != label[b]
        a, b, d = a[differ], b[differ], d[differ]
        if not len(a):
            return
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        _, first = np.unique(high, return_index=True)
        yield a[first], b[first], d[first]
        parent = np.arange(len(label), dtype=label.dtype)
        parent[high[first]] = low[first]
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label[:] = parent[label]


def near_pairs(fp: np.ndarray, masks: np.ndarray, accept: int, side: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Links (rows, rows, distances): a forest that connects every two fingerprints within `accept` bits that share a key in
    one of the tables. With `side`, the pairs of one side need not be connected."""
    n = len(fp)
    word = [np.ascontiguousarray(fp[:, k]) for k in range(BLOCKS)]
    number, label = np.arange(n, dtype=np.uint64), np.arange(n, dtype=np.int32)
    found = [(np.zeros(0, np.int64),) * 3]
    for mask in masks:
        with np.errstate(over="ignore"):
            key = sum((word[k] & mask[k]) * _MIX[k] for k in range(BLOCKS) if mask[k])
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        key = np.sort(key >> np.uint64(32) << np.uint64(32) | number)  # by key, then row: faster than argsort
        row, key = (key & np.uint64(0xFFFFFFFF)).astype(np.int64), (key >> np.uint64(32)).astype(np.uint32)
        same = np.zeros(n, dtype=bool)
        same[:-1] = key[1:] == key[:-1]
        starts, sizes = _runs(key)
        links = []
        for s, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            same[s : s + size] = False
            links += _large_bucket(row[s : s + size], fp, label, accept)
        at, step = np.flatnonzero(same), 1
        w0, w1 = word[0][row], word[1][row]
        while len(at):
            half = np.bitwise_count(w0[at] ^ w0[at + step]) + np.bitwise_count(w1[at] ^ w1[at + step])
            maybe = at[half <= accept]
            a, b = row[maybe], row[maybe + step]
            if side is not None:
                across = side[a] != side[b]
                a, b = a[across], b[across]
            d = distance(fp[a], fp[b])
            links.append((a[d <= accept], b[d <= accept], d[d <= accept]))
            step += 1
            at = at[same[at + step - 1]]  # equal so far, and the next one too
        if links:
            found += _joined(label, *map(np.concatenate, zip(*links)))
    return tuple(map(np.concatenate, zip(*found)))


def all_links(reps: DataFrame, radius: int = 6, accept: int = 40, held: int = 1 << 20) -> DataFrame:
    """(a, b, bits): links between representatives that connect every pair within `accept` bits, each of at most that many.

    `radius` is the largest of a block and `held` the number of fingerprints in a group; neither changes what is connected.
    Fingerprints go to as many tasks as there are groups, times the number of shares in which the tables are searched."""
    groups = max(1, -(-reps.count() // held))
    shares = -(-24 // groups)
    masks = exact_masks(accept, radius)
    pairs = {pair: k for k, pair in enumerate((i, j) for j in range(groups) for i in range(j + 1))}
    parts = [[pairs[min(g, h), max(g, h)] * shares + s for h in range(groups) for s in range(shares)] for g in range(groups)]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column(0).to_numpy().astype(np.int64)
            fp = np.stack([batch.column(1 + k).to_numpy() for k in range(BLOCKS)], axis=1).astype(np.int64)
            group = ((_spread(rep.view(np.uint64))[:, 0] >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
            rows = [(parts[g], g, rep[group == g].tobytes(), fp[group == g].tobytes()) for g in np.unique(group).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary()))] if rows else [pa.array([], t) for t in (pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())],
                names=["parts", "group", "reps", "fps"],
            )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_part: dict[int, list[tuple[int, bytes, bytes]]] = {}
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                of_part.setdefault(part, []).append(row)
        for part in list(of_part):
            group, rep, fp = zip(*of_part.pop(part))
            side = np.repeat(np.array(group, dtype=np.int32), [len(r) // 8 for r in rep])
            rep, fp = np.frombuffer(b"".join(rep), dtype=np.int64), np.frombuffer(b"".join(fp), dtype=np.uint64).reshape(-1, BLOCKS)
            i, j = list(pairs)[part // shares]
            if i != j and len(set(group)) == 1:
                continue  # nothing across
            a, b, d = near_pairs(fp, masks[part % shares :: shares], accept, side if i != j else None)
            a, b = rep[a], rep[b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d.astype(np.int32))], names=["a", "b", "bits"])

    packed = reps.select("rep", *_FP).mapInArrow(dealt, "parts array<int>, group int, reps binary, fps binary")
    tasks = packed.select(F.explode("parts").alias("part"), "group", "reps", "fps").repartitionById(len(pairs) * shares, F.col("part"))
    return tasks.mapInArrow(searched, "a bigint, b bigint, bits int").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest id reachable from each node of the undirected edges (a, b).

    Alternates large-star and small-star rounds, which converge in a logarithmic number of rounds whatever the length
    of chains; each round is written to the checkpoint folder. Raises if max_rounds aren't enough."""
    digest = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    star = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = digest(star)
    for _ in range(max_rounds):
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        star = cut(small)
        if (after := digest(star)) == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"connected components didn't settle in {max_rounds} rounds")


def _grouped(reps: DataFrame, radius: int, accept: int) -> DataFrame:
    """reps with group_id, the smallest rep of each one's connected component of pairs within `accept` bits."""
    root = components(all_links(reps, radius, accept))
    return reps.join(root, F.col("rep") == F.col("node"), "left").select(*reps.columns, F.coalesce("root", "rep").alias("group_id"))


def duplicates(docs: DataFrame, radius: int = 6, accept: int = 40) -> DataFrame:
    """(doc_id, group_id): every document with a text and the smallest doc_id of its near-duplicate group. Groups are the
    connected components of all pairs within `accept` bits; `radius` changes only how they are searched.

    Rows that share a doc_id are one document (its smallest fingerprint counts); rows with a null id or text are in no
    group and give no row; texts without words, the empty text among them, are duplicates only of equal texts; an empty
    table gives no rows. Only doc_id and text are read, so other columns don't matter."""
    signed = sign(docs).where("doc_id IS NOT NULL")
    signed = cut(signed.groupBy("doc_id").agg(F.min(F.struct(*_FP)).alias("f")).select("doc_id", *(f"f.{f}" for f in _FP)))
    reps = cut(signed.groupBy(*_FP).agg(F.min("doc_id").alias("rep")))
    named = _grouped(reps, radius, accept).select(*_FP, "group_id")
    return signed.join(named, _FP).select("doc_id", "group_id")


def _same(a: DataFrame, b: DataFrame) -> list:
    """Conditions under which rows have the same id, null ones too, and fingerprint."""
    return [a["doc_id"].eqNullSafe(b["_id"]), *(a[f] == b[f"_{f}"] for f in _FP)]


def keep_first(docs: DataFrame, radius: int = 6, accept: int = 40, null_ids: bool = False) -> DataFrame:
    """The rows of docs, all columns, but of each near-duplicate group only one: of the smallest doc_id, where that has
    several texts in the group of the smallest fingerprint, where that has several rows of the first as JSON. Groups are the
    connected components of all pairs of texts within `accept` bits.

    Texts count, not ids: each text of rows that share a doc_id is in a group of its own, and repeated rows are one. Rows
    with a null text stay, unless all texts of their doc_id go; rows with a null doc_id stay, but with `null_ids` they are in
    groups too, after all other ids.

    The ids to look at are written first: Spark then knows their size, sends them to all tasks if they are below its limit
    for broadcasts, and joins by a shuffle beyond it. Only rows of ids of which some rows stay and some go, and those with a
    null id, are signed again and shuffled."""
    signed = sign(docs) if null_ids else sign(docs).where("doc_id IS NOT NULL")
    signed = cut(signed.groupBy("doc_id", *_FP).agg(F.count("*").alias("n")))
    reps = cut(signed.groupBy(*_FP).agg(F.min("doc_id").alias("first")).withColumn("rep", F.monotonically_increasing_id()))
    best = F.min(F.struct(F.col("first").isNull().alias("last"), "first", *_FP)).alias("k")
    kept = _grouped(reps, radius, accept).groupBy("group_id").agg(best)
    kept = kept.select(F.col("k.first").alias("_id"), *(F.col(f"k.{f}").alias(f"_{f}") for f in _FP), F.lit(1).alias("_one"))
    # a row for each id of which not all rows stay
    ids = signed.join(kept, _same(signed, kept), "left").groupBy(F.col("doc_id").alias("_dropped"))
    ids = ids.agg(F.sum("n").alias("rows"), F.count("_one").alias("stay")).where("rows > stay")
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/dropped-{uuid.uuid4().hex}"
    ids.selectExpr("_dropped", "stay > 0 OR _dropped IS NULL AS _some").write.parquet(path)
    ids = docs.sparkSession.read.parquet(path)
    some = ids.where("_some")
    if some.isEmpty():
        return docs.join(ids, docs["doc_id"] == ids["_dropped"], "left_anti")
    rest = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_dropped"]), "left_anti")
    looked = docs.join(some, docs["doc_id"].eqNullSafe(some["_dropped"]), "left_semi")
    boxed = looked.select(F.struct("*").alias("row"))
    texts = _signed(boxed.where("row.text IS NOT NULL").select("row", "row.text"))
    texts = texts.withColumn("doc_id", F.col("row.doc_id").cast("bigint"))
    texts = texts.join(kept, _same(texts, kept))
    order = Window.partitionBy("doc_id", *_FP).orderBy(F.to_json("row"))
    one = texts.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("row.*")
    return rest.union(boxed.where("row.text IS NULL").select("row.*")).union(one)
