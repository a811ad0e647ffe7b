"""MinHash banding and the greedy first-come duplicate filter.

Two signatures: `native_signatures` uses 28-bit hashes, whose products fit 64 bits (comparable with SQL); `exact_band_keys` uses BLAKE2b and permutations modulo 2^61 - 1, vectorised with 31-bit limbs. All grams of a document are in its row, so both take the
minima there, in Arrow batches: no row for each gram, and no shuffle.

The filter keeps a document iff no earlier kept document shares a (band, key): dropped documents don't register their
keys, so of a chain A~B~C both A and C stay. As a set operation that is the lexicographically first maximal
independent set, reached by rounds of joins.
"""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.operators.lineage import cut

PERMUTATIONS, BANDS, GRAM, SEED = 64, 8, 5, 42
MERSENNE61, MERSENNE31 = (1 << 61) - 1, (1 << 31) - 1


def permutations(n: int = PERMUTATIONS, modulus: int = MERSENNE61, seed: int = SEED) -> list[tuple[int, int]]:
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        factor = draw.randrange(1, modulus)
        out.append((factor, draw.randrange(modulus)))
    return out


def gram_hashes28(text: str) -> np.ndarray:
    """The first 28 bits of the MD5 of each distinct gram."""
    grams = {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
    raw = b"".join([hashlib.md5(g.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()[:4] for g in grams])
    return np.frombuffer(raw, dtype=">u4").astype(np.int64) >> 4


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """np.unique by sorting, which is faster for short arrays."""
    x = np.sort(numbers)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def _gram_keys(text: str) -> np.ndarray:
    """A number for the gram that begins at each place of the text; equal grams have equal numbers."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    seen = np.zeros(0x110000, dtype=bool)
    seen[points] = True
    codes = (np.cumsum(seen, dtype=np.uint64) - np.uint64(1))[points]
    bits, grams = max(1, int(seen.sum() - 1).bit_length()), len(points) - GRAM + 1
    joined = lambda own, parts: sum((c[:grams] << np.uint64(bits * k) for k, c in enumerate(parts)), own)
    at = [codes[k:] for k in range(GRAM)]
    if GRAM * bits <= 64:
        return joined(np.uint64(0), at)
    head = np.unique(joined(np.uint64(0), at[:3]), return_inverse=True)[1].astype(np.uint64)  # 63 bits at most, numbered anew
    return joined(head << np.uint64((GRAM - 3) * bits), at[3:])


def _minima(texts: list[str], hashed: Callable[[str, np.ndarray], np.ndarray], permuted: Callable[[np.ndarray, slice], np.ndarray], n: int, block: int = 1 << 21, cells: int = 1 << 23) -> np.ndarray:
    """(texts, n): minima of the permuted hashes of each text's grams; zeros for a text without one.

    Texts are taken together, and pieces of long ones, up to `block` grams or so: most grams of a text are in others
    too, and each is hashed and permuted once for all, as many permutations at a time as `cells` have room for.
    hashed: the hashes of a text's grams at these places; permuted: a row for each hash, a column for each permutation."""
    out = np.full((len(texts), n), np.iinfo(np.uint64).max, dtype=np.uint64)
    out[[len(t) < GRAM for t in texts]] = 0
    held: list[tuple[int, str]] = []

    def settle() -> None:
        whole, ends = "".join(p for _, p in held), np.cumsum([len(p) for _, p in held])
        keys = _gram_keys(whole)
        real = np.ones(len(keys), dtype=bool)
        for k in range(1, GRAM):  # a gram doesn't go on in the next text
            real[ends[:-1] - k] = False
        place = np.flatnonzero(real)
        order = np.argsort(keys[place])
        ranked = keys[place][order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        number = np.empty(len(place), dtype=np.int32)
        number[order] = np.cumsum(new) - 1
        hashes = hashed(whole, place[order[new]])
        width = max(1, min(n, cells // len(hashes)))
        starts = np.searchsorted(place, ends - [len(p) for _, p in held]).tolist() + [len(place)]
        own = [_distinct(number[s:e]) for s, e in zip(starts, starts[1:])]
        for k in range(0, n, width):
            table = permuted(hashes, slice(k, k + width))
            for (row, _), grams in zip(held, own):
                out[row, k : k + width] = np.minimum(out[row, k : k + width], table.take(grams, axis=0).min(axis=0))
        held.clear()

    size = 0
    for row, text in enumerate(texts):
        for s in range(0, len(text) - GRAM + 1, block):
            held.append((row, text[s : s + block + GRAM - 1]))
            if (size := size + len(held[-1][1])) >= block:
                settle()
                size = 0
    if held:
        settle()
    return out


_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]


def _md5_word(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The first word of the MD5 of messages of one block: words (6, n) of the padded message, the others are zero but
    the length in bits."""
    start = [np.full(words.shape[1], v, dtype=np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += np.uint32(_SINES[i])
        if g < len(words):
            f += words[g]
        elif g == 14:
            f += bits
        turned = f << np.uint32(_TURNS[i])
        turned |= f >> np.uint32(32 - _TURNS[i])
        turned += b
        a, b, c, d = d, turned, b, c
    return a + start[0]


def md5_grams28(text: str, places: np.ndarray) -> np.ndarray:
    """The first 28 bits of the MD5 of the grams at these places; a gram has at most 20 bytes, so all advance together."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    offset = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    raw, out = np.append(raw, np.zeros(24, np.uint8)), np.empty(len(places), dtype=np.uint64)
    for s in range(0, len(places), 4096):
        begin = offset[places[s : s + 4096]]
        size = offset[places[s : s + 4096] + GRAM] - begin
        message = raw[begin[:, None] + np.arange(24)]
        message[np.arange(24) >= size[:, None]] = 0
        message[np.arange(len(size)), size] = 0x80
        words = np.ascontiguousarray(message.view("<u4").T, dtype=np.uint32)
        out[s : s + 4096] = _md5_word(words, (size * 8).astype(np.uint32)).byteswap() >> np.uint32(4)
    return out


def signatures28(texts: list[str], n: int = PERMUTATIONS) -> np.ndarray:
    """Minima of (a * h + b) mod 2^31 - 1 over the first 28 bits of the MD5 of the grams."""
    factor, shift = np.array(permutations(n, MERSENNE31), dtype=np.uint64).T

    def permuted(h: np.ndarray, some: slice) -> np.ndarray:
        return np.concatenate([reduced(h[s : s + 1024, None] * factor[some] + shift[some]) for s in range(0, len(h), 1024)])

    def reduced(x: np.ndarray) -> np.ndarray:
        x = ((x & np.uint64(MERSENNE31)) + (x >> np.uint64(31))).astype(np.uint32)  # 2^31 counts as 1; below twice the modulus
        return np.minimum(x, x - np.uint32(MERSENNE31))  # below the modulus the difference wraps round to a larger number

    return _minima(texts, md5_grams28, permuted, n)


def exact_signatures(texts: list[str], perms: list[tuple[int, int]]) -> np.ndarray:
    """`exact_signature` of each text."""

    def hashed(text: str, places: np.ndarray) -> np.ndarray:
        raw = [short_digest(text[i : i + GRAM].encode("utf-8", "surrogatepass")) for i in places.tolist()]
        return np.frombuffer(b"".join(raw), dtype="<u8") % np.uint64(MERSENNE61)

    def permuted(h: np.ndarray, some: slice) -> np.ndarray:
        out = np.empty((len(h), len(perms[some])), dtype=np.uint64)
        for s in range(0, len(h), 4096):
            high, low = h[s : s + 4096] >> np.uint64(31), h[s : s + 4096] & np.uint64(MERSENNE31)
            for i, (a, b) in enumerate(perms[some]):
                out[s : s + 4096, i] = affine61(a, b, high, low)
        return out

    return _minima(texts, hashed, permuted, len(perms))


def native_signatures(docs: DataFrame, n: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, h0..hn-1) for every row: minima of (a * h + b) mod 2^31 - 1 over the 28-bit hashes of the text's distinct
    5-grams; zeros for texts without a gram (null ones among them), which so are duplicates of each other."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                found = signatures28([t or "" for t in part.column(1).to_pylist()], n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[:, i]) for i in range(n))], names=["doc_id", *(f"h{i}" for i in range(n))])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"h{i} bigint" for i in range(n))
    return docs.select("doc_id", "text").mapInArrow(signed, schema)


def native_bands(signatures: DataFrame, bands: int = BANDS, n: int = PERMUTATIONS) -> DataFrame:
    """(doc_id, band, key): the MD5 of each band's rows."""
    rows = n // bands
    keys = [F.struct(F.lit(b).alias("band"), F.md5(F.concat_ws(",", *(f"h{i}" for i in range(b * rows, (b + 1) * rows)))).alias("key")) for b in range(bands)]
    return signatures.select("doc_id", F.explode(F.array(*keys)).alias("k")).select("doc_id", "k.band", "k.key")


def affine61(a: int, b: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(a * h + b) mod 2^61 - 1 for h = high * 2^31 + low, both uint64 and h below the modulus. With a split the same way
    the product is high parts * 2^62, mixed parts * 2^31 and low parts; 2^61 counts as 1, so no sum passes 2^64."""
    p, a_high, a_low = np.uint64(MERSENNE61), np.uint64(a >> 31), np.uint64(a & MERSENNE31)
    mixed = a_high * low + a_low * high
    x = ((a_high * high) << np.uint64(1)) + (mixed >> np.uint64(30)) + ((mixed & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a_low * low + np.uint64(b)
    x = (x & p) + (x >> np.uint64(61))
    return np.where(x >= p, x - p, x)


def short_digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def exact_signature(text: str, perms: list[tuple[int, int]]) -> list[int]:
    """Minima of (a * h + b) mod 2^61 - 1 over the hashes of the distinct grams; zeros for a text without one."""
    starts = range(max(0, len(text) - GRAM + 1))
    grams = set(map(lambda s: text[s : s + GRAM], starts))
    if not grams:
        return [0] * len(perms)
    raw = b"".join(short_digest(g.encode("utf-8", "surrogatepass")) for g in grams)
    h = np.frombuffer(raw, dtype="<u8") % np.uint64(MERSENNE61)
    high, low = h >> np.uint64(31), h & np.uint64(MERSENNE31)
    return [int(affine61(a, b, high, low).min()) for a, b in perms]


def exact_band_keys(docs: DataFrame, bands: int = BANDS, n: int = PERMUTATIONS, prefix: int | None = None) -> DataFrame:
    """(doc_id, band, key) with 8-byte BLAKE2b keys; `prefix` signs only that many characters (None: whole texts)."""
    perms, rows = permutations(n), n // bands

    @F.pandas_udf("array<binary>")
    def keys(texts):
        import pandas as pd

        signed = exact_signatures([t[:prefix] for t in texts], perms).tolist()
        return pd.Series([[short_digest(repr(s[at : at + rows]).encode()) for at in range(0, len(s), rows)] for s in signed])

    return docs.where("text IS NOT NULL").select("doc_id", F.posexplode(keys("text")).alias("band", "key"))


def greedy_keep(bands: DataFrame, order: str = "doc_id", max_rounds: int = 50) -> DataFrame:
    """The `order` values that the first-come filter keeps, from (order, band, key) rows of all documents.

    A round keeps the undecided documents that come first in all their buckets and drops those that share a bucket with
    one of them. Documents alone in all their buckets are decided in the first round; raises if max_rounds aren't
    enough, which takes a chain of that length."""
    left = cut(bands.select(F.col(order).alias("d"), "band", "key").distinct())
    kept = None
    for _ in range(max_rounds):
        first = left.groupBy("band", "key").agg(F.min("d").alias("m"))
        won = left.join(first, ["band", "key"]).groupBy("d").agg(F.every(F.col("d") == F.col("m")).alias("w")).where("w").select("d")
        won = cut(won)
        kept = won if kept is None else kept.unionByName(won)
        gone = left.join(left.join(won, "d", "left_semi").select("band", "key").distinct(), ["band", "key"], "left_semi").select("d").distinct()
        left = cut(left.join(gone, "d", "left_anti"))
        if left.isEmpty():
            return kept.select(F.col("d").alias(order))
    raise RuntimeError(f"undecided documents are left after {max_rounds} rounds")
