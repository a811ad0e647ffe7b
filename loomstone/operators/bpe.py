"""Byte-level BPE: pretokens, counts, merges, encoding and decoding.

Ids 0-255 are bytes, 256 + r is the merge of rank r, special tokens follow. Counting pretokens is one Spark
aggregation. Every merge depends on the one before: few distinct pretokens are merged on the driver; many stay in the
cluster, and the driver has the totals of pairs only. Encoding runs in batches, once for each distinct pretoken in memory.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL = tuple(f"<|{name}|>" for name in ("bos", "eos", "pad", "im_start", "im_end"))
Pair = tuple[int, int]

_WORD_WITH_LEAD = r"[^\p{N}\p{L}\n\r]?+\p{L}+"
_SUFFIX = "'(?i:ll|re|ve|[dmst])"
_SYMBOLS = r"[ ]?[^\p{N}\p{L}\s]++[\n\r]*"
_BLANKS = (r"\s*[\n\r]", r"\s+(?!\S)", r"\s+")
#: Contraction suffixes, words with one leading sign or space, up to three digits, symbol runs, white space.
PRETOKEN = "|".join((_SUFFIX, _WORD_WITH_LEAD, r"\p{N}{1,3}", _SYMBOLS, *_BLANKS))
_compiled = regex.compile(PRETOKEN)


def pretokenize(text: str) -> list[str]:
    return _compiled.findall(text)


def pretokens(text: str = "text"):
    """The same chunks as a Spark array; the Java pattern needs Unicode classes switched on."""
    return F.regexp_extract_all(F.col(text), F.lit("(?U)" + PRETOKEN), F.lit(0))


def pretoken_counts(docs: DataFrame) -> DataFrame:
    """(chunk, cnt) with map-side partial counts."""
    return docs.select(F.explode(pretokens()).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("cnt"))


def _pairs(counts: DataFrame, distinct: bool) -> DataFrame:
    """(a, b, n) summed over each task's chunks: adjacent bytes, weighted by the chunk's count or once for each chunk."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                raw = [c.encode("utf-8", "surrogatepass") for c in part.column(0).to_pylist()]
                size = np.fromiter(map(len, raw), np.int64, len(raw))
                data, chunk = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64), np.repeat(np.arange(len(raw)), size)
                same = chunk[1:] == chunk[:-1]
                pair, chunk = (data[:-1] * 256 + data[1:])[same], chunk[1:][same]
                if distinct:
                    total += np.bincount(np.unique(chunk * 65536 + pair) % 65536, minlength=1 << 16)
                else:
                    np.add.at(total, pair, part.column(1).to_numpy()[chunk])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((seen // 256).astype(np.int32)), pa.array((seen % 256).astype(np.int32)), pa.array(total[seen])], names=["a", "b", "n"])

    return counts.where("chunk IS NOT NULL").select("chunk", "cnt").mapInArrow(added, "a int, b int, n bigint")


def pair_counts(counts: DataFrame) -> DataFrame:
    """(a, b, cnt): adjacent bytes of the chunks, overlapping occurrences counted, weighted by the chunk's count. A task
    adds its chunks up before the shuffle, so no more than 65,536 rows leave it."""
    return _pairs(counts, distinct=False).groupBy("a", "b").agg(F.sum("n").alias("cnt"))


def pair_index(counts: DataFrame) -> DataFrame:
    """(a, b, words): how many distinct chunks hold each pair, the inverted index by size."""
    return _pairs(counts, distinct=True).groupBy("a", "b").agg(F.sum("n").alias("words"))


@dataclass
class Bpe:
    merges: list[tuple[int, int]]
    special: tuple[str, ...] = SPECIAL
    _memo: dict[bytes, list[int]] = field(default_factory=dict, repr=False)

    @cached_property
    def vocab(self) -> list[bytes]:
        out = [bytes((i,)) for i in range(256)]
        for left, right in self.merges:
            out.append(out[left] + out[right])
        return out + [s.encode() for s in self.special]

    @cached_property
    def rank(self) -> dict[tuple[int, int], int]:
        return {pair: r for r, pair in enumerate(self.merges)}

    @cached_property
    def special_ids(self) -> dict[str, int]:
        return {s: 256 + len(self.merges) + i for i, s in enumerate(self.special)}

    @property
    def size(self) -> int:
        return len(self.vocab)

    def encode_chunk(self, chunk: bytes) -> list[int]:
        """Applies the lowest-ranked pair everywhere, again and again."""
        if (known := self._memo.get(chunk)) is not None:
            return known
        ids = list(chunk)
        while len(ids) > 1:
            r = min((self.rank.get(p, len(self.merges)) for p in zip(ids, ids[1:])))
            if r == len(self.merges):
                break
            ids = replace_pair(ids, self.merges[r], 256 + r)
        if len(self._memo) < 1 << 18:
            self._memo[chunk] = ids
        return ids

    def encode(self, text: str, allow_special: bool = False) -> list[int]:
        """Special strings become control ids only where allowed, even if the whole text is one."""
        plain = lambda t: [i for c in pretokenize(t) for i in self.encode_chunk(c.encode("utf-8", "surrogatepass"))]
        if not (allow_special and self.special):
            return plain(text)
        found, at = [], 0
        for hit in regex.finditer("|".join(map(regex.escape, self.special)), text):
            found += plain(text[at : hit.start()]) + [self.special_ids[hit.group()]]
            at = hit.end()
        return found + plain(text[at:])

    def decode(self, tokens: list[int]) -> str:
        """Malformed bytes become U+FFFD; an unknown id is an error."""
        return str(b"".join(self.vocab[i] for i in tokens), "utf-8", "replace")

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({"special": self.special, "merges": self.merges}), "utf-8")

    @classmethod
    def load(cls, path: str) -> Bpe:
        held = json.loads(Path(path).read_text("utf-8"))
        return cls([(a, b) for a, b in held["merges"]], tuple(held["special"]))


def replace_pair(ids: list[int], pair: tuple[int, int], new: int) -> list[int]:
    """Left to right, without overlaps."""
    out: list[int] = []
    skip = False
    for here, after in zip(ids, [*ids[1:], -1]):
        if skip:
            skip = False
        elif (here, after) == pair:
            out.append(new)
            skip = True
        else:
            out.append(here)
    return out


def learn(counts: dict[str, int], vocab_size: int, special: tuple[str, ...] = SPECIAL) -> Bpe:
    """Merges the most frequent pair (ties: the smallest) until the vocabulary is full or no pair is left.

    Totals are kept up to date for the chunks that hold the merged pair only."""
    room = vocab_size - 256 - len(special)
    if room <= 0:
        raise ValueError("vocab_size leaves no room for merges")
    chunks = [(list(c.encode("utf-8", "surrogatepass")), n) for c, n in counts.items()]
    total: dict[Pair, int] = defaultdict(int)
    holders: dict[Pair, set] = defaultdict(set)

    def add(i: int, sign: int) -> set[Pair]:
        ids, n = chunks[i]
        pairs = list(zip(ids, ids[1:]))
        for p in pairs:
            total[p] += sign * n
            holders[p].add(i)
        return set(pairs)

    for i in range(len(chunks)):
        add(i, 1)
    queue = [(-n, p) for p, n in total.items()]
    heapq.heapify(queue)
    merges: list[Pair] = []
    while queue and room > len(merges):
        count, pair = heapq.heappop(queue)
        if total[pair] != -count or not count:
            continue
        new = 256 + len(merges)
        merges.append(pair)
        touched: set[Pair] = set()
        for i in holders.pop(pair):
            if pair not in zip(chunks[i][0], chunks[i][0][1:]):
                continue
            touched |= add(i, -1)
            chunks[i] = (replace_pair(chunks[i][0], pair, new), chunks[i][1])
            touched |= add(i, 1)
        for p in touched:
            if total[p] > 0:
                heapq.heappush(queue, (-total[p], p))
    return Bpe(merges, special)


def train(docs: DataFrame, vocab_size: int, special: tuple[str, ...] = SPECIAL, max_local: int = 200_000) -> Bpe:
    """Learns from the distinct pretokens of all documents and their counts. Up to `max_local` of them are learned on the
    driver; more stay in the cluster (`learn_spread`), with the same merges."""
    from loomstone.operators.lineage import cut

    counts = cut(pretoken_counts(docs))
    if counts.count() > max_local:
        return learn_spread(counts, vocab_size, special)
    return learn({r["chunk"]: r["cnt"] for r in counts.toLocalIterator()}, vocab_size, special)


def _packed(chunks: list[bytes], kind: type) -> np.ndarray:
    """The chunks' bytes, the largest number of the type before, between and after them."""
    size = np.fromiter(map(len, chunks), np.int64, len(chunks))
    out = np.full(int(size.sum()) + len(size) + 1, np.iinfo(kind).max, dtype=kind)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(1, len(size) + 1), size)] = np.frombuffer(b"".join(chunks), dtype=np.uint8)
    return out


def _blocks(counts: DataFrame, kind: type, least: int = 1 << 20) -> DataFrame:
    """(ids, n): packed chunks and their counts, a row for every `least` symbols or so. Chunks of one byte hold no pair."""

    def row(raw: list[bytes], n: list[np.ndarray]) -> pa.RecordBatch:
        ids, cnt = _packed(raw, kind).tobytes(), np.concatenate(n).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([cnt], pa.binary())], names=["ids", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, n, held = [], [], 0
        for batch in batches:
            some = [c.encode("utf-8", "surrogatepass") for c in batch.column(0).to_pylist()]
            raw, n, held = raw + some, [*n, batch.column(1).to_numpy()], held + sum(map(len, some))
            if held >= least:
                yield row(raw, n)
                raw, n, held = [], [], 0
        if raw:
            yield row(raw, n)

    return counts.where("octet_length(chunk) > 1").select("chunk", F.col("cnt").cast("bigint")).mapInArrow(packed, "ids binary, n binary")


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    out = np.zeros(len(found), dtype=np.int64)
    np.add.at(out, at, n)
    return found[out != 0], out[out != 0]


def _weights(ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of the pairs that begin at these places, once each; pairs across the ends of chunks are none."""
    end, at = np.iinfo(ids.dtype).max, np.unique(at)
    at = at[(ids[at] != end) & (ids[at + 1] != end)]
    return ids[at].astype(np.int64) << 32 | ids[at + 1], n[np.searchsorted(np.flatnonzero(ids == end), at) - 1]


def merge_packed(ids: np.ndarray, n: np.ndarray, pair: Pair, new: int, count: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed chunks after a merge, and by how much each pair's total changes: keys (left << 32 | right) and sums."""
    none = np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(ids == pair[0])
    at = at[ids[at + 1] == pair[1]]
    if not len(at):
        return ids, none, none
    if pair[0] == pair[1]:  # every second of a run, from the left
        start = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        at = at[(at - np.repeat(at[start], np.diff(start, append=len(at)))) % 2 == 0]
    keep = np.ones(len(ids), dtype=bool)
    keep[at + 1] = False
    out = ids.copy()
    out[at] = new
    out = out[keep]
    if not count:
        return out, none, none
    old, less = _weights(ids, n, np.concatenate([at - 1, at, at + 1]))
    there = at - np.arange(len(at))
    now, more = _weights(out, n, np.concatenate([there - 1, there]))
    return out, *_summed(np.concatenate([old, now]), np.concatenate([-less, more]))


class _Totals:
    """Totals of pairs by key; the most frequent one (ties: the smallest) is at hand."""

    def __init__(self, total: dict[int, int], queue: list[tuple[int, int]] | None = None):
        self.total, self.queue = total, queue or [(-n, k) for k, n in total.items()]
        if queue is None:
            heapq.heapify(self.queue)

    def copy(self) -> _Totals:
        return _Totals(dict(self.total), list(self.queue))

    def best(self) -> int | None:
        while self.queue and self.total.get(self.queue[0][1]) != -self.queue[0][0]:
            heapq.heappop(self.queue)
        return self.queue[0][1] if self.queue else None

    def add(self, keys: np.ndarray, change: np.ndarray) -> None:
        for k, c in zip(keys.tolist(), change.tolist()):
            if (n := self.total.pop(k, 0) + c) > 0:
                self.total[k] = n
                heapq.heappush(self.queue, (-n, k))


def learn_spread(counts: DataFrame, vocab_size: int, special: tuple[str, ...] = SPECIAL, sample: int = 400_000, most: int = 48) -> Bpe:
    """`learn` with the chunks in the cluster: (chunk, cnt) rows, read more than once, so cut before.

    The driver has the totals of pairs, whose number the vocabulary bounds, and a sample of chunks (about `sample`, by
    count). It guesses the next merges from the sample; a job makes them over all chunks and gives the exact change of
    every total after each; as many of them stand as are the most frequent pair by exact totals. A poor guess costs
    time only: the first merge of a job is always exact."""
    from loomstone.operators.lineage import cut

    room = vocab_size - 256 - len(special)
    if room <= 0:
        raise ValueError("vocab_size leaves no room for merges")
    kind = np.uint16 if vocab_size < 1 << 16 else np.uint32
    unpack = lambda row: (np.frombuffer(row["ids"], dtype=kind), np.frombuffer(row["n"], dtype=np.int64))
    pair = lambda key: (key >> 32, key & 0xFFFFFFFF)
    blocks = cut(_blocks(counts, kind))
    total = _Totals({r["a"] << 32 | r["b"]: r["cnt"] for r in pair_counts(counts).toLocalIterator()})
    each = max(1, (counts.agg(F.sum("cnt")).first()[0] or 0) // sample)  # a chunk is drawn once for each so many occurrences, on average
    drawn = counts.where(F.pmod(F.xxhash64("chunk"), F.lit(each)) < F.col("cnt")).select("chunk", F.greatest("cnt", F.lit(each)).alias("cnt"))
    state = [unpack(r) for r in _blocks(drawn, kind).toLocalIterator()]
    merges: list[Pair] = []
    written, ahead_for = 0, 16

    def changes(done: list[Pair], ahead: list[Pair], first: int):
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ahead]
            for batch in batches:
                for row in batch.to_pylist():
                    ids, n = unpack(row)
                    for i, p in enumerate(done):
                        ids, _, _ = merge_packed(ids, n, p, first + i, count=False)
                    for i, p in enumerate(ahead):
                        ids, keys, change = merge_packed(ids, n, p, first + len(done) + i)
                        sums[i] = _summed(np.concatenate([sums[i][0], keys]), np.concatenate([sums[i][1], change]))
            step = np.repeat(np.arange(len(ahead)), [len(k) for k, _ in sums])
            yield pa.RecordBatch.from_arrays([pa.array(step), *(pa.array(np.concatenate(x)) for x in zip(*sums))], names=["step", "pair", "n"])

        return found

    def made(done: list[Pair], first: int):
        def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids, n = unpack(row)
                    for i, p in enumerate(done):
                        ids, _, _ = merge_packed(ids, n, p, first + i, count=False)
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([row["n"]], pa.binary())], names=["ids", "n"])

        return after

    while len(merges) < room and total.best() is not None:
        if len(merges) - written >= most // 2:
            blocks, written = cut(blocks.mapInArrow(made(merges[written:], 256 + written), "ids binary, n binary")), len(merges)
        guess, ahead, states = total.copy(), [], [state]
        while len(ahead) < min(ahead_for, room - len(merges)) and (key := guess.best()) is not None:
            ahead.append(pair(key))
            after = [(ids, n, *merge_packed(ids, n, ahead[-1], 255 + len(merges) + len(ahead))) for ids, n in states[-1]]
            states.append([(ids, n) for _, n, ids, _, _ in after])
            for _, _, _, keys, change in after:
                guess.add(keys, change)
            guess.total.pop(key, None)
        rows = blocks.mapInArrow(changes(merges[written:], ahead, 256 + written), "step bigint, pair bigint, n bigint")
        exact = rows.groupBy("step", "pair").agg(F.sum("n").alias("n")).toArrow()
        step, keys, change = (exact.column(i).to_numpy() for i in range(3))
        stood = 0
        for i, p in enumerate(ahead):
            if total.best() != p[0] << 32 | p[1]:
                break
            merges.append(p)
            total.add(keys[step == i], change[step == i])
            stood += 1
        state, ahead_for = states[stood], min(most, max(4, stood + stood // 2 + 2))
    return Bpe(merges, special)


def encode_documents(docs: DataFrame, bpe: Bpe, key: str = "doc_id", eos: bool = True) -> DataFrame:
    """(key, ids): whole texts, the end id appended. Each distinct chunk of a batch is encoded once (memoised)."""
    end = [bpe.special_ids["<|eos|>"]] if eos else []
    held = docs.sparkSession.sparkContext.broadcast(Bpe(bpe.merges, bpe.special))  # bounded by the vocabulary

    @F.pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        return pd.Series([held.value.encode(t) + end for t in texts])

    return docs.where("text IS NOT NULL").select(key, ids("text").alias("ids"))


def decode_documents(encoded: DataFrame, bpe: Bpe, key: str = "doc_id") -> DataFrame:
    """(key, text) by looking ids up in the vocabulary table, in the JVM: explode, broadcast join, ordered concat."""
    vocab = encoded.sparkSession.createDataFrame([(i, bytearray(b)) for i, b in enumerate(bpe.vocab)], "id int, raw binary")
    found = encoded.select(key, F.posexplode("ids").alias("pos", "id")).join(F.broadcast(vocab), "id")
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("raw").alias("x")))).alias("p"))
    raw = F.unhex(F.array_join(F.transform("p", lambda e: e["x"]), ""))
    return lists.select(key, F.make_valid_utf8(raw.cast("string")).alias("text"))
