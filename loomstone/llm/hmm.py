"""Language-model scoring with a hidden Markov model over words.

Vocabulary: all words of all documents are counted; the `vocabulary` most frequent are symbols of their own, the others
share `buckets` hashed symbols. A bucket's probability in a state is spread over its words by their counts in the corpus,
so every word has an emission of its own: P(word | state) = P(bucket | state) * n(word) / n(bucket). The last factor is
the same in all states, so it takes no part in training and adds ln(n(word) / n(bucket)) to a text's likelihood for each
such word; it comes from the table of all counts, joined by word. Training: Baum-Welch. In each round every partition runs the scaled forward-backward
recursion over all its words and sends expected counts (starts, transitions, emissions); they are added up by block
across partitions and normalised on the driver, where the model's size doesn't depend on the corpus. Scoring: the scaled
forward recursion over the whole text gives the exact log likelihood of its words.

Sequences are sorted by length and advance together, so each step is one matrix product for many texts. Of a text
longer than a block (`block` in scoring, `stretch` in training), the blocks advance in parallel from every possible
previous state, which gives the matrix that takes the states before a block to those at its end. Chained from the left,
these matrices give the states before each block, from the right the weight of all that follows it. So likelihoods and
expected counts are those of the plain recursion over the whole text: starts are counted at starts of texts only, and
transitions across borders of blocks like any other.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import cut, slices


@dataclass
class Hmm:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states), rows sum to 1
    emit: np.ndarray  # (states, symbols), rows sum to 1


@dataclass
class Words:
    """Symbols of words: index in `known`, or a bucket after them by the CRC-32 of the word."""

    known: dict[str, int]
    buckets: int

    @property
    def size(self) -> int:
        return len(self.known) + self.buckets

    def bucket(self, word: str) -> int:
        return zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.buckets

    def symbols(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        get, n = self.known.get, len(self.known)
        found = [get(w, -1) for w in words]
        out = np.array(found, dtype=np.int64)
        for i in np.flatnonzero(out < 0).tolist():
            out[i] = n + self.bucket(words[i])
        return out.astype(np.uint16)

    def numbered(self, text: str | None, numbers: dict[str, int], of: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """symbols(), and of each word in a bucket its number in `numbers`. New words get the next numbers; `of` has
        their symbols."""
        words = (text or "").split()
        out = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(out < 0)
        rare = np.empty(len(at), dtype=np.uint32)
        for k, i in enumerate(at.tolist()):
            w = words[i]
            if (number := numbers.get(w)) is None:
                number = numbers[w] = len(of)
                of.append(len(self.known) + self.bucket(w))
            rare[k] = number
            out[i] = of[number]
        return out.astype(np.uint16), rare


def word_counts(docs: DataFrame, held: int = 200_000) -> DataFrame:
    """(word, n) over all documents. A task adds up words in a table of at most `held` and sends it when full."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.string()), pa.array(tally.values(), pa.int64())], names=["word", "n"])
            tally.clear()
            return batch

        for batch in slices(batches, 0, 2 << 20):
            for text in batch.column(0).to_pylist():
                tally.update(text.split())
            if len(tally) > held:
                yield flush()
        yield flush()

    parts = docs.select("text").where("text IS NOT NULL").mapInArrow(counted, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def top_words(counts: DataFrame, vocabulary: int) -> list[tuple[str, int]]:
    """The `vocabulary` most frequent words, ties by word. The count of the last of them is found first, from the
    distinct counts, of which there are few; then only words with at least that count are sorted and sent. (A plain
    sorted limit would send that many words from every partition.)"""
    enough, least = 0, 1
    for row in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(vocabulary).toLocalIterator():
        enough, least = enough + row["words"], row["n"]
        if enough >= vocabulary:
            break
    return [(r["word"], r["n"]) for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(vocabulary).collect()]


def learn_words(docs: DataFrame, vocabulary: int, buckets: int) -> tuple[Words, np.ndarray]:
    """The most frequent words and their counts; the counts of all words are written once to the shared folder."""
    return frequent(cut(word_counts(docs)), vocabulary, buckets)


def frequent(counts: DataFrame, vocabulary: int, buckets: int) -> tuple[Words, np.ndarray]:
    """The most frequent words of (word, n) and their counts."""
    if vocabulary + buckets > 1 << 16:
        raise ValueError("symbols must fit 16 bits")
    top = top_words(counts, vocabulary)
    return Words({w: i for i, (w, _) in enumerate(top)}, buckets), np.array([n for _, n in top], dtype=np.float64)


def encode(docs: DataFrame, words: Words) -> DataFrame:
    """(doc_id, n_words, symbols) with the symbols of whole texts as packed 16-bit integers."""
    model = docs.sparkSession.sparkContext.broadcast(words)  # bounded by the vocabulary size

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = [model.value.symbols(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, rows), pa.int64()), pa.array((r.tobytes() for r in rows), pa.binary())],
                names=["doc_id", "n_words", "symbols"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encoded, "doc_id bigint, n_words bigint, symbols binary")


def bucket_shares(counts: DataFrame, words: Words) -> DataFrame:
    """(word, share) for every word of (word, n) that is in a bucket: ln(n(word) / n(bucket))."""
    model = counts.sparkSession.sparkContext.broadcast(words)

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, model.value.bucket(w), n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w not in model.value.known]
            if rows:
                w, b, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(b, pa.int32()), pa.array(n, pa.int64())], names=["word", "bucket", "n"])

    rare = counts.select("word", "n").mapInArrow(bucketed, "word string, bucket int, n bigint")
    total = [1] * words.buckets
    for r in rare.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        total[r["bucket"]] = r["n"]
    of_bucket = F.element_at(F.lit(total).cast("array<double>"), F.col("bucket") + 1)
    return rare.select("word", F.log(F.col("n").cast("double") / of_bucket).alias("share"))


def encode_words(docs: DataFrame, words: Words, chunk_bytes: int = 32 << 20) -> DataFrame:
    """encode() with what the shares of the words in buckets need: (doc_id, n_words, symbols, chunk, base, fresh, rare).

    Texts that follow each other in a partition are a chunk, which numbers its words in buckets; `rare` has their numbers
    as packed 32-bit integers, `fresh` the words that come first in this text, numbered from `base`."""
    model = docs.sparkSession.sparkContext.broadcast(words)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 32, 0
        numbers: dict[str, int] = {}
        of: list[int] = []
        for batch in slices(batches, 1):
            rows, base, fresh = [], [], []
            for text in batch.column(1).to_pylist():
                if held > chunk_bytes:
                    chunk, held, numbers, of = chunk + 1, 0, {}, []
                held += len(text or "")
                base.append(len(of))
                rows.append((chunk, *model.value.numbered(text, numbers, of)))
                fresh.append(list(islice(reversed(numbers), len(of) - base[-1]))[::-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array((len(s) for _, s, _ in rows), pa.int64()), pa.array((s.tobytes() for _, s, _ in rows), pa.binary()),
                    pa.array((c for c, _, _ in rows), pa.int64()), pa.array(base, pa.int64()), pa.array(fresh, pa.list_(pa.string())), pa.array((r.tobytes() for _, _, r in rows), pa.binary()),
                ],
                names=["doc_id", "n_words", "symbols", "chunk", "base", "fresh", "rare"],
            )

    schema = "doc_id bigint, n_words bigint, symbols binary, chunk bigint, base bigint, fresh array<string>, rare binary"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encoded, schema)


def initial(words: Words, counts: np.ndarray, total: float, states: int, seed: int) -> Hmm:
    """Each state emits by the corpus's word frequencies, disturbed at random; states prefer to stay."""
    rng = np.random.default_rng(seed)
    unigram = np.concatenate([counts, np.full(words.buckets, max(1.0, (total - counts.sum()) / words.buckets))])
    emit = unigram * rng.gamma(1.0, 1.0, (states, words.size)) + 1e-3
    move = np.full((states, states), 0.3 / max(1, states - 1)) + np.eye(states) * 0.7
    return Hmm(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _batches(sequences: list[np.ndarray], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers, symbols (steps, rows), sequences still going at each step), longest first; empty sequences are left out."""
    order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: -len(sequences[i]))
    for k in range(0, len(order), rows):
        part = order[k : k + rows]
        sizes = np.array([len(sequences[i]) for i in part])
        grid = np.zeros((int(sizes[0]), len(part)), dtype=np.uint16)
        for c, i in enumerate(part):
            grid[: sizes[c], c] = sequences[i]
        going = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        yield np.array(part), grid, going


def _advanced(model: Hmm, units: list[np.ndarray], heads: list[np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(states at each unit's end, log likelihood of the unit) from the distribution of its first state."""
    by_symbol = np.ascontiguousarray(model.emit.T)
    ends, logs = np.zeros((len(units), len(model.start))), np.zeros(len(units))
    for numbers, grid, going in _batches(units, rows):
        now = np.stack([heads[i] for i in numbers])
        log = np.zeros(len(numbers))
        for t in range(len(grid)):
            a = int(going[t])
            step = (now[:a] if t == 0 else now[:a] @ model.move) * by_symbol[grid[t, :a]]
            scale = step.sum(axis=1)
            now[:a] = step / scale[:, None]
            log[:a] += np.log(scale)
        ends[numbers], logs[numbers] = now, log
    return ends, logs


def _surrounded(model: Hmm, sequences: list[np.ndarray], rows: int, block: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The sequences' blocks as units, and for each whether it is a first one, the states before it (zeros for a first
    one) and the weight by state at its end of what follows, in any scale (ones for a last one)."""
    k = len(model.start)
    units: list[np.ndarray] = []
    chains: list[tuple[int, int]] = []  # first unit and number of units of the sequences with more than one
    firsts: list[bool] = []
    for s in sequences:
        n = -(-len(s) // block)
        if n > 1:
            chains.append((len(units), n))
        for at in range(0, len(s), block):
            units.append(s[at : at + block])
            firsts.append(at == 0)
    before, after = np.zeros((len(units), k)), np.ones((len(units), k))
    moved = [(at, 0) for at, _ in chains] + [(at + j, i) for at, n in chains for j in range(1, n) for i in range(k)]
    ends, logs = _advanced(model, [units[u] for u, _ in moved], [model.start if firsts[u] else model.move[i] for u, i in moved], rows)
    done = len(chains)
    for c, (at, n) in enumerate(chains):
        states, through = ends[c], []
        for j in range(1, n):
            part = slice(done, done + k)
            through.append(ends[part] * np.exp(logs[part] - logs[part].max())[:, None])
            done += k
            before[at + j] = states
            states = states @ through[-1]
            states = states / states.sum()
        for j in range(n - 1, 0, -1):
            weight = through[j - 1] @ after[at + j]
            after[at + j - 1] = weight / weight.max()
    return units, np.array(firsts, dtype=bool), before, after


class Counts:
    """Expected counts of the Baum-Welch step; they can be added."""

    def __init__(self, states: int, symbols: int):
        self.start, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols))
        self.log_likelihood = 0.0

    def collect(self, model: Hmm, sequences: list[np.ndarray], rows: int = 512, stretch: int = 4096) -> None:
        """Adds the expected counts of whole sequences; `stretch` is the length of their blocks and changes no count."""
        k = len(model.start)
        units, firsts, before, after = _surrounded(model, sequences, rows, stretch)
        heads = np.where(firsts[:, None], model.start, before @ model.move)
        emit, back = np.ascontiguousarray(model.emit), np.ascontiguousarray(model.move.T)
        for numbers, grid, going in _batches(units, rows):
            steps, width = grid.shape
            alpha, scale = np.zeros((steps, k, width)), np.ones((steps, width))  # states by rows: long inner loops
            for t in range(steps):
                a = int(going[t])
                now = (heads[numbers].T if t == 0 else back @ alpha[t - 1, :, :a]) * emit.take(grid[t, :a], axis=1)
                now.sum(axis=0, out=scale[t, :a])
                np.divide(now, scale[t, :a], out=alpha[t, :, :a])
            self.log_likelihood += float(np.log(scale).sum())
            sizes = np.array([len(units[i]) for i in numbers])
            beta = np.ascontiguousarray((after[numbers] / (alpha[sizes - 1, :, np.arange(width)] * after[numbers]).sum(axis=1, keepdims=True)).T)
            xi = np.zeros((k, k))
            for t in range(steps - 1, -1, -1):
                a = int(going[t])
                ahead = emit.take(grid[t, :a], axis=1)
                ahead *= beta[:, :a]
                ahead /= scale[t, :a]
                xi += (alpha[t - 1, :, :a] if t else before[numbers].T) @ ahead.T
                alpha[t, :, :a] *= beta[:, :a]
                if t:
                    beta[:, :a] = model.move @ ahead
            self.start += alpha[0][:, firsts[numbers]].sum(axis=1)
            self.move += xi * model.move
            live = np.arange(width)[None, :] < going[:, None]
            seen = grid[live].astype(np.int64)
            for s in range(k):
                self.emit[s] += np.bincount(seen, alpha[:, s][live], self.emit.shape[1])

    def model(self, prior: float = 0.01) -> Hmm:
        share = lambda c: (c + prior) / (c + prior).sum(axis=-1, keepdims=True)
        return Hmm(share(self.start), share(self.move), share(self.emit))


def _arrays(batches: Iterator[pa.RecordBatch], column: int, words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of a few million words at most with their symbol sequences."""
    for batch in slices(batches, column, 2 * words):
        yield batch, [np.frombuffer(b, dtype=np.uint16) for b in batch.column(column).to_pylist()]


def expect(encoded: DataFrame, model: Hmm, stretch: int) -> Counts:
    """One round's expected counts over all words of all documents, added up across partitions block by block. `stretch`
    is the length of the blocks in which long texts advance; it changes no count."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    states, symbols = model.emit.shape

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counts(states, symbols)
        for _, rows in _arrays(batches, 0, 1 << 21):
            total.collect(sent.value, rows, stretch=stretch)
        head = np.concatenate([total.start, total.move.ravel(), [total.log_likelihood]])
        values = [head.tobytes(), *(row.tobytes() for row in total.emit)]
        nest = np.full(len(values), TaskContext.get().partitionId() // 64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(nest, pa.int32()), pa.array(values, pa.binary())], names=["block", "nest", "counts"])

    def added(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, dtype=np.float64) for b in table["counts"].to_pylist())
        return pa.table({"block": table["block"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, counts binary"
    parts = encoded.select("symbols").mapInArrow(counted, "block int, nest int, counts binary")
    nests = parts.groupBy("block", "nest").applyInArrow(added, schema)  # 64 partitions' counts at a time
    blocks = {r["block"]: np.frombuffer(r["counts"]) for r in nests.groupBy("block").applyInArrow(added, schema).collect()}
    out = Counts(states, symbols)
    if blocks:
        out.start, out.log_likelihood = blocks[0][:states].copy(), float(blocks[0][-1])
        out.move = blocks[0][states:-1].reshape(states, states).copy()
        out.emit = np.stack([blocks[1 + s] for s in range(states)])
    return out


def log_likelihoods(model: Hmm, sequences: list[np.ndarray], rows: int = 512, block: int = 4096) -> np.ndarray:
    """Exact log likelihood of each sequence; 0 for an empty one."""
    k = len(model.start)
    units: list[np.ndarray] = []
    heads: list[np.ndarray] = []  # distribution of the first state of each unit
    where: list[list[int]] = []  # units of each sequence: one for its first block, k for each later one
    for s in sequences:
        mine = []
        for at in range(0, len(s), block):
            for head in [model.start] if at == 0 else list(model.move):
                mine.append(len(units))
                units.append(s[at : at + block])
                heads.append(head)
        where.append(mine)
    ends, logs = _advanced(model, units, heads, rows)
    out = np.zeros(len(sequences))
    for i, mine in enumerate(where):
        if mine:
            state, out[i] = ends[mine[0]], logs[mine[0]]
            for j in range(1, len(mine), k):
                part = slice(mine[j], mine[j] + k)
                top = logs[part].max()
                mixed = (state * np.exp(logs[part] - top)) @ ends[part]
                out[i] += top + np.log(mixed.sum())
                state = mixed / mixed.sum()
    return out


def _scored(encoded: DataFrame, model: Hmm, block: int, more: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, log_likelihood) of every row's symbols, and the columns `more` with their types."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _arrays(batches, 2, 1 << 22):
            out = log_likelihoods(sent.value, rows, block=block)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.float64()), *batch.columns[3:]], names=["doc_id", "n_words", "log_likelihood", *more]
            )

    more = more or {}
    schema = ", ".join(["doc_id bigint, n_words bigint, log_likelihood double", *(f"{c} {kind}" for c, kind in more.items())])
    return encoded.select("doc_id", "n_words", "symbols", *more).mapInArrow(scored, schema)


def _with_means(rows: DataFrame) -> DataFrame:
    mean = F.try_divide(F.col("log_likelihood"), F.col("n_words"))
    return rows.withColumn("per_word", mean).withColumn("perplexity", F.exp(-mean))


def score(encoded: DataFrame, model: Hmm, block: int = 4096) -> DataFrame:
    """(doc_id, n_words, log_likelihood, per_word, perplexity) of every row's symbols; per_word and perplexity are null
    without words."""
    return _with_means(_scored(encoded, model, block))


def score_words(encoded: DataFrame, model: Hmm, shares: DataFrame, block: int = 4096) -> DataFrame:
    """score() of the words themselves for rows of encode_words(): with the shares of the words in buckets."""
    firsts = encoded.select("chunk", "base", F.posexplode("fresh").alias("k", "word"))
    of_chunk = firsts.join(shares, "word").select("chunk", (F.col("base") + F.col("k")).alias("number"), "share")

    def added(rows: pa.Table, of: pa.Table) -> pa.Table:
        share = np.zeros(of.num_rows)
        share[of["number"].to_numpy()] = of["share"].to_numpy()
        more = [share[np.frombuffer(b, dtype=np.uint32)].sum() for b in rows["rare"].to_pylist()]
        return pa.table({"doc_id": rows["doc_id"], "n_words": rows["n_words"], "log_likelihood": pa.array(rows["log_likelihood"].to_numpy() + np.array(more), pa.float64())})

    rows = _scored(encoded, model, block, {"chunk": "bigint", "rare": "binary"})
    whole = rows.groupBy("chunk").cogroup(of_chunk.groupBy("chunk")).applyInArrow(added, "doc_id bigint, n_words bigint, log_likelihood double")
    return _with_means(whole)


def train(encoded: DataFrame, words: Words, counts: np.ndarray, states: int, rounds: int, stretch: int, seed: int) -> tuple[Hmm, list[float]]:
    """The model after `rounds` of Baum-Welch and the log likelihood before each; no round lowers it but for the prior."""
    total = float(encoded.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])
    model, path = initial(words, counts, total, states, seed), []
    for _ in range(rounds):
        found = expect(encoded, model, stretch)
        path.append(found.log_likelihood)
        model = found.model()
    return model, path


def score_documents(
    docs: DataFrame, states: int = 8, vocabulary: int = 8192, buckets: int = 256, rounds: int = 4, stretch: int = 4096, seed: int = 11,
) -> DataFrame:
    """Trains on all documents and scores each row: doc_id, n_words, log_likelihood, per_word, perplexity.

    A null or empty text has no words and a log likelihood of 0; null ids and repeated rows are scored each; ties in the
    vocabulary are broken by the word; an empty table gives no rows. Only doc_id and text are read."""
    every = cut(word_counts(docs))
    words, counts = frequent(every, vocabulary, buckets)
    encoded = cut(encode_words(docs, words))
    model, _ = train(encoded, words, counts, states, rounds, stretch, seed)
    return score_words(encoded, model, bucket_shares(every, words))
